"""DuckDB views of the engine's tables, written from the adapter rules.

Clocks are BIGINT epoch milliseconds here.
"""

from __future__ import annotations

import re

DAY = "86400000::BIGINT"

VIEWS: dict[str, str] = {
    "observations": f"""
        SELECT f.prefix || o_orderkey AS observation_id, 'entity://customer/' || o_custkey AS entity_id,
          f.property AS property,
          CASE WHEN f.prefix = 'order-' THEN '"' || o_orderstatus || '"'
               ELSE CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) END AS value_json,
          'p' || substr(o_orderpriority, 1, 1) AS provider, CAST(o_orderkey AS VARCHAR) AS external_id,
          CAST(NULL AS VARCHAR) AS revision, epoch_ms(o_orderdate) AS valid_from,
          CASE WHEN o_orderstatus = 'P' THEN epoch_ms(o_orderdate) + 120 * {DAY} END AS valid_to,
          epoch_ms(CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP)) AS recorded_at
        FROM orders, (VALUES ('order-', 'Customer.lastOrderStatus'), ('spend-', 'Customer.spendBand')) f(prefix, property)
        UNION ALL
        SELECT 'event-' || event_id, 'entity://user/' || user_id, 'User.' || event_type, props,
          's' || (hour(ts) % 4), CAST(event_id AS VARCHAR), 'r' || event_id, (epoch_us(ts) // 1000),
          NULL, epoch_ms(CAST(date_trunc('day', ts) AS TIMESTAMP))
        FROM events""",
    "returned_lines": """
        SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) = 1""",
    "retractions": f"""
        SELECT 'return-' || l_orderkey || '-' || l_linenumber || '-' || strftime(l_shipdate, '%Y%m%d') || '/' || prefix AS retraction_id,
          'observation' AS target_kind, prefix || l_orderkey AS target_id,
          epoch_ms(l_shipdate) AS effective_from, epoch_ms(l_shipdate) + 15 * {DAY} AS recorded_at
        FROM returned_lines, (VALUES ('order-'), ('spend-')) f(prefix)""",
    "relation_lines": """
        SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate,
          'line-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag
            || '-' || strftime(l_shipdate, '%Y%m%d') AS rid
        FROM lineitem""",
    "relations": f"""
        SELECT rid AS relation_id, 'entity://supplier/' || l_suppkey AS from_id, 'entity://part/' || l_partkey AS to_id,
          l_returnflag AS relation_type, epoch_ms(l_shipdate) AS valid_from,
          epoch_ms(l_shipdate) + 60 * {DAY} AS valid_to, epoch_ms(l_shipdate) + 2 * {DAY} AS recorded_at
        FROM relation_lines
        UNION ALL SELECT 'place-customer-' || c_custkey, 'entity://customer/' || c_custkey, 'entity://nation/' || c_nationkey,
          'located-in', 631152000000, NULL, 631152000000 FROM customer
        UNION ALL SELECT 'place-supplier-' || s_suppkey, 'entity://supplier/' || s_suppkey, 'entity://nation/' || s_nationkey,
          'located-in', 631152000000, NULL, 631152000000 FROM supplier
        UNION ALL SELECT 'place-nation-' || n_nationkey, 'entity://nation/' || n_nationkey, 'entity://region/' || n_regionkey,
          'located-in', 631152000000, NULL, 631152000000 FROM nation""",
    "relation_retractions": f"""
        SELECT DISTINCT 'end-' || rid AS retraction_id, 'relation' AS target_kind, rid AS target_id,
          epoch_ms(r.l_shipdate) + 20 * {DAY} AS effective_from, epoch_ms(r.l_shipdate) + 25 * {DAY} AS recorded_at
        FROM relation_lines r JOIN lineitem l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate)
        WHERE l.l_returnflag = 'R'""",
    "authority_rules": """
        SELECT 'entity://customer/' || c_custkey AS entity_id, 'Customer.lastOrderStatus' AS property, p AS provider, r AS rank
        FROM customer JOIN (VALUES ('BUILDING', 'p1', 1), ('BUILDING', 'p2', 2), ('MACHINERY', 'p5', 1)) v(seg, p, r)
          ON c_mktsegment = seg""",
    "named": """
        SELECT 'entity://customer/' || c_custkey AS entity_id, 'Customer' AS entity_type, 0 AS n, c_name AS value FROM customer
        UNION ALL SELECT 'entity://supplier/' || s_suppkey, 'Supplier', 0, s_name FROM supplier
        UNION ALL SELECT 'entity://nation/' || n_nationkey, 'Nation', 0, n_name FROM nation
        UNION ALL SELECT 'entity://region/' || r_regionkey, 'Region', 0, r_name FROM region
        UNION ALL SELECT 'entity://part/' || p_partkey, 'Part', 0, p_name FROM part
        UNION ALL SELECT 'entity://part/' || p_partkey, 'Part', 1, p_brand || ' ' || p_name FROM part
        UNION ALL SELECT DISTINCT 'entity://user/' || user_id, 'User', 0, 'user ' || user_id FROM events""",
    "entities": "SELECT entity_id, entity_type FROM named WHERE n = 0",
    "aliases": """
        SELECT 'alias-' || n || '-' || entity_id AS alias_id, entity_id, value,
          trim(regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm,
          CASE WHEN n = 0 THEN 631152000000 ELSE 928195200000 END AS recorded_at
        FROM named""",
    "scored_aliases": """
        SELECT *, len(string_split(norm, ' ')) * 100 + length(norm) AS score FROM aliases WHERE norm <> ''""",
    "type_cues": """
        SELECT * FROM (VALUES ('Customer', 'customer'), ('Customer', 'client'), ('Supplier', 'supplier'), ('Supplier', 'vendor'),
          ('Part', 'part'), ('Part', 'article'), ('Nation', 'nation'), ('Nation', 'country'), ('Region', 'region'),
          ('User', 'user'), ('User', 'account')) t(entity_type, cue)""",
    "relation_texts": """
        SELECT * FROM (VALUES ('A', 'accepted delivery of / delivers'), ('N', 'newly offers / offers'),
          ('R', 'returned delivery of / returns'), ('located-in', 'located in / lies in')) t(relation_type, words)""",
    "property_texts": """
        SELECT * FROM (VALUES ('Customer.lastOrderStatus', 'Customer last Order Status / order state / status'),
          ('Customer.spendBand', 'Customer spend Band / spending / band'),
          ('User.purchase', 'User purchase / bought / purchase')) t(property, label)""",
    "identity_queries": """
        SELECT 's-' || s_suppkey AS query_id,
          'Which widget or ring deliveries has the vendor ' || s_name || ' returned, and who offers them?' AS text FROM supplier
        UNION ALL SELECT 'n-' || n_nationkey, 'order status of ' || n_name || ' (country) today' FROM nation
        UNION ALL SELECT 'p-' || replace(p_name, ' ', '-'), 'Price of the article ' || min(p_brand) || ' ' || p_name FROM part GROUP BY p_name
        UNION ALL SELECT 'c-' || c_custkey, 'spending and order status for ' || c_name FROM customer""",
    "norm_queries": """
        SELECT query_id, text, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM identity_queries""",
    "context_records": """
        SELECT 'doc-' || d.doc_id AS record_id, 'entity://source/' || source AS entity_id,
          (['state', 'decision', 'commitment', 'relationship', 'event', 'artifact'])[CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 6 + 1] AS kind,
          text, coalesce(toxic = 0, false) AS is_current,
          CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.2 END AS importance
        FROM documents d LEFT JOIN labels l USING (doc_id)
        UNION ALL SELECT 'turn-' || conv_id || '-' || turn, 'entity://conversation/' || conv_id,
          CASE role WHEN 'user' THEN 'commitment' WHEN 'assistant' THEN 'decision' ELSE 'event' END, text, turn > 0, NULL
        FROM conversations""",
    "context_names": """
        SELECT DISTINCT 'entity://source/' || source AS entity_id, 'Source ' || source AS value FROM documents
        UNION ALL SELECT DISTINCT 'entity://conversation/' || conv_id, 'Conversation ' || conv_id FROM conversations""",
    "text_queries": "SELECT 'b-' || item_id AS query_id, text, 1200 AS budget FROM benchmark",
    "source_queries": """
        SELECT DISTINCT 'q-' || source AS query_id,
          'What is current in source ' || source || ' about the and of der die les que?' AS text, 3000 AS budget FROM documents""",
    "source_changes": f"""
        SELECT 'crm' AS source_key, 'chg-' || event_id AS change_id, 'user' AS external_type, CAST(user_id AS VARCHAR) AS external_id,
          CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind,
          CASE WHEN event_type <> 'view' THEN (epoch_us(ts) // 1000) END AS effective_at,
          CASE WHEN event_type <> 'click' THEN (epoch_us(ts) // 1000) + 300000 END AS recorded_at,
          props, event_type, value AS amount, (epoch_us(ts) // 1000) AS first_observed_at, event_id AS ord
        FROM events""",
    "artifact_mutations": f"""
        SELECT 'mut-' || page_id AS mutation_id, 'web' AS source_key, 'page' AS external_type,
          regexp_extract(url, '^https?://([^/]+)', 1) AS external_id,
          CASE WHEN contains(url, 'utm_source=feed') THEN 'delete' ELSE 'upsert' END AS kind,
          1704067200000 + page_id * {DAY} AS effective_at, 1704067200000 + (page_id + 2) * {DAY} AS recorded_at,
          CAST(page_id AS VARCHAR) AS revision, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url AS source_uri,
          CASE WHEN NOT contains(url, 'utm_source=feed') THEN sha256(html) END AS blob_digest,
          CASE WHEN NOT contains(url, 'utm_source=feed') THEN CAST(strlen(html) AS BIGINT) END AS blob_size, html
        FROM pages""",
    "left_records": """
        SELECT 'observation:order-' || o_orderkey AS key, 'order-' || o_orderkey AS record_id,
          '{"customer":' || o_custkey || ',"id":"order-' || o_orderkey || '","status":"' || o_orderstatus || '"}' AS payload
        FROM orders""",
    "right_records": """
        SELECT 'observation:' || rid AS key, rid AS record_id,
          '{"customer":' || o_custkey || ',"id":"' || rid || '","status":"' || st || '"}' AS payload
        FROM (SELECT o_custkey, 'order-' || o_orderkey || s AS rid,
                CASE WHEN day(o_orderdate) = 2 THEN 'X' ELSE o_orderstatus END AS st
              FROM orders, (VALUES (''), ('/copy')) v(s)
              WHERE day(o_orderdate) <> 1 AND (s = '' OR day(o_orderdate) = 3))""",
    "journal_events": """
        SELECT 'j-' || event_id AS event_id, 'run-' || user_id AS run_id, 'entity://user/' || user_id AS entity_id,
          CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'view' THEN 'mutation.requested'
            WHEN 'click' THEN 'mutation.applied' WHEN 'error' THEN 'mutation.failed' ELSE 'run.finished' END AS type,
          (epoch_us(ts) // 1000) AS occurred_at, 'svc-' || (hour(ts) % 3) AS actor_subject,
          user_id || ':' || json_extract_string(props, '$.k') AS mutation_id, props AS payload
        FROM events""",
    "access_events": """
        SELECT (epoch_us(ts) // 1000) AS at_ms, 'user-' || user_id AS subject,
          CASE event_type WHEN 'view' THEN 'context.compile' WHEN 'click' THEN 'records.read'
            WHEN 'purchase' THEN 'blob.read' ELSE 'context.search' END AS operation,
          CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS outcome,
          CASE WHEN event_type = 'error' THEN 'no-matching-policy-rule' END AS code
        FROM events""",
    "grants": """
        SELECT 'reader-' || lower(c_mktsegment) AS subject, 'entity://customer/' || c_custkey AS entity_id,
          CASE WHEN c_acctbal < 0 THEN 'deny' ELSE 'allow' END AS effect FROM customer""",
    "principals": "SELECT DISTINCT 'reader-' || lower(c_mktsegment) AS subject FROM customer",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it names, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(sql: str) -> None:
        sql = re.sub(r"'[^']*'", "''", sql)
        for name in known:
            if name not in open_names and re.search(rf"\b{name}\b", sql):
                open_names.add(name)
                visit(known[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    def clause(name: str) -> str:
        sql = known[name].strip()
        if sql.startswith("RECURSIVE"):
            return f"{name} AS ({sql.removeprefix('RECURSIVE')})"
        return f"{name} AS MATERIALIZED ({sql})"

    head = ",\n".join(clause(name) for name in needed)
    word = "WITH RECURSIVE" if any(known[n].strip().startswith("RECURSIVE") for n in needed) else "WITH"
    return f"{word} {head}\n{body.strip()}"
