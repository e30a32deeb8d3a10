"""Queries over grants, registries, landed sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.functions import values as vl
from lakestate.functions.ordering import previous, with_ordinal
from lakestate.operators import artifact as af
from lakestate.operators import identity as idn
from lakestate.operators import journal as jn
from lakestate.operators import merkle as mk
from lakestate.operators import policy as po
from lakestate.operators import temporal as tp
from lakestate.plans.feed_queries import ARTIFACT, ARTIFACT_PROBES, INGEST, SLOTS, _tables, AT
from lakestate.plans.record_queries import _left, _views, BITS
from lakestate.plans.registry import query
from lakestate.plans.retrieval_queries import GRAPH, _direct, _edge_texts
from lakestate.sources import feeds as fd
from lakestate.sources import files as fl
from lakestate.sources.adapters import SCHEMAS, Lake
from lakestate.session import passing, pinned, run_dir, written
from lakestate.operators import capsule as cp
from lakestate.streaming import jobs, keyed

READ = {"may": "SELECT subject, entity_id FROM grants WHERE effect = 'allow'"}


def _customer(lake: Lake) -> DataFrame:
    return lake.table("customer").withColumn("entity_id", F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")))


@query("principals", "SELECT subject, 'context:read,record:read' AS scopes FROM principals")
def principals(lake: Lake) -> DataFrame:
    return po.normalize_principals(lake.principals()).select("subject", F.array_join("scopes", ",").alias("scopes"))


SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
ASKER = "'reader-' || list_value('automobile', 'building', 'furniture', 'household', 'machinery')[1 + o_orderkey % 5]"


def _asker():
    """The reader that asks about an order: one of the five, by the order's key."""
    return F.concat(F.lit("reader-"), F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("o_orderkey") % 5 + 1).cast("int")))


@query(
    "policy_decisions",
    f"""SELECT a.subject, a.entity_id, o_orderkey, coalesce(g.effect, 'deny') AS outcome,
         CASE WHEN g.effect IS NULL THEN 'no-matching-policy-rule' WHEN g.effect = 'deny' THEN 'denied-by-rule' END AS code
       FROM (SELECT o_orderkey, {ASKER} AS subject, 'entity://customer/' || o_custkey AS entity_id FROM orders) a
       LEFT JOIN grants g ON g.subject = a.subject AND g.entity_id = a.entity_id""",
)
def policy_decisions(lake: Lake) -> DataFrame:
    """For every order one reader asks for its customer."""
    asks = lake.table("orders").select(
        _asker().alias("subject"), F.concat(F.lit("entity://customer/"), F.col("o_custkey").cast("string")).alias("entity_id"), "o_orderkey"
    )
    return po.decide(asks, lake.grants(), ["subject", "entity_id"])


@query("policy_visible_rows", "SELECT m.subject, o.observation_id FROM observations o JOIN may m USING (entity_id)", READ)
def policy_visible_rows(lake: Lake) -> DataFrame:
    return po.visible_rows(lake.observations(), lake.grants()).select("subject", "observation_id")


def _neighbours(lake: Lake) -> DataFrame:
    """Each customer points to the customers that share an order day with it."""
    o = lake.table("orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("m"), "o_orderpriority", "o_orderstatus", "o_orderkey")
    k = F.col("o_custkey")
    ref = lambda c: F.concat(F.lit('"entity://customer/'), c.cast("string"), F.lit('"'))
    return o.select(
        F.concat(F.lit("entity://customer/"), k.cast("string")).alias("entity_id"),
        F.concat(F.lit("note-"), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.concat(F.lit("Customer.peer"), F.col("o_orderstatus")).alias("property"),
        F.concat(F.lit('{"entity://customer/0":1,"peers":['), ref(k + 1), F.lit(","), ref(k), F.lit("]}")).alias("value_json"),
    )


NOTES = {
    **READ,
    "notes": """
        SELECT 'entity://customer/' || o_custkey AS entity_id, 'note-' || o_orderkey AS record_id, 'Customer.peer' || o_orderstatus AS property,
          'entity://customer/' || (o_custkey + 1) AS peer FROM orders""",
}


@query(
    "policy_hidden_references",
    "SELECT m.subject, n.record_id FROM notes n JOIN may m USING (entity_id) WHERE (m.subject, n.peer) IN (SELECT (subject, entity_id) FROM may)",
    NOTES,
)
def policy_hidden_references(lake: Lake) -> DataFrame:
    """Values naming a hidden customer are dropped; names used as keys do not count."""
    rows = po.visible_rows(_neighbours(lake), lake.grants())
    return po.hide_references(rows, lake.grants(), ["record_id"]).select("subject", "record_id")


@query(
    "policy_hidden_conflicts",
    """SELECT m.subject, n.entity_id, n.property, count(*) AS n_candidates FROM notes n JOIN may m USING (entity_id) GROUP BY 1, 2, 3
       HAVING bool_and((m.subject, n.peer) IN (SELECT (subject, entity_id) FROM may))""",
    NOTES,
)
def policy_hidden_conflicts(lake: Lake) -> DataFrame:
    rows = po.visible_rows(_neighbours(lake), lake.grants())
    kept = po.hide_references(rows, lake.grants(), ["entity_id", "property"])
    return kept.groupBy("subject", "entity_id", "property").agg(F.count(F.lit(1)).alias("n_candidates"))


@query(
    "policy_visible_edges",
    """SELECT a.subject, a.entity_id AS from_id, b.entity_id AS to_id FROM may a JOIN may b ON b.subject = a.subject
       AND b.entity_id = 'entity://customer/' || (CAST(substr(a.entity_id, 19) AS BIGINT) + 1)""",
    READ,
)
def policy_visible_edges(lake: Lake) -> DataFrame:
    key = F.col("c_custkey")
    edges = _customer(lake).select(
        F.col("entity_id").alias("from_id"), F.concat(F.lit("entity://customer/"), (key + 1).cast("string")).alias("to_id")
    )
    return po.visible_edges(edges, lake.grants()).select("subject", "from_id", "to_id")


@query(
    "policy_evidence",
    """SELECT m.subject, o.entity_id AS record_id, count(DISTINCT CASE WHEN p.e IS NOT NULL THEN o.external_id END) AS n_refs
       FROM observations o JOIN may m USING (entity_id)
       LEFT JOIN (SELECT 'reader-' || lower(c_mktsegment) AS s, CAST(o_orderkey AS VARCHAR) AS e FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F') p
         ON p.s = m.subject AND p.e = o.external_id
       WHERE o.entity_id LIKE 'entity://customer/%' GROUP BY 1, 2""",
    READ,
)
def policy_evidence(lake: Lake) -> DataFrame:
    """Readers may cite finished orders only."""
    cite = lake.table("orders").filter("o_orderstatus = 'F'").join(
        lake.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    ).select(
        F.concat(F.lit("reader-"), F.lower("c_mktsegment")).alias("subject"), F.col("o_orderkey").cast("string").alias("ref"), F.lit("allow").alias("effect")
    )
    rows = po.visible_rows(lake.order_observations(), lake.grants()).select("subject", F.col("entity_id").alias("record_id"), F.col("external_id").alias("ref"))
    return po.filter_evidence(rows, cite)


@query(
    "policy_derived_grants",
    """SELECT 'reader-all' AS subject, 'entity://customer/' || c_custkey AS entity_id, 'Customer.lastOrderStatus' AS property,
         CASE WHEN c_acctbal < 0 THEN 'deny'
           WHEN c_mktsegment IN ('BUILDING') THEN 'allow' WHEN c_mktsegment = 'MACHINERY' THEN 'deny'
           WHEN NOT EXISTS (SELECT 1 FROM observations o WHERE o.entity_id = 'entity://customer/' || c_custkey AND o.property = 'Customer.lastOrderStatus') THEN 'deny'
           WHEN EXISTS (SELECT 1 FROM observations o WHERE o.entity_id = 'entity://customer/' || c_custkey AND o.property = 'Customer.lastOrderStatus' AND o.provider NOT IN ('p1', 'p2', 'p3')) THEN 'deny'
           ELSE 'allow' END AS effect FROM customer""",
)
def policy_derived_grants(lake: Lake) -> DataFrame:
    """One reader may see the order status as far as it comes from p1, p2 or p3."""
    fields = _customer(lake).select(
        F.lit("reader-all").alias("subject"), "entity_id", F.lit("Customer.lastOrderStatus").alias("property"),
        (F.col("c_acctbal") >= 0).alias("read"), F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")).alias("providers"),
    )
    possible = lake.order_observations().filter("property = 'Customer.lastOrderStatus'").select("entity_id", "property", "provider").distinct()
    return po.derive_grants(fields, lake.authority_rules(), possible)


@query(
    "policy_bindings",
    """SELECT 'ops' AS subject, 'entity://customer/' || c_custkey AS entity_id, provider, canonical, c_acctbal >= 0 AS readable,
         provider = 'billing' AND c_acctbal >= 5000 AS writable
       FROM customer, (VALUES ('crm'), ('billing')) v(provider), (VALUES ('Customer.segment')) c(canonical)""",
)
def policy_bindings(lake: Lake) -> DataFrame:
    from lakestate.plans.feed_queries import _bindings

    may = _customer(lake).select(
        F.lit("ops").alias("subject"), "entity_id", F.lit("Customer.segment").alias("property"),
        (F.col("c_acctbal") >= 0).alias("read"), (F.col("c_acctbal") >= 5000).alias("write"),
    )
    return po.project_bindings(_bindings(lake), may)


def _owned(lake: Lake) -> DataFrame:
    """Order records with the customer they are about."""
    return _left(lake).withColumn("entity_id", F.concat(F.lit("entity://customer/"), F.get_json_object("payload", "$.customer"))).drop("payload")


OWNED = {**_views(), **READ, "owned": "SELECT d.*, 'entity://customer/' || json_extract_string(payload, '$.customer') AS entity_id FROM left_desc d"}


@query(
    "policy_replication",
    """SELECT subject, count(*) AS n_allowed, CAST(sum(payload_bytes) AS BIGINT) AS bytes, (SELECT count(*) FROM owned) AS n_scanned
       FROM owned JOIN may USING (entity_id) GROUP BY 1""",
    OWNED,
)
def policy_replication(lake: Lake) -> DataFrame:
    rows = _owned(lake)
    return po.projection_accounting(rows, po.replication_projection(rows, lake.grants()))


@query(
    "policy_replication_leaves",
    """SELECT subject, leaf, sha256('leaf:' || string_agg(h, '' ORDER BY strand)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT subject, leaf, strand, count(*) AS n, sha256(string_agg(fingerprint, '' ORDER BY key)) AS h FROM owned JOIN may USING (entity_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    OWNED,
)
def policy_replication_leaves(lake: Lake) -> DataFrame:
    """One tree per reader over what that reader may replicate."""
    return mk.leaves(po.replication_projection(_owned(lake), lake.grants()), BITS, ["subject"])


ROOTS = f"""
    SELECT subject, {{scope}} max(n) AS n, sha256(string_agg(printf('%04x', CAST(total % 65536 AS BIGINT)), '' ORDER BY lane)) AS root
    FROM (SELECT subject, {{scope}} lane, count(*) AS n,
            sum(CAST('0x' || substr(sha256((lane // 16) || ':' || key || ':' || fingerprint), 4 * (lane % 16) + 1, 4) AS INTEGER)) AS total
          FROM owned JOIN may USING (entity_id), range({po.LANES}) r(lane) GROUP BY subject, {{scope}} lane) GROUP BY {{scope}} subject"""


@query("policy_roots", ROOTS.format(scope=""), OWNED)
def policy_roots(lake: Lake) -> DataFrame:
    """One root per reader over what that reader may replicate, summed by visibility class."""
    return po.reader_roots(_owned(lake), lake.grants()).select("subject", "n", "root")


@query("policy_leaf_roots", ROOTS.format(scope="leaf,"), OWNED)
def policy_leaf_roots(lake: Lake) -> DataFrame:
    """The same for each leaf, which is what two replicas compare next."""
    rows = _owned(lake).withColumn("leaf", mk.leaf_id(F.col("key"), BITS))
    return po.reader_roots(rows, lake.grants(), ["leaf"]).select("subject", "leaf", "n", "root")


@query(
    "policy_transfer",
    f"""SELECT 'req-' || month(o_orderdate) AS request_id, p.subject, count(m.subject) AS n_found, count(*) - count(m.subject) AS n_unavailable,
         CAST(coalesce(sum(CASE WHEN m.subject IS NOT NULL THEN payload_bytes END), 0) AS BIGINT) AS bytes,
         CASE WHEN count(m.subject) > 20 THEN 'too-many-records' WHEN coalesce(sum(CASE WHEN m.subject IS NOT NULL THEN payload_bytes END), 0) > 900 THEN 'too-many-bytes' ELSE 'ok' END AS status
       FROM (SELECT *, {ASKER} AS subject FROM orders) p JOIN owned d ON d.key = 'observation:order-' || o_orderkey
       LEFT JOIN may m ON m.subject = p.subject AND m.entity_id = d.entity_id GROUP BY 1, 2""",
    OWNED,
)
def policy_transfer(lake: Lake) -> DataFrame:
    """Every order is asked for by one reader, in one request per reader and month of the year."""
    asks = lake.table("orders").select(
        F.concat(F.lit("req-"), F.month("o_orderdate").cast("string")).alias("request_id"),
        F.concat(F.lit("observation:order-"), F.col("o_orderkey").cast("string")).alias("key"), _asker().alias("subject"),
    )
    return po.transfer(asks, po.replication_projection(_owned(lake), lake.grants()), 20, 900)


@query(
    "policy_blob_reads",
    """SELECT 'reader' AS subject, sha256(html) AS digest, CASE WHEN bool_or(url LIKE 'https:%' AND url NOT LIKE '%#top') THEN 'allow' ELSE 'deny' END AS outcome,
         min(CASE WHEN url LIKE 'https:%' AND url NOT LIKE '%#top' THEN 'page-' || page_id END) AS by_record, count(*) AS n_references FROM pages GROUP BY html""",
)
def policy_blob_reads(lake: Lake) -> DataFrame:
    pages = lake.table("pages")
    refs = pages.select(F.sha2("html", 256).alias("digest"), F.concat(F.lit("url:"), F.col("page_id").cast("string")).alias("entity_id"),
                        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("record_id"))
    may = pages.select(F.lit("reader").alias("subject"), F.concat(F.lit("url:"), F.col("page_id").cast("string")).alias("entity_id"),
                       F.col("url").startswith("https:").alias("record_read"), (~F.col("url").endswith("#top")).alias("blob_read"))
    asks = refs.select(F.lit("reader").alias("subject"), "digest").distinct()
    return po.blob_reads(asks, refs, may)


@query(
    "policy_apply_batches",
    """SELECT 'batch-' || c_nationkey AS batch_id, 'reader-' || lower(c_mktsegment) AS subject, count(*) AS n_records,
         count(*) FILTER (c_acctbal < 0) AS n_denied, CASE WHEN count(*) FILTER (c_acctbal < 0) = 0 THEN 'allow' ELSE 'deny' END AS outcome
       FROM customer GROUP BY 1, 2""",
)
def policy_apply_batches(lake: Lake) -> DataFrame:
    rows = _customer(lake).select(
        F.concat(F.lit("batch-"), F.col("c_nationkey").cast("string")).alias("batch_id"), F.concat(F.lit("reader-"), F.lower("c_mktsegment")).alias("subject"), "entity_id"
    )
    return po.apply_batches(rows, lake.grants())


@query(
    "policy_artifacts",
    """SELECT probe_id, 'lang-' || split_part(external_id, '.', -1) AS subject, external_id, CASE WHEN blob_size <= 2500 THEN 'ok' ELSE 'too-large' END AS read
       FROM versions WHERE status = 'present'""",
    ARTIFACT,
)
def policy_artifacts(lake: Lake) -> DataFrame:
    """One reader per top-level domain."""
    versions = af.as_of(lake.artifact_mutations(), ARTIFACT_PROBES)
    may = lake.artifact_mutations().select(
        F.concat(F.lit("lang-"), F.substring_index("external_id", ".", -1)).alias("subject"), "external_id", F.lit("allow").alias("effect")
    ).distinct()
    return po.visible_artifacts(versions, may, 2500).select("probe_id", "subject", "external_id", "read")


@query(
    "policy_audit_rollup",
    """SELECT epoch_ms(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS window_start, operation, outcome, code, count(*) AS n
       FROM (SELECT make_timestamp(at_ms * 1000) AS ts, * FROM access_events) GROUP BY 1, 2, 3, 4""",
)
def policy_audit_rollup(lake: Lake) -> DataFrame:
    return po.audit_rollup(lake.access_events()).withColumn("window_start", F.unix_millis("window_start"))


@query(
    "policy_audit_rows",
    """SELECT 1706745600000 AS at, 'reader-' || lower(c_mktsegment) AS subject, 'record.read' AS operation, CASE WHEN c_acctbal < 0 THEN 'deny' ELSE 'allow' END AS outcome,
         CASE WHEN c_acctbal < 0 THEN 'denied-by-rule' END AS code FROM customer""",
)
def policy_audit_rows(lake: Lake) -> DataFrame:
    asks = lake.grants().select("subject", "entity_id")
    rows = po.audit_rows(po.decide(asks, lake.grants(), ["subject", "entity_id"]), "record.read", "2024-02-01")
    return rows.withColumn("at", F.unix_millis("at"))


@query(
    "capsule_relation_picks",
    """SELECT query_id, relation_id, score, rank FROM (
         SELECT d.query_id, e.relation_id, len(list_intersect(list_distinct(list_filter(string_split(q.norm, ' '), lambda x: length(x) >= 2)),
             string_split(trim(regexp_replace(lower(coalesce(words, relation_type) || ' ' || a.names), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))) AS score,
           row_number() OVER (PARTITION BY d.query_id ORDER BY score DESC, e.relation_id) AS rank
         FROM directs d JOIN norm_queries q USING (query_id) JOIN live e ON e.from_id = d.entity_id LEFT JOIN relation_texts USING (relation_type)
         JOIN (SELECT entity_id, array_to_string(list_sort(list(DISTINCT value)), ' ') AS names FROM aliases GROUP BY 1) a ON a.entity_id = e.to_id) WHERE rank <= 4 AND score > 0""",
    GRAPH,
)
def capsule_relation_picks(lake: Lake) -> DataFrame:
    from lakestate.plans.retrieval_queries import GRAPH_PROBE

    edges = tp.active_edges(lake.relations(), lake.relation_retractions(), [GRAPH_PROBE])
    words = lake.relation_types().select(F.col("type_id").alias("relation_type"), F.array_join("aliases", " / ").alias("words"))
    picks = po.relation_picks(pinned(_direct(lake)), edges, words, lake.aliases().select("entity_id", "value"), 4)
    return picks.select("query_id", "relation_id", "score", "rank")


@query(
    "relation_scan_limits",
    "SELECT d.query_id, count(*) AS n FROM directs d JOIN live e ON e.from_id = d.entity_id GROUP BY 1 HAVING count(*) > 8",
    GRAPH,
)
def relation_scan_limits(lake: Lake) -> DataFrame:
    direct = _direct(lake).withColumnRenamed("entity_id", "from_id")
    return po.scan_limits(_edge_texts(lake).join(direct.select("query_id", "from_id"), "from_id"), 8)


SECURE_QUERIES = "SELECT 'c-' || c_custkey AS query_id, 'peer notes of ' || c_name AS text, 60 AS budget, 'entity://customer/' || c_custkey AS entity_id FROM customer"
SECURE = {
    **NOTES,
    "seen": """
        SELECT m.subject, n.entity_id, n.record_id, n.property, n.peer FROM notes n JOIN may m USING (entity_id)
        WHERE (m.subject, n.peer) IN (SELECT (subject, entity_id) FROM may)""",
}


@query(
    "policy_secure_compile",
    """SELECT m.subject, q.query_id, 'resolved' AS status, (SELECT count(*) FROM seen s WHERE s.subject = m.subject AND s.entity_id = q.entity_id) > 0 AS has_records
       FROM the_queries q JOIN may m USING (entity_id)""",
    {**SECURE, "the_queries": SECURE_QUERIES},
)
def policy_secure_compile(lake: Lake) -> DataFrame:
    """All readers, all questions: visibility, resolution, ranking, budget."""
    queries = _customer(lake).select(
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("query_id"), F.concat(F.lit("peer notes of "), F.col("c_name")).alias("text"),
        F.lit(60).alias("budget_tokens"),
    )
    names = _customer(lake).select("entity_id", F.col("c_name").alias("value"), F.lit("1990-01-01").cast("timestamp").alias("recorded_at"))
    entities = _customer(lake).select("entity_id", F.lit("Customer").alias("entity_type"))
    notes = _neighbours(lake).withColumn("text", F.concat(F.lit("peer note about "), F.col("property"), F.lit(".")))
    resolution, picks = po.secure_compile(queries, lake.grants(), idn.alias_index(names), entities, lake.entity_types(), notes, names.select("entity_id", "value"))
    got = picks.select(F.col("query_id").alias("ask_id")).distinct().withColumn("has_records", F.lit(True))
    return resolution.join(got, "ask_id", "left").select("subject", "query_id", "status", F.coalesce("has_records", F.lit(False)).alias("has_records"))


# -- registries -----------------------------------------------------------------------


def _epochs(lake: Lake) -> DataFrame:
    """Orders of a customer as key epochs, each following the order before it in key order."""
    o = previous(
        with_ordinal(lake.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderkey"]),
        ["o_custkey"], ["o_orderkey"],
    )
    ident = lambda c: F.concat(F.lit("epoch-"), c.cast("string"))
    return o.select(
        F.concat(F.lit("p-"), F.col("o_custkey").cast("string")).alias("principal"), ident(F.col("o_orderkey")).alias("epoch_id"),
        F.when(F.col("o_orderstatus") != "P", ident(F.col("prev_o_orderkey"))).alias("predecessor_epoch_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.array(F.lit("device-a"), F.when(F.col("o_orderstatus") == "F", F.lit("device-a")).otherwise(F.lit("device-b"))).alias("recipients"),
    )


REGISTRY = {
    "epochs": """
        SELECT 'p-' || o_custkey AS principal, 'epoch-' || o_orderkey AS epoch_id,
          CASE WHEN o_orderstatus <> 'P' THEN 'epoch-' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS prior_id,
          epoch_ms(o_orderdate) AS created_at, o_orderstatus AS st FROM orders"""
}


@query(
    "epoch_heads",
    """SELECT principal, count(*) AS n_heads, CASE WHEN count(*) = 1 THEN min(epoch_id) END AS epoch_id, CASE WHEN count(*) = 1 THEN 'active' ELSE 'corrupt' END AS status
       FROM epochs e WHERE NOT EXISTS (SELECT 1 FROM epochs n WHERE n.principal = e.principal AND n.prior_id = e.epoch_id) GROUP BY 1""",
    REGISTRY,
)
def epoch_heads(lake: Lake) -> DataFrame:
    return jn.epoch_heads(_epochs(lake))


@query(
    "epoch_violations",
    """SELECT e.principal, e.epoch_id, 'older-than-predecessor' AS rule FROM epochs e JOIN epochs b ON b.principal = e.principal AND b.epoch_id = e.prior_id WHERE e.created_at < b.created_at
       UNION ALL SELECT principal, epoch_id, 'repeated-recipient' FROM epochs WHERE st = 'F'""",
    REGISTRY,
)
def epoch_violations(lake: Lake) -> DataFrame:
    return jn.epoch_violations(_epochs(lake))


@query(
    "grant_inventory",
    """SELECT coalesce(w.e, h.e) AS epoch_id, coalesce(w.r, h.r) AS recipient, CASE WHEN w.e IS NULL THEN 'unexpected' WHEN h.e IS NULL THEN 'missing' ELSE 'duplicate' END AS rule
       FROM (SELECT DISTINCT 'epoch-' || l_orderkey AS e, 'device-' || l_linenumber AS r FROM lineitem WHERE l_returnflag <> 'N') w
       FULL JOIN (SELECT 'epoch-' || l_orderkey AS e, 'device-' || l_linenumber AS r, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) h ON w.e = h.e AND w.r = h.r
       WHERE w.e IS NULL OR h.e IS NULL OR h.n > 1""",
)
def grant_inventory(lake: Lake) -> DataFrame:
    rows = lake.table("lineitem").select(
        F.concat(F.lit("epoch-"), F.col("l_orderkey").cast("string")).alias("epoch_id"), F.concat(F.lit("device-"), F.col("l_linenumber").cast("string")).alias("recipient"), "l_returnflag"
    )
    return jn.grant_inventory(rows.filter("l_returnflag <> 'N'"), rows.filter("l_returnflag <> 'A'"))


@query(
    "active_recipients",
    """SELECT 'enc-' || o_orderkey AS encryption_key_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       WHERE (o_orderstatus <> 'P' AND c_acctbal >= 0 AND c_mktsegment <> 'BUILDING') OR (o_orderstatus = 'P' AND n_regionkey <> 1 AND day(o_orderdate) = n_regionkey)""",
)
def active_recipients(lake: Lake) -> DataFrame:
    """Customers as devices (active unless in debt) and keys, nations as recovery credentials."""
    c = lake.table("customer")
    orders = lake.table("orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    pending = F.col("o_orderstatus") == "P"
    bindings = orders.select(
        F.concat(F.lit("enc-"), F.col("o_orderkey").cast("string")).alias("encryption_key_id"),
        F.when(pending, F.lit("recovery")).otherwise(F.lit("device")).alias("subject_kind"),
        F.when(pending, F.concat(F.lit("n-"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("k-"), F.col("o_custkey").cast("string"))).alias("subject_key_id"),
        F.col("o_custkey").cast("string").alias("device_id"), F.dayofmonth("o_orderdate").alias("recovery_generation"),
    )
    live = lambda ok: F.when(ok, F.lit("active")).otherwise(F.lit("revoked")).alias("status")
    devices = c.select(F.col("c_custkey").cast("string").alias("device_id"), live(F.col("c_acctbal") >= 0))
    keys = c.select(F.concat(F.lit("k-"), F.col("c_custkey").cast("string")).alias("subject_key_id"), live(F.col("c_mktsegment") != "BUILDING"))
    recoveries = lake.table("nation").select(
        F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("subject_key_id"), live(F.col("n_regionkey") != 1), F.col("n_regionkey").alias("generation")
    )
    return jn.active_recipients(bindings, devices, keys, recoveries)


@query("expired_rows", "SELECT event_id FROM journal_events WHERE occurred_at <= 1705276800000")
def expired_rows(lake: Lake) -> DataFrame:
    return jn.expired(lake.journal_events(), "occurred_at", F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query(
    "replayed_messages",
    """SELECT event_id, mutation_id FROM journal_events QUALIFY row_number() OVER (PARTITION BY mutation_id ORDER BY occurred_at, event_id) > 1""",
)
def replayed_messages(lake: Lake) -> DataFrame:
    return jn.replays(lake.journal_events(), "mutation_id", "occurred_at")


# -- landed sources ----------------------------------------------------------------------


def _files(lake: Lake) -> DataFrame:
    """Documents as Markdown files; Spanish ones use list syntax, German ones have no front matter."""
    front = F.when(
        F.col("lang") == "es", F.concat(F.lit("---\nlang: [es]\nsource: '"), "source", F.lit("'\n---\n"))
    ).when(F.col("lang") == "de", F.lit("")).otherwise(
        F.concat(F.lit("---\nlang: "), "lang", F.lit("\nsource: "), "source", F.lit("\nsize: "), F.col("n_chars").cast("string"), F.lit("\n---\n"))
    )
    whole = F.concat(front, F.lit("# Text\n"), "text")
    return lake.table("documents").select(
        F.concat(F.lit("notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.octet_length(whole).cast("bigint").alias("size"), F.encode(whole, "UTF-8").alias("content"),
    )


MARKDOWN = {
    "md": """
        SELECT 'notes/' || source || '/' || doc_id || '.md' AS path, lang, source, n_chars,
          CASE lang WHEN 'es' THEN '---' || chr(10) || 'lang: [es]' || chr(10) || 'source: ''' || source || '''' || chr(10) || '---' || chr(10) WHEN 'de' THEN ''
            ELSE '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || 'size: ' || n_chars || chr(10) || '---' || chr(10) END
          || '# Text' || chr(10) || text AS whole FROM documents""",
}


@query(
    "markdown_files",
    """SELECT path, sha256(whole) AS revision, CASE lang WHEN 'es' THEN '{"lang":["es"],"source":"' || source || '"}' WHEN 'de' THEN NULL
         ELSE '{"lang":"' || lang || '","size":' || n_chars || ',"source":"' || source || '"}' END AS fields FROM md""",
    MARKDOWN,
)
def markdown_files(lake: Lake) -> DataFrame:
    return fl.parse_markdown(_files(lake)).select("path", "revision", "fields")


@query(
    "file_observations",
    """SELECT path AS external_id, external, value_json FROM (
         SELECT path, 'source' AS external, '"' || source || '"' AS value_json FROM md WHERE lang <> 'de'
         UNION ALL SELECT path, '/size', CAST(n_chars AS VARCHAR) FROM md WHERE lang NOT IN ('de', 'es'))""",
    MARKDOWN,
)
def file_observations(lake: Lake) -> DataFrame:
    """Two readable fields per file, one by path, one by pointer."""
    fields = F.explode(F.array(F.lit("source"), F.lit("/size")))
    bindings = _files(lake).select(
        F.col("path").alias("external_id"), F.concat(F.lit("entity://note/"), "path").alias("entity_id"), F.lit("notes").alias("provider"), F.lit(True).alias("readable"),
        fields.alias("external"),
    )
    return fl.observe_files(fl.parse_markdown(_files(lake)), bindings)[0].select("external_id", "external", "value_json")


@query(
    "file_inventory",
    """SELECT 'notes/' || source || '/' || doc_id || '.md' AS path, 'unlisted' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT 'notes/lost/' || doc_id || '.md', 'missing' FROM labels WHERE toxic = 1""",
)
def file_inventory(lake: Lake) -> DataFrame:
    """Labelled documents are the list, plus one lost file per toxic label."""
    docs = lake.table("documents").join(lake.table("labels"), "doc_id").select(F.concat(F.lit("notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    lost = lake.table("labels").filter("toxic = 1").select(F.concat(F.lit("notes/lost/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return fl.check_inventory(_files(lake), docs.unionByName(lost))


@query("scan_bounds", "SELECT count(*) AS n_files, CAST(sum(strlen(whole)) AS BIGINT) AS n_bytes, 'too-many-files' AS status FROM md", MARKDOWN)
def scan_bounds(lake: Lake) -> DataFrame:
    return fl.scan_bounds(_files(lake), 100, 1 << 40)


@query(
    "doc_excerpts",
    """SELECT source AS project, count(*) AS n_docs, substr(string_agg(path || ': ' || substr(trim(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]+', ' ', 'g'), ' '), 1, 1100), chr(10) ORDER BY path), 1, 11000) AS excerpt
       FROM (SELECT source, text, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path FROM documents WHERE strlen(text) <= 65536
             QUALIFY row_number() OVER (PARTITION BY source ORDER BY path) <= 20) GROUP BY 1""",
)
def doc_excerpts(lake: Lake) -> DataFrame:
    docs = lake.table("documents").select(F.col("source").alias("project"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text")
    return fl.doc_excerpts(docs).select("project", "n_docs", "excerpt")


def _calendar(lake: Lake) -> DataFrame:
    """Events as raw calendar JSON; signups have a broken start."""
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.col("event_type")
    body = F.to_json(F.struct(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
        F.when(kind == "error", F.lit("cancelled")).otherwise(F.lit("confirmed")).alias("status"),
        F.concat(F.lit("Visit "), F.col("user_id").cast("string")).alias("summary"), iso.alias("updated"),
        F.struct(F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd")).alias("date"),
                 F.when(kind == "signup", F.lit("soon")).when(kind != "view", iso).alias("dateTime"), F.when(kind == "click", F.lit("UTC")).alias("timeZone")).alias("start"),
        F.col("event_id").cast("int").alias("sequence"),
    ))
    return lake.table("events").select(body.alias("body"))


@query(
    "calendar_changes",
    """SELECT 'ev' || event_id AS external_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, epoch_ms(CAST(date_trunc('second', ts) AS TIMESTAMP)) AS recorded_at,
         'calendar-change:' || sha256('["main","ev' || event_id || '","' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"]') AS change_id
       FROM events WHERE event_type <> 'signup'""",
)
def calendar_changes(lake: Lake) -> DataFrame:
    rows, _ = fd.calendar_changes(_calendar(lake), "main", incremental=True)
    return rows.select("external_id", "kind", F.unix_millis("recorded_at").alias("recorded_at"), "change_id")


@query("calendar_broken", "SELECT 'time' AS rule, count(*) AS n FROM events WHERE event_type = 'signup'")
def calendar_broken(lake: Lake) -> DataFrame:
    return fd.calendar_changes(_calendar(lake), "main", incremental=False)[1].groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "calendar_slots",
    """SELECT 'ev' || event_id AS external_id, s AS slot_key, CASE s WHEN 'status' THEN '"confirmed"' WHEN 'summary' THEN '"Visit ' || user_id || '"' WHEN 'sequence' THEN CAST(event_id AS VARCHAR)
           WHEN 'allDay' THEN CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END
           WHEN 'timeZones' THEN '{"start":"UTC"}'
           ELSE CASE event_type WHEN 'view' THEN '{"date":"' || strftime(ts, '%Y-%m-%d') || '"}' WHEN 'click' THEN '{"dateTime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","timeZone":"UTC"}'
             ELSE '{"dateTime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' END END AS value_json
       FROM events, (VALUES ('status'), ('summary'), ('sequence'), ('allDay'), ('start'), ('timeZones')) v(s)
       WHERE event_type NOT IN ('signup', 'error') AND (s <> 'timeZones' OR event_type = 'click')""",
)
def calendar_slots(lake: Lake) -> DataFrame:
    rows, _ = fd.calendar_changes(_calendar(lake), "main", incremental=False)
    return fd.calendar_slots(rows).select("external_id", "slot_key", "value_json")


@query(
    "repo_items",
    """SELECT 'team/user-' || user_id AS project, event_id AS number, event_type || ' ' || user_id AS title,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events WHERE event_type <> 'purchase'
       QUALIFY place <= 20""",
)
def repo_items(lake: Lake) -> DataFrame:
    """Events as issue JSON; purchases are pull requests."""
    body = F.to_json(F.struct(
        F.col("event_id").alias("number"), F.concat_ws("\u0007", "event_type", F.col("user_id").cast("string")).alias("title"),
        F.when(F.col("event_type") == "purchase", F.struct(F.lit("u").alias("url"))).alias("pull_request"),
    ))
    raw = lake.table("events").select(F.concat(F.lit("team/user-"), F.col("user_id").cast("string")).alias("project"), body.alias("body"))
    return fd.repo_items(raw, 20)


@query(
    "manifest_violations",
    """SELECT 'm-' || n_nationkey AS id, f AS field, r AS rule FROM nation, (VALUES ('name', 'repeated-external', 0), ('Nation.region', 'access', 1)) v(f, r, k) WHERE n_regionkey = k""",
)
def manifest_violations(lake: Lake) -> DataFrame:
    """One manifest per nation; region 0 repeats a field, region 1 writes without the capability."""
    field = lambda c, e, a: F.struct(F.lit(c).alias("canonical"), e.alias("external"), a.alias("access"))
    read = F.array(F.lit("read"))
    body = F.to_json(F.struct(
        F.concat(F.lit("m-"), F.col("n_nationkey").cast("string")).alias("id"), read.alias("capabilities"),
        F.array(F.struct(F.lit("Nation").alias("canonicalType"), F.lit("nation").alias("externalType"), F.array(
            field("Nation.name", F.lit("name"), read),
            field("Nation.region", F.when(F.col("n_regionkey") == 0, F.lit("name")).otherwise(F.lit("region")),
                  F.when(F.col("n_regionkey") == 1, F.array(F.lit("read"), F.lit("write"))).otherwise(read)),
        ).alias("fields"))).alias("entities"),
    ))
    return fd.manifest_violations(fd.manifest_fields(lake.table("nation").select(body.alias("body"))))


@query("keyset_page", "SELECT external_id FROM (SELECT DISTINCT external_id FROM artifact_mutations) WHERE external_id > 'm' ORDER BY external_id LIMIT 11")
def keyset_page(lake: Lake) -> DataFrame:
    return fd.keyset_page(lake.artifact_mutations().select("external_id").distinct(), "external_id", "m", 10)


@query(
    "byte_bounded_pages",
    """SELECT leaf, key, page FROM folded WHERE key IS NOT NULL""",
    {
        **_views(8),
        "placed": "SELECT leaf, key, payload_bytes AS b, row_number() OVER (PARTITION BY leaf ORDER BY key) AS rn FROM left_desc",
        "folded": """RECURSIVE
            SELECT DISTINCT leaf, CAST(0 AS BIGINT) AS rn, 0 AS page, 0 AS n, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS key FROM left_desc
            UNION ALL
            SELECT f.leaf, p.rn, CASE WHEN f.page > 0 AND f.n < 4 AND f.bytes + p.b <= 180 THEN f.page ELSE f.page + 1 END,
              CASE WHEN f.page > 0 AND f.n < 4 AND f.bytes + p.b <= 180 THEN f.n + 1 ELSE 1 END,
              CASE WHEN f.page > 0 AND f.n < 4 AND f.bytes + p.b <= 180 THEN f.bytes + p.b ELSE p.b END, p.key
            FROM folded f JOIN placed p ON p.leaf = f.leaf AND p.rn = f.rn + 1""",
    },
)
def byte_bounded_pages(lake: Lake) -> DataFrame:
    rows = _left(lake).withColumn("leaf", mk.leaf_id(F.col("key"), 8))
    return fd.byte_bounded_pages(rows, ["leaf"], "key", "payload_bytes", 4, 180)


@query(
    "entities_scoped",
    """SELECT * FROM (WITH asked AS (SELECT 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_acctbal < 0),
         said AS (SELECT observation_id, entity_id FROM observations JOIN asked USING (entity_id)),
         tied AS (SELECT relation_id FROM relations JOIN asked ON entity_id = from_id)
       SELECT 'entity' AS kind, entity_id AS record_id FROM entities JOIN asked USING (entity_id)
       UNION ALL SELECT 'alias', alias_id FROM aliases JOIN asked USING (entity_id)
       UNION ALL SELECT 'observation', observation_id FROM said
       UNION ALL SELECT 'relation', relation_id FROM tied
       UNION ALL SELECT 'retraction', retraction_id FROM retractions r JOIN said ON observation_id = target_id
       UNION ALL SELECT 'retraction', retraction_id FROM relation_retractions JOIN tied ON relation_id = target_id)""",
)
def entities_scoped(lake: Lake) -> DataFrame:
    """The records of asked entities (customers in debt), of all five kinds."""
    asked = _customer(lake).filter("c_acctbal < 0").select("entity_id")
    return tp.scoped(
        asked, lake.entities(), lake.aliases(), lake.observations(), lake.relations(), lake.retractions().unionByName(lake.relation_retractions())
    )


@query(
    "normalized_text",
    """SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens FROM documents""",
)
def normalized_text(lake: Lake) -> DataFrame:
    """P1 to P4 over whole texts."""
    docs = lake.table("documents")
    return docs.select("doc_id", tx.normalize(F.col("text")).alias("norm"), tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "canonical_values",
    """SELECT event_id, '{"a":{"b":' || json_extract_string(props, '$.k') || '},"z":"' || event_type || '"}' AS canonical, json_extract_string(props, '$.k') AS at_path FROM events""",
)
def canonical_values(lake: Lake) -> DataFrame:
    """Key order and number spelling do not matter; values are found by pointer."""
    k = F.get_json_object("props", "$.k")
    loose = F.concat(F.lit('{"z": "'), F.col("event_type"), F.lit('", "a": {"b": '), k, F.lit(".0}}"))
    return lake.table("events").select("event_id", vl.canonical_json(loose).alias("canonical"), fl.value_at(vl.canonical_json(loose), F.lit("/a/b")).alias("at_path"))


@query("property_labels", """SELECT DISTINCT o.property, coalesce(t.label, replace(o.property, '.', ' ')) AS label FROM observations o LEFT JOIN property_texts t USING (property)""")
def property_labels(lake: Lake) -> DataFrame:
    """P5, P6."""
    used = lake.observations().select("property").distinct()
    return used.join(lake.property_descriptors(), "property", "left").select(
        "property", tx.property_label(F.col("property"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("label")
    )


# -- streams ----------------------------------------------------------------------------------


def _stream(lake: Lake, name: str) -> DataFrame:
    return lake.spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(lake.root)


class _Streamed(Lake):
    """The same adapters over streaming reads of chosen tables."""

    def table(self, name: str) -> DataFrame:
        return _stream(self, name)


def _landed_changes(lake: Lake) -> str:
    """All changes, landed in three parts with a run of the stream after each; the stream's folder."""
    out, landed = run_dir(lake.spark, "ingest"), run_dir(lake.spark, "landed")
    cut = lake.source_changes().withColumn("part", F.when(F.col("first_observed_at") < "2024-01-10", 0).when(F.col("first_observed_at") < "2024-01-20", 1).otherwise(2))
    for part in range(3):
        cut.filter(F.col("part") == part).drop("part").write.json(f"{landed}/{part}")
        keyed.slot_stream(lake.spark, fd.read_source(lake.spark, f"{landed}/*", "incremental"), SLOTS, out).awaitTermination()
    return out


@query("stream_ingest", "SELECT retraction_id, record_id AS target_id, change_id FROM lost", INGEST)
def stream_ingest(lake: Lake) -> DataFrame:
    """Three landings, three runs: the retractions of all of them, from keyed state."""
    events = lake.spark.read.parquet(f"{_landed_changes(lake)}/events")
    return keyed.retractions(events).select("retraction_id", "target_id", "change_id")


@query(
    "stream_open_slots",
    """SELECT source_key, external_type, external_id, slot_key, record_id FROM slot_rows
       WHERE (external_id, pos) IN (SELECT external_id, max(pos) FROM received GROUP BY 1)""",
    INGEST,
)
def stream_open_slots(lake: Lake) -> DataFrame:
    """What is open after all runs, read from the state store."""
    return keyed.open_slots(lake.spark, _landed_changes(lake)).drop("opened_by")


BOUNDARIES = {
    "edges_in_time": """
        SELECT entity_id, recorded_at AS b FROM aliases
        UNION ALL SELECT entity_id, unnest([greatest(valid_from, recorded_at), valid_to]) FROM observations WHERE valid_to IS NULL OR greatest(valid_from, recorded_at) < valid_to
        UNION ALL SELECT from_id, unnest([greatest(valid_from, recorded_at), valid_to]) FROM relations WHERE valid_to IS NULL OR greatest(valid_from, recorded_at) < valid_to
        UNION ALL SELECT o.entity_id, greatest(r.effective_from, r.recorded_at) FROM retractions r JOIN observations o ON o.observation_id = r.target_id WHERE o.valid_to IS NULL OR r.effective_from < o.valid_to
        UNION ALL SELECT e.from_id, greatest(r.effective_from, r.recorded_at) FROM relation_retractions r JOIN relations e ON e.relation_id = r.target_id WHERE e.valid_to IS NULL OR r.effective_from < e.valid_to""",
    "clocks": "SELECT * FROM (VALUES (962323200000, 962496000000), (962496000000, 963100800000)) t(before, clock)",
}


@query(
    "stream_boundary_refresh",
    """SELECT clock, entity_id, min(b) FILTER (b > clock) AS next_boundary FROM edges_in_time, clocks
       GROUP BY 1, 2 HAVING bool_or(b > before AND b <= clock)""",
    BOUNDARIES,
)
def stream_boundary_refresh(lake: Lake) -> DataFrame:
    """Capsules rebuilt at two clocks because their time had come; no record arrives in between.

    Relations are derived, and retractions meet their targets, once for all clocks."""
    spark, tables = lake.spark, _tables(lake)
    tables["relations"] = written(tables["relations"].drop("evidence_refs"), "relations")
    ended = tp.retracted(tables["observations"], tables["relations"], tables["retractions"])
    out, feed = run_dir(spark, "boundaries"), run_dir(spark, "heads")
    at = F.lit(AT).cast("timestamp")
    first = tp.next_boundary(tables["aliases"], tables["observations"], tables["relations"], tables["retractions"], at, ended)
    first.select("entity_id", F.col("next_boundary").alias("boundary"), at.alias("at")).write.parquet(f"{feed}/0")
    heads = spark.readStream.schema("entity_id string, boundary timestamp, at timestamp").parquet(f"{feed}/*")
    ticks = spark.readStream.schema("at timestamp").parquet(f"{out}/ticks/*")
    spark.range(1).select(at.alias("at")).write.parquet(f"{out}/ticks/0")
    refreshed = []
    for turn, clock in enumerate(("2000-07-02", "2000-07-09"), 1):
        now = F.lit(clock).cast("timestamp")

        def refresh(due: DataFrame, batch_id: int, clock: str = clock, now=now) -> None:
            none = spark.createDataFrame([], jobs.HEAD_SCHEMA)
            with passing(spark):
                fresh = none if due.isEmpty() else cp.materialize(tables, clock, only=due, ended=ended)[1].select(*none.columns)
                fresh.withColumn("clock", F.unix_millis(now)).write.mode("overwrite").parquet(f"{out}/capsules/batch={batch_id}")

        spark.range(1).select(now.alias("at")).write.parquet(f"{out}/ticks/{turn}")
        keyed.boundary_stream(spark, heads, ticks, refresh, out).awaitTermination()
        fresh = spark.read.parquet(f"{out}/capsules").filter(F.col("clock") == F.unix_millis(now))
        # The next run has to see the new boundaries as later than the clock that made them.
        fresh.select("entity_id", F.col("next_boundary").alias("boundary"), (now + F.expr("INTERVAL 1 MILLISECOND")).alias("at")).write.parquet(f"{feed}/{turn}")
        refreshed.append(fresh.select("clock", "entity_id", F.unix_millis("next_boundary").alias("next_boundary")))
    return refreshed[0].unionByName(refreshed[1])


@query("stream_capsules", "SELECT CAST(0 AS BIGINT) AS n_different, (SELECT count(DISTINCT entity_id) FROM observations WHERE entity_id LIKE 'entity://customer/%') AS n_capsules")
def stream_capsules(lake: Lake) -> DataFrame:
    """Orders as the feed: capsules of touched customers equal a build from scratch."""
    out = run_dir(lake.spark, "capsules")
    feed = _Streamed(lake.spark, lake.root).order_observations().select(F.col("entity_id").alias("primary_entity_id"))
    jobs.capsule_stream(lake.spark, feed, _tables(lake), AT, out).awaitTermination()
    from lakestate.operators import capsule as cp

    full = cp.materialize(_tables(lake), AT)[1].select("entity_id", F.col("material_digest").alias("d"))
    return jobs.current_capsules(lake.spark, out).join(full, "entity_id", "left").agg(
        F.sum((~F.col("material_digest").eqNullSafe(F.col("d"))).cast("bigint")).alias("n_different"), F.count(F.lit(1)).alias("n_capsules")
    )


@query(
    "stream_audit",
    """SELECT epoch_ms(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS window_start, operation, outcome, code, count(*) AS n
       FROM (SELECT make_timestamp(at_ms * 1000) AS ts, * FROM access_events)
       WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(make_timestamp(at_ms * 1000)) - INTERVAL 10 MINUTE FROM access_events) GROUP BY 1, 2, 3, 4""",
)
def stream_audit(lake: Lake) -> DataFrame:
    """Counts of closed windows only."""
    out = run_dir(lake.spark, "audit")
    jobs.audit_stream(_Streamed(lake.spark, lake.root).access_events(), out).awaitTermination()
    rows = lake.spark.read.parquet(f"{out}/rows")
    return rows.withColumn("window_start", F.unix_millis("window_start"))


@query("stream_dedupe", "SELECT DISTINCT mutation_id FROM journal_events")
def stream_dedupe(lake: Lake) -> DataFrame:
    """One landed file is one batch, so a nonce is remembered throughout."""
    out = run_dir(lake.spark, "dedupe")
    stream = _Streamed(lake.spark, lake.root).journal_events().select("mutation_id", "occurred_at")
    jobs.dedupe_stream(stream, "mutation_id", "occurred_at", "1 day", out).awaitTermination()
    return lake.spark.read.parquet(f"{out}/rows").select("mutation_id")


@query(
    "stream_unfinished",
    """SELECT mutation_id, epoch_ms(occurred) AS requested_at FROM journal v,
         (SELECT least(max(occurred) FILTER (WHERE asked), max(occurred) FILTER (WHERE NOT asked)) - INTERVAL 1 MINUTE AS closed FROM journal)
       WHERE asked AND occurred + INTERVAL 1 HOUR < closed AND NOT EXISTS (
         SELECT 1 FROM journal d WHERE NOT d.asked AND d.mutation_id = v.mutation_id AND d.occurred BETWEEN v.occurred AND v.occurred + INTERVAL 1 HOUR)""",
    {"journal": """SELECT concat_ws(':', user_id, json_extract_string(props, '$.k')) AS mutation_id, event_type = 'view' AS asked, date_trunc('millisecond', ts) AS occurred
       FROM events WHERE event_type IN ('view', 'click', 'error')"""},
)
def stream_unfinished(lake: Lake) -> DataFrame:
    """Requests unanswered for an hour of event time, once no late answer can come."""
    out = run_dir(lake.spark, "unfinished")
    jobs.unfinished_stream(_Streamed(lake.spark, lake.root).journal_events(), "1 HOUR", out).awaitTermination()
    return lake.spark.read.parquet(f"{out}/rows").select("mutation_id", F.unix_millis("requested_at").alias("requested_at"))
