"""Queries over validation, write-back plans, feeds, capsules, documents and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions import values as vl
from lakestate.operators import append as ap
from lakestate.operators import artifact as af
from lakestate.operators import capsule as cp
from lakestate.operators import ingest as ig
from lakestate.operators import journal as jn
from lakestate.operators import plan as pl
from lakestate.operators import recordset as xs
from lakestate.operators import resolve as rs
from lakestate.operators import temporal as tp
from lakestate.operators import validate as va
from lakestate.plans.registry import query
from lakestate.sources.adapters import Lake
from lakestate.session import passing, pinned

# -- write-back ------------------------------------------------------------------

PLAN = {
    "bindings": """
        SELECT 'entity://customer/' || c_custkey AS entity_id, provider, CAST(c_custkey AS VARCHAR) AS external_id, canonical, external, readable, writable
        FROM customer, (VALUES ('crm', 'Customer.segment', 'segment', true, false), ('crm', 'Customer.nation', 'nation', true, true),
          ('billing', 'Customer.segment', 'segment', true, true), ('billing', 'Customer.nation', 'nation', true, true)) v(provider, canonical, external, readable, writable)""",
    "snapshots": """
        SELECT 'entity://customer/' || c_custkey AS entity_id, provider, CAST(c_custkey AS VARCHAR) AS external_id, external, value_json, 'r1' AS revision, observed_at FROM (
          SELECT c_custkey, 'crm' AS provider, 'segment' AS external, '"' || c_mktsegment || '"' AS value_json, 2 AS observed_at FROM customer
          UNION ALL SELECT c_custkey, 'crm', 'nation', '"NATION_' || c_nationkey || '"', 2 FROM customer
          UNION ALL SELECT c_custkey, 'billing', 'segment', CASE WHEN c_acctbal < 0 THEN '"HOUSEHOLD"' ELSE '"' || c_mktsegment || '"' END,
            CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END FROM customer
          UNION ALL SELECT c_custkey, 'billing', 'nation', '"NATION_' || c_nationkey || '"', 1 FROM customer WHERE c_acctbal >= 0)""",
    "cand": """
        SELECT s.*, b.canonical AS property, CASE WHEN b.canonical = 'Customer.segment' AND c.c_nationkey < 10 THEN CASE WHEN s.provider = 'crm' THEN 1 END ELSE 0 END AS rank
        FROM snapshots s JOIN bindings b USING (entity_id, provider, external_id, external) JOIN customer c ON c.c_custkey = CAST(s.external_id AS BIGINT)""",
    "newest": "SELECT * FROM cand WHERE rank IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY entity_id, property ORDER BY rank, observed_at DESC) = 1",
    "resolved": """
        SELECT entity_id, property, CASE WHEN count(DISTINCT value_json) = 1 THEN 'resolved' ELSE 'conflict' END AS status,
          CASE WHEN count(DISTINCT value_json) = 1 THEN min(value_json) END AS value_json FROM newest GROUP BY 1, 2""",
    "moves": """
        SELECT b.entity_id, b.provider, b.external_id, b.external, r.property, r.value_json AS next_json, s.value_json AS previous_json, s.revision AS base_revision
        FROM resolved r JOIN bindings b ON b.entity_id = r.entity_id AND b.canonical = r.property AND b.writable
        LEFT JOIN snapshots s ON s.entity_id = b.entity_id AND s.provider = b.provider AND s.external = b.external
        WHERE r.status = 'resolved' AND r.value_json IS DISTINCT FROM s.value_json""",
    "plans": """
        SELECT e.entity_id, (SELECT count(*) FROM moves m WHERE m.entity_id = e.entity_id) AS n_mutations,
          (SELECT count(*) FROM resolved r WHERE r.entity_id = e.entity_id AND r.status = 'conflict') AS n_conflicts
        FROM (SELECT DISTINCT entity_id FROM bindings) e""",
    "materials": """
        SELECT entity_id, sha256(CAST(to_json(['mutation', provider, external_id, external, property, next_json, previous_json, base_revision]) AS VARCHAR)) AS h FROM moves
        UNION ALL
        SELECT n.entity_id, sha256(CAST(to_json(['conflict', n.property, CASE WHEN n.rank = 0 THEN 'ambiguous-freshest' ELSE 'ambiguous-authority' END,
          n.provider, n.external_id, n.value_json]) AS VARCHAR)) FROM newest n JOIN resolved r USING (entity_id, property) WHERE r.status = 'conflict'""",
    "digests": """
        SELECT entity_id, sha256(string_agg(d, '' ORDER BY s)) AS digest FROM (
          SELECT entity_id, left(h, 4) AS s, sha256(string_agg(h, '' ORDER BY h)) AS d FROM materials GROUP BY 1, 2) GROUP BY 1""",
}


def _bindings(lake: Lake) -> DataFrame:
    spec = [("crm", "Customer.segment", "segment", True, False), ("crm", "Customer.nation", "nation", True, True),
            ("billing", "Customer.segment", "segment", True, True), ("billing", "Customer.nation", "nation", True, True)]
    names = ["provider", "canonical", "external", "readable", "writable"]
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in spec])
    key = F.col("c_custkey").cast("string")
    return lake.table("customer").withColumn("b", F.explode(each)).select(
        F.concat(F.lit("entity://customer/"), key).alias("entity_id"), key.alias("external_id"), "b.*"
    )


def _snapshots(lake: Lake) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    owes = F.col("c_acctbal") < 0
    late, early = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    nation = quoted(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    row = lambda p, e, v, t: F.struct(F.lit(p).alias("provider"), F.lit(e).alias("external"), v.alias("value_json"), t.alias("observed_at"))
    each = F.array(
        row("crm", "segment", quoted(F.col("c_mktsegment")), late),
        row("crm", "nation", nation, late),
        row("billing", "segment", F.when(owes, F.lit('"HOUSEHOLD"')).otherwise(quoted(F.col("c_mktsegment"))), F.when(owes, late).otherwise(early)),
        row("billing", "nation", F.when(~owes, nation), early),
    )
    key = F.col("c_custkey").cast("string")
    return lake.table("customer").withColumn("s", F.explode(each)).filter("s.value_json IS NOT NULL").select(
        F.concat(F.lit("entity://customer/"), key).alias("entity_id"), key.alias("external_id"), F.lit("r1").alias("revision"), "s.*"
    )


def _rules(lake: Lake) -> DataFrame:
    return lake.table("customer").filter("c_nationkey < 10").select(
        F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"),
        F.lit("Customer.segment").alias("property"), F.lit("provider").alias("kind"), F.array(F.lit("crm")).alias("providers"),
    )


def _planned(
    lake: Lake, snapshots: DataFrame | None = None, bindings: DataFrame | None = None, keep: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Mutations and proposals; written, if both are to be kept."""
    snapshots = _snapshots(lake) if snapshots is None else snapshots
    bindings = _bindings(lake) if bindings is None else bindings
    cands = pinned(rs.candidates_from_snapshots(snapshots, bindings))
    resolved = pinned(rs.resolve(cands, _rules(lake), pl.KEYS))
    moves = pl.mutations(resolved.filter("status = 'resolved'"), snapshots, bindings)
    moves = pinned(moves) if keep else moves
    told = pl.proposals(bindings, moves, resolved, rs.conflict_candidates(resolved, cands, pl.KEYS))
    return moves, pinned(told) if keep else told


def _moves(lake: Lake, snapshots: DataFrame | None = None) -> DataFrame:
    return _planned(lake, snapshots)[0]


def _proposals(lake: Lake, snapshots: DataFrame | None = None, bindings: DataFrame | None = None) -> DataFrame:
    return _planned(lake, snapshots, bindings)[1]


def _changed(lake: Lake, who: str, column: str, value: str) -> DataFrame:
    """Snapshots in which billing's segment of some customers has another value or revision."""
    ids = lake.table("customer").filter(who).select(F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit(True).alias("hit"))
    hit = F.col("hit") & (F.col("provider") == "billing") & (F.col("external") == "segment")
    return _snapshots(lake).join(ids, "entity_id", "left").withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column))).drop("hit")


@query("snapshot_resolution", "SELECT entity_id, property, status, value_json FROM resolved", PLAN)
def snapshot_resolution(lake: Lake) -> DataFrame:
    return pl.resolve_snapshots(_snapshots(lake), _bindings(lake), _rules(lake)).select("entity_id", "property", "status", "value_json")


@query("writeback_mutations", "SELECT entity_id, provider, external, next_json, previous_json FROM moves", PLAN)
def writeback_mutations(lake: Lake) -> DataFrame:
    return _moves(lake).select("entity_id", "provider", "external", "next_json", "previous_json")


@query(
    "writeback_proposals",
    """SELECT entity_id, n_mutations, n_conflicts, coalesce(digest, sha256('')) AS digest,
         CASE WHEN n_conflicts > 0 THEN 'blocked' WHEN n_mutations = 0 THEN 'noop' ELSE 'ready' END AS status FROM plans LEFT JOIN digests USING (entity_id)""",
    PLAN,
)
def writeback_proposals(lake: Lake) -> DataFrame:
    return _proposals(lake)


@query(
    "writeback_drift",
    """SELECT 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_acctbal < 0""",
)
def writeback_drift(lake: Lake) -> DataFrame:
    """Plans made before and after billing learned the nation of debtors."""
    before = pinned(_proposals(lake))
    key = F.col("c_custkey").cast("string")
    learned = lake.table("customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("entity://customer/"), key).alias("entity_id"), key.alias("external_id"), F.lit("r1").alias("revision"),
        F.lit("billing").alias("provider"), F.lit("nation").alias("external"),
        F.concat(F.lit('"NATION_'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("value_json"),
        F.lit("2024-01-01").cast("timestamp").alias("observed_at"),
    )
    after = _proposals(lake, _snapshots(lake).unionByName(learned))
    return pl.plan_drift(before, after).select("entity_id")


@query(
    "writeback_drift_revision",
    """SELECT 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_acctbal < 0 AND c_nationkey < 10 AND c_mktsegment <> 'HOUSEHOLD'""",
)
def writeback_drift_revision(lake: Lake) -> DataFrame:
    """Billing's segment got a new revision; plans that would overwrite it no longer hold."""
    return pl.plan_drift(pinned(_proposals(lake)), _proposals(lake, _changed(lake, "true", "revision", "r9"))).select("entity_id")


@query(
    "writeback_drift_candidate",
    """SELECT 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_acctbal < 0 AND c_nationkey >= 10 AND c_mktsegment <> 'HOUSEHOLD'""",
)
def writeback_drift_candidate(lake: Lake) -> DataFrame:
    """One candidate of each conflict got another value; the conflict stays."""
    who = "c_acctbal < 0 AND c_nationkey >= 10 AND c_mktsegment <> 'HOUSEHOLD'"
    return pl.plan_drift(pinned(_proposals(lake)), _proposals(lake, _changed(lake, who, "value_json", '"OTHER"'))).select("entity_id")


@query("writeback_drift_vanished", "SELECT 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_nationkey = 3")
def writeback_drift_vanished(lake: Lake) -> DataFrame:
    """The bindings of one nation's customers are gone."""
    gone = lake.table("customer").filter("c_nationkey = 3").select(F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"))
    after = _proposals(lake, bindings=_bindings(lake).join(gone, "entity_id", "left_anti"))
    return pl.plan_drift(pinned(_proposals(lake)), after).select("entity_id")


@query(
    "writeback_convergence",
    """SELECT entity_id, CASE WHEN n_conflicts > 0 THEN 'blocked' WHEN n_mutations = 0 THEN 'noop' ELSE 'converged' END AS outcome FROM plans""",
    PLAN,
)
def writeback_convergence(lake: Lake) -> DataFrame:
    """Apply every mutation to the snapshots and plan again."""
    moves, before = _planned(lake, keep=True)
    ready = moves.join(before.filter("status = 'ready'").select("entity_id"), "entity_id", "left_semi")
    after = pinned(pl.apply_mutations(_snapshots(lake), ready, "r2"))
    return pl.outcomes(before, _moves(lake, after))


OUTCOMES = """SELECT p.entity_id, CASE WHEN n_conflicts > 0 THEN 'blocked' WHEN n_mutations = 0 THEN 'noop'
         WHEN c_acctbal < 0 AND c_nationkey < 10 AND c_mktsegment <> 'HOUSEHOLD' THEN 'drifted' ELSE '{last}' END AS outcome
       FROM plans p JOIN customer c ON p.entity_id = 'entity://customer/' || c_custkey"""


def _outcomes_after_drift(lake: Lake, dry_run: bool) -> DataFrame:
    """Billing's segments got a new revision between plan and application."""
    moves, before = _planned(lake, keep=True)
    later = pinned(_changed(lake, "true", "revision", "r9"))
    drifted = pinned(pl.plan_drift(before, _proposals(lake, later)))
    steady = before.filter("status = 'ready'").join(drifted, "entity_id", "left_anti").select("entity_id")
    ready = moves.join(steady, "entity_id", "left_semi")
    ready = ready if dry_run else pinned(ready)
    if pl.stale_mutations(ready, later).limit(1).count():
        raise AssertionError("a steady plan builds on a revision that is gone")
    # A dry run changes nothing, so there is nothing to plan anew.
    left_over = None if dry_run else _moves(lake, pinned(pl.apply_mutations(later, ready, "r10")))
    return pl.outcomes(before, left_over, drifted, dry_run)


@query("writeback_outcomes", OUTCOMES.format(last="converged"), PLAN)
def writeback_outcomes(lake: Lake) -> DataFrame:
    return _outcomes_after_drift(lake, False)


@query("writeback_dry_run", OUTCOMES.format(last="dry-run"), PLAN)
def writeback_dry_run(lake: Lake) -> DataFrame:
    return _outcomes_after_drift(lake, True)


@query("foreign_snapshots", "SELECT 'entity://customer/' || c_custkey AS entity_id FROM customer WHERE c_nationkey >= 20")
def foreign_snapshots(lake: Lake) -> DataFrame:
    """Bindings of the first twenty nations only."""
    near = lake.table("customer").filter("c_nationkey < 20").select(
        F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id")
    )
    return pl.foreign_snapshots(_snapshots(lake), _bindings(lake).join(near, "entity_id", "left_semi")).select("entity_id").distinct()


@query("sanitized_snapshots", "SELECT entity_id, provider, external FROM snapshots WHERE external = 'nation'", PLAN)
def sanitized_snapshots(lake: Lake) -> DataFrame:
    shut = _bindings(lake).withColumn("readable", F.col("external") == "nation")
    return pl.sanitize(_snapshots(lake), shut).select("entity_id", "provider", "external")


# -- validation ---------------------------------------------------------------------


def _raw_observations(lake: Lake) -> DataFrame:
    """Events as unchecked rows, faulty by kind of event."""
    kind = F.col("event_type")
    iso = vl.iso_ms(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return lake.table("events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("observation_id"),
        F.concat(F.when(kind == "signup", F.lit("user/")).otherwise(F.lit("entity://user/")), F.col("user_id").cast("string")).alias("entity_id"),
        F.lit("User.k").alias("property"), F.lit("s").alias("provider"), F.lit("x").alias("external_id"),
        F.when(kind == "purchase", F.lit("{broken")).otherwise(F.col("props")).alias("value_json"),
        iso.alias("valid_from"), F.when(kind == "view", iso).alias("valid_to"),
        F.when(kind == "error", F.lit("yesterday")).otherwise(iso).alias("recorded_at"),
    )


@query(
    "record_violations",
    """SELECT 'e' || event_id AS id, CASE event_type WHEN 'signup' THEN 'entity-id' WHEN 'purchase' THEN 'value' WHEN 'view' THEN 'interval' ELSE 'recorded-at' END AS rule
       FROM events WHERE event_type <> 'click'""",
)
def record_violations(lake: Lake) -> DataFrame:
    return va.violations("observation", _raw_observations(lake), "observation_id")


@query("valid_records", "SELECT 'e' || event_id AS observation_id FROM events WHERE event_type = 'click'")
def valid_records(lake: Lake) -> DataFrame:
    return va.valid("observation", _raw_observations(lake)).select("observation_id")


@query(
    "duplicate_ids",
    """SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_ids(lake: Lake) -> DataFrame:
    rows = lake.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))
    return va.duplicate_ids(rows, "line_id")


@query(
    "identity_violations",
    """SELECT 'entity://customer/' || c_custkey AS id, 'no-alias' AS rule FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'place-customer-' || c_custkey, 'unknown-to' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0
       UNION ALL SELECT 'place-supplier-' || s_suppkey, 'unknown-to' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0
       UNION ALL SELECT 'place-nation-' || n_nationkey, 'unknown-from' FROM nation WHERE n_regionkey = 0
       UNION ALL SELECT 'entity://region/' || r_regionkey, 'unknown-type' FROM region""",
)
def identity_violations(lake: Lake) -> DataFrame:
    """Debtors lost their name, region 0 lost its nations, the region type is gone."""
    gone = lake.table("nation").filter("n_regionkey = 0").select(F.concat(F.lit("entity://nation/"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    owes = lake.table("customer").filter("c_acctbal < 0").select(F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return va.identity_violations(
        lake.entities().join(gone, "entity_id", "left_anti"), lake.aliases().join(owes, "entity_id", "left_anti"),
        lake.entity_types().filter("type_id <> 'Region'"), lake.relations(), lake.relation_types(),
    )


@query(
    "artifact_violations",
    """SELECT mutation_id AS id, 'digest' AS rule FROM artifact_mutations WHERE kind = 'upsert' AND title LIKE 'T%'""",
)
def artifact_violations(lake: Lake) -> DataFrame:
    """Digests of titles in T are cut short."""
    rows = lake.artifact_mutations().withColumn(
        "blob_digest", F.when(F.col("title").startswith("T"), F.substring("blob_digest", 1, 63)).otherwise(F.col("blob_digest"))
    ).withColumn("title", F.when(F.col("title").rlike(r"\S"), F.col("title")))
    return va.violations("artifact", rows, "mutation_id")


@query("journal_violations", "SELECT 'j-' || event_id AS id, 'type' AS rule FROM events WHERE event_type = 'error'")
def journal_violations(lake: Lake) -> DataFrame:
    rows = lake.journal_events().withColumn("type", F.regexp_replace("type", "^mutation.failed$", "mutation.lost"))
    return va.violations("journal", rows, "event_id")


# -- append and feed -----------------------------------------------------------------


def _payloads(lake: Lake, replica: str) -> DataFrame:
    return lake.order_payloads(replica)


@query(
    "append_classify",
    """SELECT 'observation' AS kind, r.record_id, CASE WHEN l.key IS NULL THEN 'inserted' WHEN l.payload = r.payload THEN 'unchanged' ELSE 'collision' END AS action
       FROM right_records r LEFT JOIN left_records l USING (key)""",
)
def append_classify(lake: Lake) -> DataFrame:
    return ap.classify(_payloads(lake, "right"), _payloads(lake, "left")).select("kind", "record_id", "action")


@query(
    "append_publish",
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT record_id) AS BIGINT) AS n_ids FROM (SELECT record_id FROM left_records UNION SELECT record_id FROM right_records WHERE record_id LIKE '%/copy')",
)
def append_publish(lake: Lake) -> DataFrame:
    """Two batches and a replay: written, published, read back."""
    from lakestate.session import run_dir

    root = run_dir(lake.spark, "append")
    copies = _payloads(lake, "right").filter(F.col("record_id").endswith("/copy"))
    ap.append_batch(lake.spark, root, "b1", _payloads(lake, "left"))
    ap.append_batch(lake.spark, root, "b2", copies)
    ap.append_batch(lake.spark, root, "b3", copies)
    rows = ap.read_published(lake.spark, root, copies.schema)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_ids"))


@query(
    "append_unknown_refs",
    """SELECT observation_id AS id, entity_id, 'observation-entity' AS rule FROM observations
         WHERE entity_id IN (SELECT 'entity://customer/' || c_custkey FROM customer WHERE c_acctbal < 0)
       UNION ALL SELECT 'alias-0-entity://customer/' || c_custkey, 'entity://customer/' || c_custkey, 'alias-entity' FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'place-customer-' || c_custkey, 'entity://customer/' || c_custkey, 'relation-from' FROM customer WHERE c_acctbal < 0""",
)
def append_unknown_refs(lake: Lake) -> DataFrame:
    """The same batch against a base that lacks the debtors."""
    owes = lake.table("customer").filter("c_acctbal < 0").select(F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return ap.unknown_refs(lake.observations(), lake.aliases(), lake.relations(), lake.entities().join(owes, "entity_id", "left_anti"))


def _feed_rows(lake: Lake) -> DataFrame:
    return (
        lake.entities().select(F.lit("entity").alias("kind"), F.col("entity_id").alias("record_id"), F.col("entity_id").alias("primary_entity_id"))
        .unionByName(lake.aliases().select(F.lit("alias").alias("kind"), F.col("alias_id").alias("record_id"), F.col("entity_id").alias("primary_entity_id")))
        .unionByName(lake.observations().select(F.lit("observation").alias("kind"), F.col("observation_id").alias("record_id"), F.col("entity_id").alias("primary_entity_id")))
        .unionByName(lake.relations().select(F.lit("relation").alias("kind"), F.col("relation_id").alias("record_id"), F.col("from_id").alias("primary_entity_id")))
        .unionByName(ap.retraction_changes(lake.retractions().unionByName(lake.relation_retractions()), lake.observations(), lake.relations()))
    )


FEED = {
    "feed": """
        SELECT kind, record_id, primary_entity_id, 1000 + row_number() OVER (ORDER BY o, record_id, primary_entity_id) AS seq FROM (
          SELECT 1 AS o, 'entity' AS kind, entity_id AS record_id, entity_id AS primary_entity_id FROM entities
          UNION ALL SELECT 2, 'alias', alias_id, entity_id FROM aliases
          UNION ALL SELECT 3, 'observation', observation_id, entity_id FROM observations
          UNION ALL SELECT 4, 'relation', relation_id, from_id FROM relations
          UNION ALL SELECT 5, 'retraction', retraction_id, o.entity_id FROM retractions r JOIN observations o ON o.observation_id = r.target_id
          UNION ALL SELECT 5, 'retraction', retraction_id, unnest([e.from_id, e.to_id]) FROM relation_retractions r JOIN relations e ON e.relation_id = r.target_id)"""
}


@query("feed_numbers", "SELECT kind, record_id, primary_entity_id, seq FROM feed", FEED)
def feed_numbers(lake: Lake) -> DataFrame:
    return ap.emit_changes(_feed_rows(lake), 1000)


@query("feed_page", "SELECT kind, record_id, seq FROM feed WHERE seq > 1200 ORDER BY seq LIMIT 256", FEED)
def feed_page(lake: Lake) -> DataFrame:
    return ap.emit_page(_feed_rows(lake), 1000, 1200, 256).select("kind", "record_id", "seq")


@query("bootstrap_view", "SELECT entity_id, (SELECT max(seq) FROM feed) AS change_seq FROM entities", FEED)
def bootstrap_view(lake: Lake) -> DataFrame:
    return ap.bootstrap_view(lake.entities(), ap.emit_changes(_feed_rows(lake), 1000))


# -- ingestion ------------------------------------------------------------------------

SLOTS = {"k": "get_json_object(props, '$.k')", "band": "cast(floor(amount / 25) as string)", "type": "event_type"}
INGEST = {
    "received": """
        SELECT *, coalesce(effective_at, recorded_at, first_observed_at) AS eff, coalesce(recorded_at, first_observed_at) AS rec,
          row_number() OVER (PARTITION BY source_key, external_type, external_id ORDER BY ord) AS pos FROM source_changes""",
    "slot_rows": """
        SELECT source_key, external_type, external_id, pos, change_id, slot_key, value,
          'observation:' || sha256('["' || source_key || '","' || external_type || '","' || external_id || '","' || slot_key || '","' || value || '"]') AS record_id
        FROM (
          SELECT *, 'k' AS slot_key, json_extract_string(props, '$.k') AS value FROM received WHERE kind = 'upsert'
          UNION ALL SELECT *, 'band', CAST(CAST(floor(amount / 25) AS BIGINT) AS VARCHAR) FROM received WHERE kind = 'upsert'
          UNION ALL SELECT *, 'type', event_type FROM received WHERE kind = 'upsert') WHERE value IS NOT NULL""",
    "lost": """
        SELECT r.source_key, r.external_id, r.change_id, p.slot_key, p.record_id, r.eff, r.rec,
          'retraction:' || sha256('["' || p.source_key || '","' || p.external_type || '","' || p.external_id || '","' || p.slot_key || '","' || p.record_id || '","' || r.change_id || '"]') AS retraction_id
        FROM received r JOIN slot_rows p ON p.external_id = r.external_id AND p.pos = r.pos - 1
        WHERE NOT EXISTS (SELECT 1 FROM slot_rows n WHERE n.external_id = r.external_id AND n.pos = r.pos AND n.slot_key = p.slot_key AND n.record_id = p.record_id)""",
}


def _ordered(lake: Lake) -> DataFrame:
    return ig.in_order(ig.receipts(lake.source_changes()))


@query("change_receipts", "SELECT change_id, eff AS effective_at, rec AS recorded_at, pos AS ordinal FROM received", INGEST)
def change_receipts(lake: Lake) -> DataFrame:
    """Clocks stamped once, positions within each resource."""
    return _ordered(lake).select(
        "change_id", F.unix_millis("effective_at").alias("effective_at"), F.unix_millis("recorded_at").alias("recorded_at"), "ordinal"
    )


@query(
    "change_collisions",
    """SELECT 'crm' AS source_key, 'h-' || day(ts) || '-' || hour(ts) AS change_id, count(*) AS deliveries
       FROM events GROUP BY day(ts), hour(ts) HAVING count(DISTINCT (event_type = 'error', user_id, props)) > 1""",
)
def change_collisions(lake: Lake) -> DataFrame:
    """Change ids cut to the hour: every hour with different contents collides."""
    rows = lake.source_changes().withColumn(
        "change_id", F.concat(F.lit("h-"), F.dayofmonth("first_observed_at").cast("string"), F.lit("-"), F.hour("first_observed_at").cast("string"))
    )
    return ig.collisions(rows)


@query("slot_projection", "SELECT external_id, pos AS ordinal, slot_key, record_id FROM slot_rows", INGEST)
def slot_projection(lake: Lake) -> DataFrame:
    return ig.project_slots(_ordered(lake), SLOTS).select("external_id", "ordinal", "slot_key", "record_id")


@query("slot_retractions", "SELECT retraction_id, record_id AS target_id, change_id, slot_key, eff AS effective_from FROM lost", INGEST)
def slot_retractions(lake: Lake) -> DataFrame:
    changes = _ordered(lake)
    return ig.slot_retractions(changes, ig.project_slots(changes, SLOTS)).select(
        "retraction_id", "target_id", "change_id", "slot_key", F.unix_millis("effective_from").alias("effective_from")
    )


PROJECTED = {
    **INGEST,
    "projected": """
        SELECT r.external_id, r.change_id, r.kind = 'delete' AS deleted, (SELECT count(*) FROM slot_rows s WHERE s.external_id = r.external_id AND s.pos = r.pos) AS n_slots
        FROM received r QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY pos DESC) = 1""",
}


@query("resource_projections", "SELECT external_id, change_id, deleted, n_slots FROM projected", PROJECTED)
def resource_projections(lake: Lake) -> DataFrame:
    changes = _ordered(lake)
    return ig.projections(changes, ig.project_slots(changes, SLOTS)).select("external_id", "change_id", "deleted", "n_slots")


@query(
    "full_sync_sweep",
    """SELECT external_id, 'sweep:' || sha256('["g7","crm","user","' || external_id || '"]') AS change_id FROM projected
       WHERE NOT deleted AND external_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE ts >= TIMESTAMP '2024-01-30 20:00:00')""",
    PROJECTED,
)
def full_sync_sweep(lake: Lake) -> DataFrame:
    """A full read that showed only users of the last hours."""
    changes = _ordered(lake)
    live = ig.projections(changes, ig.project_slots(changes, SLOTS))
    seen = lake.source_changes().filter(F.col("first_observed_at") >= F.lit("2024-01-30 20:00:00").cast("timestamp"))
    return ig.sweep(live, seen, "g7", "2024-02-01").select("external_id", "change_id")


@query(
    "artifact_actions",
    """SELECT change_id, CASE WHEN stores THEN 'upsert' WHEN lag(stores, 1, false) OVER (PARTITION BY external_id ORDER BY pos) THEN 'delete' ELSE 'preserve' END AS action
       FROM (SELECT *, kind = 'upsert' AND amount >= 50 AS stores FROM received)""",
    INGEST,
)
def artifact_actions(lake: Lake) -> DataFrame:
    return ig.artifact_actions(_ordered(lake), "amount >= 50").select("change_id", "action")


@query(
    "sync_counters",
    """SELECT 'crm' AS source_key, (SELECT count(*) FROM received) AS n_changes, (SELECT count(*) FROM received WHERE kind = 'delete') AS n_deletes,
         (SELECT count(DISTINCT record_id) FROM slot_rows) AS n_observations, (SELECT count(*) FROM lost) AS n_retractions""",
    INGEST,
)
def sync_counters(lake: Lake) -> DataFrame:
    changes = _ordered(lake)
    slots = pinned(ig.project_slots(changes, SLOTS))
    return ig.round_counters(changes, slots, ig.slot_retractions(changes, slots))


@query(
    "generation_conflicts",
    """SELECT DISTINCT 'src-' || user_id AS source_key, 'several-active' AS rule FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id HAVING count(*) > 1
       UNION ALL SELECT DISTINCT 'src-' || user_id, 'conflicting-completion' FROM events WHERE event_type NOT IN ('view', 'signup')
       GROUP BY user_id, json_extract_string(props, '$.k') HAVING count(DISTINCT event_type) > 1""",
)
def generation_conflicts(lake: Lake) -> DataFrame:
    rows = lake.table("events").select(
        F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_key"),
        F.get_json_object("props", "$.k").alias("generation_id"),
        F.when(F.col("event_type").isin("view", "signup"), F.lit("active")).otherwise(F.lit("complete")).alias("status"),
        F.col("event_type").alias("final_checkpoint"),
    )
    return ig.generation_conflicts(rows).distinct()


@query(
    "projection_violations",
    """SELECT external_id, 'open-slots' AS rule FROM projected WHERE deleted AND external_id IN (SELECT external_id FROM slot_rows)
       UNION ALL SELECT external_id, 'repeated-slot' FROM slot_rows GROUP BY external_id, slot_key HAVING count(*) > 1""",
    PROJECTED,
)
def projection_violations(lake: Lake) -> DataFrame:
    """All slots ever opened, taken as if none had been closed."""
    changes = _ordered(lake)
    slots = ig.project_slots(changes, SLOTS)
    return va.projection_violations(ig.projections(changes, slots), slots).select("external_id", "rule")


# -- capsules ----------------------------------------------------------------------------

AT = "2000-06-30 00:00:00"
CAPSULE = {
    "sections": """
        SELECT entity_id, CASE status WHEN 'resolved' THEN 'state' ELSE 'conflict' END AS section, CASE status WHEN 'resolved' THEN 1 ELSE n_candidates END AS n FROM resolved
        UNION ALL SELECT from_id, 'relation', count(*) FROM live GROUP BY 1
        UNION ALL SELECT entity_id, 'retraction', count(DISTINCT retraction_id) FROM applied GROUP BY 1""",
    "live": """
        SELECT e.* FROM relations e, probes p WHERE e.valid_from <= p.valid_at AND (e.valid_to IS NULL OR p.valid_at < e.valid_to) AND e.recorded_at <= p.known_at
          AND NOT EXISTS (SELECT 1 FROM relation_retractions r WHERE r.target_id = e.relation_id AND r.recorded_at <= p.known_at AND r.effective_from <= p.valid_at)""",
    "applied": """
        SELECT entity_id, retraction_id FROM (
          SELECT o.entity_id, r.retraction_id, r.effective_from, o.valid_to, min(r.effective_from) OVER (PARTITION BY r.target_id) AS f
          FROM retractions r JOIN probes p ON r.recorded_at <= p.known_at JOIN observations o ON o.observation_id = r.target_id
          UNION ALL
          SELECT e.from_id, r.retraction_id, r.effective_from, e.valid_to, min(r.effective_from) OVER (PARTITION BY r.target_id)
          FROM relation_retractions r JOIN probes p ON r.recorded_at <= p.known_at JOIN relations e ON e.relation_id = r.target_id)
        WHERE effective_from = f AND (valid_to IS NULL OR effective_from < valid_to)""",
    "heads": """
        SELECT e.entity_id, CAST(coalesce(sum(n) FILTER (section = 'state'), 0) AS BIGINT) AS n_state, CAST(coalesce(sum(n) FILTER (section = 'conflict'), 0) AS BIGINT) AS n_conflict,
          CAST(coalesce(sum(n) FILTER (section = 'relation'), 0) AS BIGINT) AS n_relation, CAST(coalesce(sum(n) FILTER (section = 'retraction'), 0) AS BIGINT) AS n_retraction
        FROM entities e LEFT JOIN sections s USING (entity_id) GROUP BY 1""",
}


def _capsule_views() -> dict[str, str]:
    from lakestate.plans.state_queries import STATE

    return {**STATE, **CAPSULE, "probes": "SELECT 'at' AS probe_id, 962323200000 AS valid_at, 962323200000 AS known_at"}


def _tables(lake: Lake) -> dict[str, DataFrame]:
    return {
        "entities": lake.entities(), "aliases": lake.aliases(), "observations": lake.observations(), "relations": lake.relations(),
        "retractions": lake.retractions().unionByName(lake.relation_retractions()), "authority_rules": lake.authority_rules(),
    }


COUNTS = ["entity_id", "n_state", "n_conflict", "n_relation", "n_retraction"]


@query("capsule_build", "SELECT entity_id, n_state, n_conflict, n_relation, n_retraction FROM heads", _capsule_views())
def capsule_build(lake: Lake) -> DataFrame:
    """Everything known about every entity at one time, with sizes per section."""
    return cp.materialize(_tables(lake), AT)[1].select(*COUNTS)


@query(
    "capsule_refresh",
    """SELECT CAST(0 AS BIGINT) AS n_different, count(*) AS n_capsules FROM entities""",
)
def capsule_refresh(lake: Lake) -> DataFrame:
    """Built without suppliers' deliveries, then refreshed from the feed of those
    relations: the digests must equal those of a build from scratch.

    Each build ends before the next one begins, and leaves its heads alone on disk."""
    whole = _tables(lake)
    early = {**whole, "relations": lake.place_relations().withColumn("evidence_refs", F.array("relation_id")),
             "retractions": lake.retractions()}
    with passing(lake.spark):
        old = pinned(cp.materialize(early, AT)[1])
    feed = lake.supplier_part_relations().select(F.col("from_id").alias("primary_entity_id"))
    touched = pinned(cp.to_refresh(feed, old, F.lit(AT).cast("timestamp"), "v1"))
    with passing(lake.spark):
        fresh = cp.materialize(whole, AT, only=touched)[1]
        after = pinned(cp.replace(old, fresh, touched).select("entity_id", "material_digest"))
        del fresh
    full = cp.materialize(whole, AT)[1].select("entity_id", F.col("material_digest").alias("d"))
    return after.join(full, "entity_id", "full_outer").agg(
        F.sum((~F.col("material_digest").eqNullSafe(F.col("d"))).cast("bigint")).alias("n_different"), F.count(F.lit(1)).alias("n_capsules")
    )


@query(
    "capsule_upsert",
    """SELECT CASE WHEN r.entity_id IS NULL THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n
       FROM entities e LEFT JOIN (SELECT from_id AS entity_id FROM live WHERE relation_id LIKE 'line-%'
         UNION SELECT entity_id FROM applied WHERE retraction_id LIKE 'end-%') r USING (entity_id) GROUP BY 1""",
    _capsule_views(),
)
def capsule_upsert(lake: Lake) -> DataFrame:
    whole = _tables(lake)
    early = {**whole, "relations": lake.place_relations().withColumn("evidence_refs", F.array("relation_id")), "retractions": lake.retractions()}
    old, new = pinned(cp.materialize(early, AT)[1]), cp.materialize(whole, AT)[1]
    return ap.classify_upsert(new, old).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "capsule_stale",
    """SELECT entity_id FROM (
         SELECT entity_id, min(b) AS b FROM (
           SELECT entity_id, recorded_at AS b FROM aliases
           UNION ALL SELECT entity_id, unnest([greatest(valid_from, recorded_at), valid_to]) FROM observations WHERE valid_to IS NULL OR greatest(valid_from, recorded_at) < valid_to
           UNION ALL SELECT from_id, unnest([greatest(valid_from, recorded_at), valid_to]) FROM relations WHERE valid_to IS NULL OR greatest(valid_from, recorded_at) < valid_to
           UNION ALL SELECT o.entity_id, greatest(r.effective_from, r.recorded_at) FROM retractions r JOIN observations o ON o.observation_id = r.target_id WHERE o.valid_to IS NULL OR r.effective_from < o.valid_to
           UNION ALL SELECT e.from_id, greatest(r.effective_from, r.recorded_at) FROM relation_retractions r JOIN relations e ON e.relation_id = r.target_id WHERE e.valid_to IS NULL OR r.effective_from < e.valid_to)
         WHERE b > 962323200000 GROUP BY 1) WHERE b <= 964915200000""",
)
def capsule_stale(lake: Lake) -> DataFrame:
    """Capsules that a month without any new data makes wrong."""
    heads = cp.materialize(_tables(lake), AT)[1]
    return cp.stale(heads, F.lit("2000-07-30").cast("timestamp"), "v1")


@query("capsule_vanished", "SELECT DISTINCT 'entity://user/' || user_id AS entity_id FROM events")
def capsule_vanished(lake: Lake) -> DataFrame:
    heads = lake.entities().select("entity_id")
    return cp.vanished(heads, lake.entities().filter("entity_type <> 'User'"))


# -- documents and journal --------------------------------------------------------------------

ARTIFACT_PROBES = [tp.Probe("early", "2024-02-15", "2024-02-15"), tp.Probe("late", "2030-01-01", "2024-06-01")]
ARTIFACT = {
    "probes": "SELECT * FROM (VALUES ('early', 1707955200000, 1707955200000), ('late', 1893456000000, 1717200000000)) t(probe_id, valid_at, known_at)",
    "versions": """
        SELECT p.probe_id, r.external_id, m.mutation_id, m.kind, m.blob_digest, m.blob_size, CASE WHEN m.kind IS NULL THEN 'none' WHEN m.kind = 'delete' THEN 'deleted' ELSE 'present' END AS status
        FROM (SELECT DISTINCT external_id FROM artifact_mutations) r JOIN probes p ON true LEFT JOIN artifact_mutations m
          ON m.external_id = r.external_id AND m.effective_at <= p.valid_at AND m.recorded_at <= p.known_at
        QUALIFY row_number() OVER (PARTITION BY p.probe_id, r.external_id ORDER BY m.effective_at DESC NULLS LAST, m.recorded_at DESC, m.mutation_id DESC) = 1""",
}


def _blobs(lake: Lake) -> DataFrame:
    empty = lake.spark.createDataFrame([], "digest string")
    return af.put_blobs(lake.page_bytes(), empty)


@query("artifact_as_of", "SELECT probe_id, external_id, mutation_id, status FROM versions", ARTIFACT)
def artifact_as_of(lake: Lake) -> DataFrame:
    return af.as_of(lake.artifact_mutations(), ARTIFACT_PROBES).select("probe_id", "external_id", "mutation_id", "status")


@query(
    "artifact_history",
    """SELECT mutation_id, row_number() OVER w AS ordinal, lag(mutation_id) OVER w AS prev_mutation_id FROM artifact_mutations
       WINDOW w AS (PARTITION BY external_id ORDER BY effective_at, recorded_at, mutation_id)""",
)
def artifact_history(lake: Lake) -> DataFrame:
    return af.history(lake.artifact_mutations()).select("mutation_id", "ordinal", "prev_mutation_id")


@query(
    "artifact_catalog",
    """SELECT external_id, count(*) AS n_versions, 'artifact://resource/' || sha256('["web","page","' || external_id || '"]') AS uri FROM artifact_mutations GROUP BY 1""",
)
def artifact_catalog(lake: Lake) -> DataFrame:
    return af.catalog(lake.artifact_mutations()).select("external_id", "n_versions", "uri")


@query("blob_store", "SELECT sha256(html) AS digest, CAST(min(strlen(html)) AS BIGINT) AS size FROM pages GROUP BY 1")
def blob_store(lake: Lake) -> DataFrame:
    return _blobs(lake).select("digest", "size")


@query(
    "artifact_append_check",
    """SELECT mutation_id, 'missing-blob' AS rule FROM artifact_mutations WHERE kind = 'upsert'
       AND blob_digest NOT IN (SELECT sha256(html) FROM pages WHERE url LIKE 'https:%')""",
)
def artifact_append_check(lake: Lake) -> DataFrame:
    """Only bytes of https pages were stored."""
    empty = lake.spark.createDataFrame([], "digest string")
    https = lake.table("pages").filter(F.col("url").startswith("https:")).select(F.encode("html", "UTF-8").alias("bytes"))
    return af.append_violations(lake.artifact_mutations(), af.put_blobs(https, empty))


@query(
    "blobs_unreferenced",
    """SELECT DISTINCT sha256(html) AS digest FROM pages WHERE sha256(html) NOT IN (SELECT blob_digest FROM artifact_mutations WHERE blob_digest IS NOT NULL)""",
)
def blobs_unreferenced(lake: Lake) -> DataFrame:
    return af.unreferenced(_blobs(lake), lake.artifact_mutations())


@query(
    "blobs_unindexed",
    """SELECT DISTINCT 'store/' || substr(sha256(html), 1, 2) || '/' || sha256(html) AS path FROM pages
       WHERE sha256(html) NOT IN (SELECT blob_digest FROM artifact_mutations WHERE blob_digest IS NOT NULL)""",
)
def blobs_unindexed(lake: Lake) -> DataFrame:
    """All stored paths against the digests the versions index."""
    files = _blobs(lake).select(F.concat_ws("/", F.lit("store"), F.substring("digest", 1, 2), "digest").alias("path"))
    index = lake.artifact_mutations().filter("blob_digest IS NOT NULL").select(F.col("blob_digest").alias("digest"))
    return af.unindexed(files, index)


@query(
    "blob_ranges",
    """SELECT sha256(html) AS digest, CASE WHEN 1500 > strlen(html) THEN 'past-end' ELSE 'ok' END AS status,
         CASE WHEN 1500 <= strlen(html) THEN CAST(strlen(html) AS BIGINT) END AS size FROM pages GROUP BY html""",
)
def blob_ranges(lake: Lake) -> DataFrame:
    blobs = _blobs(lake)
    asks = blobs.select("digest", F.lit(1000).alias("start"), F.lit(500).alias("length"))
    got = af.read_ranges(asks, blobs, 4096)
    return got.select("digest", "status", F.when(F.length("range") == 500, F.col("size")).alias("size"))


@query(
    "blob_audit",
    "SELECT sha256(html) AS digest, unnest(['digest', 'size']) AS problem FROM pages WHERE contains(html, '***') GROUP BY html",
)
def blob_audit(lake: Lake) -> DataFrame:
    """Bytes with stars got one more byte on disk."""
    starred = F.decode("bytes", "UTF-8").contains("***")
    torn = _blobs(lake).withColumn("bytes", F.when(starred, F.concat("bytes", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("bytes")))
    return af.audit(torn)


@query(
    "blobs_required",
    """SELECT blob_digest AS digest, min(blob_size) AS size, count(*) AS n_references, false AS conflict FROM artifact_mutations WHERE blob_digest IS NOT NULL GROUP BY 1""",
)
def blobs_required(lake: Lake) -> DataFrame:
    return xs.required_blobs(lake.artifact_mutations()).select("digest", "size", "n_references", "conflict")


@query(
    "blobs_missing",
    """SELECT DISTINCT blob_digest AS digest, blob_size AS size, 'missing' AS status FROM artifact_mutations
       WHERE blob_digest IS NOT NULL AND blob_digest NOT IN (SELECT sha256(html) FROM pages WHERE url LIKE 'https:%')""",
)
def blobs_missing(lake: Lake) -> DataFrame:
    empty = lake.spark.createDataFrame([], "digest string")
    https = lake.table("pages").filter(F.col("url").startswith("https:")).select(F.encode("html", "UTF-8").alias("bytes"))
    return xs.missing_blobs(xs.required_blobs(lake.artifact_mutations()), af.put_blobs(https, empty))


@query(
    "journal_runs",
    """SELECT event_id, run_id, type FROM journal_events WHERE run_id IN (SELECT 'run-' || user_id FROM events WHERE value > 200)""",
)
def journal_runs(lake: Lake) -> DataFrame:
    runs = lake.table("events").filter("value > 200").select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"))
    return jn.run_events(lake.journal_events(), runs).select("event_id", "run_id", "type")


@query(
    "journal_indeterminate",
    """SELECT mutation_id, min(occurred_at) AS requested_at FROM journal_events WHERE type = 'mutation.requested'
       AND mutation_id NOT IN (SELECT mutation_id FROM journal_events WHERE type IN ('mutation.applied', 'mutation.failed')) GROUP BY 1""",
)
def journal_indeterminate(lake: Lake) -> DataFrame:
    return jn.indeterminate(lake.journal_events()).withColumn("requested_at", F.unix_millis("requested_at"))


@query(
    "journal_outcomes",
    """SELECT run_id, count(*) FILTER (type = 'mutation.applied') AS applied, count(*) FILTER (type = 'mutation.failed') AS failed,
         count(*) FILTER (type = 'mutation.requested') AS requested, max(occurred_at) - min(occurred_at) AS duration_ms,
         CASE WHEN count(*) FILTER (type = 'mutation.failed') > 0 THEN CASE WHEN count(*) FILTER (type = 'mutation.applied') > 0 THEN 'partial' ELSE 'failed' END
           WHEN count(*) FILTER (type = 'mutation.applied') > 0 THEN 'applied' ELSE 'noop' END AS outcome
       FROM journal_events GROUP BY 1""",
)
def journal_outcomes(lake: Lake) -> DataFrame:
    return jn.run_outcomes(lake.journal_events())
