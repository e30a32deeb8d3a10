"""Queries over bitemporal state: as-of, retraction, resolution, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.operators import resolve as rs
from lakestate.operators import temporal as tp
from lakestate.plans.registry import query
from lakestate.session import pinned
from lakestate.sources.adapters import Lake

PROBES = [
    tp.Probe("a", "1999-06-30 00:00:00", "1999-07-31 00:00:00"),
    tp.Probe("b", "2000-06-30 00:00:00", "1999-12-31 00:00:00"),
    tp.Probe("c", "2024-01-20 00:00:00", "2024-01-25 00:00:00"),
]
NOW = "2024-01-20 00:00:00"
NOW_MS = 1705708800000

PROBE_SQL = """SELECT * FROM (VALUES ('a', 930700800000, 933379200000), ('b', 962323200000, 946598400000),
    ('c', 1705708800000, 1706140800000)) t(probe_id, valid_at, known_at)"""

# A plain restatement of the rules, independent of the Spark form: windows and NOT EXISTS.
STATE = {
    "probes": PROBE_SQL,
    "active": """
        SELECT p.probe_id, o.* FROM observations o JOIN probes p
          ON o.valid_from <= p.valid_at AND (o.valid_to IS NULL OR p.valid_at < o.valid_to) AND o.recorded_at <= p.known_at
        WHERE NOT EXISTS (SELECT 1 FROM retractions r WHERE r.target_id = o.observation_id
          AND r.recorded_at <= p.known_at AND r.effective_from <= p.valid_at)""",
    "ruled": "SELECT DISTINCT entity_id, property FROM authority_rules",
    "ranked": """
        SELECT a.*, CASE WHEN u.entity_id IS NULL THEN 0 ELSE r.rank END AS rank
        FROM active a LEFT JOIN ruled u ON u.entity_id = a.entity_id AND u.property = a.property
        LEFT JOIN authority_rules r ON r.entity_id = a.entity_id AND r.property = a.property AND r.provider = a.provider
        WHERE u.entity_id IS NULL OR r.rank IS NOT NULL""",
    "best": """
        SELECT *, dense_rank() OVER (PARTITION BY probe_id, entity_id, property ORDER BY rank, recorded_at DESC) AS dr FROM ranked""",
    "newest": "SELECT * FROM best WHERE dr = 1",
    "resolved": """
        SELECT probe_id, entity_id, property, count(*) AS n_candidates, count(DISTINCT value_json) AS n_values, max(rank) AS rank,
          max(recorded_at) AS observed_at,
          CASE WHEN count(DISTINCT value_json) = 1 THEN 'resolved' ELSE 'conflict' END AS status,
          CASE WHEN count(DISTINCT value_json) = 1 THEN min(value_json) END AS value_json,
          CASE WHEN count(DISTINCT value_json) = 1 THEN arg_min(provider, (provider, external_id)) END AS provider,
          CASE WHEN count(DISTINCT value_json) = 1 THEN arg_min(external_id, (provider, external_id)) END AS external_id
        FROM newest GROUP BY 1, 2, 3""",
}


def _candidates(lake: Lake) -> DataFrame:
    return rs.candidates_from_active(tp.active(lake.observations(), lake.retractions(), PROBES))


def _resolved(lake: Lake) -> DataFrame:
    return rs.resolve_state(lake.observations(), lake.retractions(), lake.authority_rules(), PROBES)


@query(
    "state_resolution",
    """SELECT probe_id, entity_id, property, status, value_json, provider, external_id, n_candidates, observed_at,
         CASE WHEN status = 'conflict' THEN CASE WHEN rank = 0 THEN 'ambiguous-freshest' ELSE 'ambiguous-authority' END END AS reason
       FROM resolved""",
    STATE,
)
def state_resolution(lake: Lake) -> DataFrame:
    return _resolved(lake).select(
        "probe_id", "entity_id", "property", "status", "value_json", "provider", "external_id", "n_candidates",
        F.unix_millis("observed_at").alias("observed_at"), "reason",
    )


@query(
    "as_of_filter",
    """SELECT p.probe_id, o.observation_id FROM observations o JOIN probes p
       ON o.valid_from <= p.valid_at AND (o.valid_to IS NULL OR p.valid_at < o.valid_to) AND o.recorded_at <= p.known_at""",
    STATE,
)
def as_of_filter(lake: Lake) -> DataFrame:
    return tp.as_of(lake.observations(), PROBES).select("probe_id", "observation_id")


@query(
    "as_of_per_entity",
    """SELECT 'asof-' || c_custkey AS probe_id, o.observation_id
       FROM customer c JOIN observations o ON o.entity_id = 'entity://customer/' || c_custkey
       JOIN nation n ON n.n_nationkey = c.c_nationkey
       WHERE o.valid_from <= epoch_ms(TIMESTAMP '1996-01-01' + to_days(100 * CAST(n_nationkey AS INTEGER)))
         AND (o.valid_to IS NULL OR epoch_ms(TIMESTAMP '1996-01-01' + to_days(100 * CAST(n_nationkey AS INTEGER))) < o.valid_to)
         AND o.recorded_at <= epoch_ms(TIMESTAMP '1996-01-01' + to_days(100 * CAST(n_nationkey AS INTEGER)))""",
)
def as_of_per_entity(lake: Lake) -> DataFrame:
    """Each customer asks about a time of its own (by nation)."""
    at = F.lit("1996-01-01").cast("timestamp") + F.make_interval(days=F.col("c_nationkey") * 100)
    probes = lake.table("customer").select(
        F.concat(F.lit("asof-"), F.col("c_custkey").cast("string")).alias("probe_id"),
        F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"),
        at.alias("valid_at"), at.alias("known_at"),
    )
    return tp.as_of_entities(lake.observations(), probes).select("probe_id", "observation_id")


@query(
    "retraction_effective_end",
    """SELECT p.probe_id, o.observation_id,
         least(o.valid_to, (SELECT min(r.effective_from) FROM retractions r
           WHERE r.target_id = o.observation_id AND r.recorded_at <= p.known_at)) AS effective_end
       FROM observations o, probes p""",
    STATE,
)
def retraction_effective_end(lake: Lake) -> DataFrame:
    return tp.effective_end(lake.observations(), lake.retractions(), PROBES).select(
        "probe_id", "observation_id", F.unix_millis("effective_end").alias("effective_end")
    )


@query("retraction_active_rows", "SELECT probe_id, observation_id, entity_id, property FROM active", STATE)
def retraction_active_rows(lake: Lake) -> DataFrame:
    return tp.active(lake.observations(), lake.retractions(), PROBES).select(
        "probe_id", "observation_id", "entity_id", "property"
    )


@query(
    "applied_retractions",
    """SELECT probe_id, retraction_id, target_id FROM (
         SELECT p.probe_id, r.retraction_id, r.target_id, r.effective_from, o.valid_to,
           min(r.effective_from) OVER (PARTITION BY p.probe_id, r.target_id) AS first_from
         FROM retractions r JOIN probes p ON r.recorded_at <= p.known_at JOIN observations o ON o.observation_id = r.target_id)
       WHERE effective_from = first_from AND (valid_to IS NULL OR effective_from < valid_to)""",
    STATE,
)
def applied_retractions(lake: Lake) -> DataFrame:
    return tp.applied_retractions(lake.observations(), lake.retractions(), PROBES).select(
        "probe_id", "retraction_id", "target_id"
    )


@query(
    "unknown_retraction_targets",
    """SELECT retraction_id, target_kind, target_id FROM (SELECT * FROM retractions UNION ALL SELECT * FROM relation_retractions)
       WHERE (target_kind = 'observation' AND target_id NOT IN (SELECT observation_id FROM observations WHERE recorded_at < 946684800000))
          OR (target_kind = 'relation' AND target_id NOT IN (SELECT relation_id FROM relations WHERE recorded_at < 946684800000))""",
)
def unknown_retraction_targets(lake: Lake) -> DataFrame:
    """Retractions whose target is missing from the records of the last century."""
    until = F.lit("2000-01-01").cast("timestamp")
    every = lake.retractions().unionByName(lake.relation_retractions())
    return tp.unknown_targets(
        every, lake.observations().filter(F.col("recorded_at") < until), lake.relations().filter(F.col("recorded_at") < until)
    ).select("retraction_id", "target_kind", "target_id")


@query(
    "current_state",
    "SELECT entity_id, property, status, value_json, n_candidates FROM resolved",
    {**STATE, "probes": f"SELECT 'now' AS probe_id, {NOW_MS} AS valid_at, {NOW_MS} AS known_at"},
)
def current_state(lake: Lake) -> DataFrame:
    rows = tp.current(lake.observations(), lake.retractions(), NOW)
    return rs.resolve(rs.candidates_from_active(rows), lake.authority_rules(), rs.KEYS).select(
        "entity_id", "property", "status", "value_json", "n_candidates"
    )


@query(
    "canonical_rows",
    "SELECT probe_id, entity_id, property, value_json, provider, external_id, observed_at FROM resolved WHERE status = 'resolved'",
    STATE,
)
def canonical_rows(lake: Lake) -> DataFrame:
    return rs.canonical(_resolved(lake)).drop("revision").withColumn("observed_at", F.unix_millis("observed_at"))


@query(
    "freshest_without_rules",
    "SELECT probe_id, entity_id, property, status, value_json, n_candidates FROM resolved",
    {**STATE, "ranked": "SELECT *, 0 AS rank FROM active"},
)
def freshest_without_rules(lake: Lake) -> DataFrame:
    return rs.resolve_state(lake.observations(), lake.retractions(), None, PROBES).select(
        "probe_id", "entity_id", "property", "status", "value_json", "n_candidates"
    )


@query(
    "authority_order",
    "SELECT probe_id, entity_id, property, status, provider, rank FROM resolved WHERE rank > 0",
    STATE,
)
def authority_order(lake: Lake) -> DataFrame:
    rules = lake.authority_rules()
    ruled = _resolved(lake).filter(F.col("trusted").isNotNull())
    place = F.array_position("providers", F.col("trusted")).cast("int").alias("rank")
    return ruled.join(rules, ["entity_id", "property"]).select(
        "probe_id", "entity_id", "property", "status", "provider", place
    )


@query(
    "authority_duplicate_rules",
    """SELECT probe_id, entity_id, property, status, value_json, provider, n_candidates FROM resolved""",
    STATE,
)
def authority_duplicate_rules(lake: Lake) -> DataFrame:
    """Every rule was preceded by one that trusted another provider; the last counts."""
    rules = lake.authority_rules().withColumn("position", F.lit(2))
    earlier = rules.withColumn("position", F.lit(1)).withColumn("providers", F.array(F.lit("p4"), F.lit("p3")))
    resolved = rs.resolve(pinned(_candidates(lake)), rules.unionByName(earlier), rs.KEYS)
    return resolved.select("probe_id", "entity_id", "property", "status", "value_json", "provider", "n_candidates")


@query(
    "conflict_candidates",
    """SELECT n.probe_id, n.entity_id, n.property, n.observation_id, n.provider, n.value_json
       FROM newest n JOIN resolved r USING (probe_id, entity_id, property) WHERE r.status = 'conflict'""",
    STATE,
)
def conflict_candidates(lake: Lake) -> DataFrame:
    return rs.conflict_candidates(_resolved(lake), _candidates(lake)).select(
        "probe_id", "entity_id", "property", "observation_id", "provider", "value_json"
    )


@query(
    "canonical_evidence",
    """SELECT a.probe_id, a.entity_id, a.property, a.observation_id
       FROM active a JOIN resolved r ON r.probe_id = a.probe_id AND r.entity_id = a.entity_id AND r.property = a.property
         AND r.provider = a.provider AND r.external_id = a.external_id AND r.observed_at = a.recorded_at AND r.value_json = a.value_json
       WHERE r.status = 'resolved'""",
    STATE,
)
def canonical_evidence(lake: Lake) -> DataFrame:
    return rs.canonical_evidence(rs.canonical(_resolved(lake)), _candidates(lake))


@query(
    "conflict_evidence",
    """SELECT DISTINCT a.probe_id, a.entity_id, a.property, a.observation_id
       FROM active a JOIN newest n ON n.probe_id = a.probe_id AND n.entity_id = a.entity_id AND n.property = a.property
         AND n.provider = a.provider AND n.external_id = a.external_id AND n.recorded_at = a.recorded_at AND n.value_json = a.value_json
       JOIN resolved r ON r.probe_id = a.probe_id AND r.entity_id = a.entity_id AND r.property = a.property WHERE r.status = 'conflict'""",
    STATE,
)
def conflict_evidence(lake: Lake) -> DataFrame:
    cands = _candidates(lake)
    return rs.conflict_evidence(rs.conflict_candidates(_resolved(lake), cands), cands)


@query(
    "latest_observation",
    """SELECT entity_id, provider, external_id, property, recorded_at, observation_id, value_json FROM observations
       QUALIFY row_number() OVER (PARTITION BY entity_id, provider, external_id, property ORDER BY recorded_at DESC, observation_id DESC) = 1""",
)
def latest_observation(lake: Lake) -> DataFrame:
    return rs.latest_observation(lake.observations()).withColumn("recorded_at", F.unix_millis("recorded_at"))


@query(
    "replay_diff",
    """SELECT coalesce(b.entity_id, a.entity_id) AS entity_id, coalesce(b.property, a.property) AS property,
         b.status AS status_before, b.value_json AS value_before, a.status AS status_after, a.value_json AS value_after
       FROM (SELECT * FROM resolved WHERE probe_id = 'before') b
       FULL JOIN (SELECT * FROM resolved WHERE probe_id = 'after') a ON a.entity_id = b.entity_id AND a.property = b.property
       WHERE a.status IS DISTINCT FROM b.status OR a.value_json IS DISTINCT FROM b.value_json""",
    {**STATE, "probes": """SELECT * FROM (VALUES ('before', 930700800000, 924134400000),
        ('after', 930700800000, 1009843200000)) t(probe_id, valid_at, known_at)"""},
)
def replay_diff(lake: Lake) -> DataFrame:
    return rs.replay_diff(
        lake.observations(), lake.retractions(), lake.authority_rules(),
        "1999-06-30 00:00:00", "1999-04-15 00:00:00", "2002-01-01 00:00:00",
    )


@query(
    "conflict_summary",
    """SELECT property, CASE WHEN rank = 0 THEN 'ambiguous-freshest' ELSE 'ambiguous-authority' END AS reason,
         count(*) AS n_conflicts, CAST(sum(n_candidates) AS BIGINT) AS n_candidates
       FROM resolved WHERE status = 'conflict' GROUP BY ROLLUP (property, reason)""",
    STATE,
)
def conflict_summary(lake: Lake) -> DataFrame:
    return rs.conflict_summary(_resolved(lake))


@query(
    "active_edges",
    """SELECT p.probe_id, e.relation_id, e.from_id, e.to_id, e.relation_type FROM relations e JOIN probes p
         ON e.valid_from <= p.valid_at AND (e.valid_to IS NULL OR p.valid_at < e.valid_to) AND e.recorded_at <= p.known_at
       WHERE NOT EXISTS (SELECT 1 FROM relation_retractions r WHERE r.target_id = e.relation_id
         AND r.recorded_at <= p.known_at AND r.effective_from <= p.valid_at)""",
    STATE,
)
def active_edges(lake: Lake) -> DataFrame:
    return tp.active_edges(lake.relations(), lake.relation_retractions(), PROBES).select(
        "probe_id", "relation_id", "from_id", "to_id", "relation_type"
    )


@query(
    "next_boundary",
    f"""SELECT entity_id, min(b) AS next_boundary FROM (
         SELECT entity_id, recorded_at AS b FROM aliases
         UNION ALL SELECT entity_id, greatest(valid_from, recorded_at) FROM observations WHERE valid_to IS NULL OR greatest(valid_from, recorded_at) < valid_to
         UNION ALL SELECT entity_id, valid_to FROM observations WHERE greatest(valid_from, recorded_at) < valid_to
         UNION ALL SELECT from_id, greatest(valid_from, recorded_at) FROM relations WHERE valid_to IS NULL OR greatest(valid_from, recorded_at) < valid_to
         UNION ALL SELECT from_id, valid_to FROM relations WHERE greatest(valid_from, recorded_at) < valid_to
         UNION ALL SELECT o.entity_id, greatest(r.effective_from, r.recorded_at) FROM retractions r JOIN observations o ON o.observation_id = r.target_id
           WHERE o.valid_to IS NULL OR r.effective_from < o.valid_to
         UNION ALL SELECT e.from_id, greatest(r.effective_from, r.recorded_at) FROM relation_retractions r JOIN relations e ON e.relation_id = r.target_id
           WHERE e.valid_to IS NULL OR r.effective_from < e.valid_to)
       WHERE b > 930700800000 GROUP BY entity_id""",
)
def next_boundary(lake: Lake) -> DataFrame:
    every = lake.retractions().unionByName(lake.relation_retractions())
    return tp.next_boundary(
        lake.aliases(), lake.observations(), lake.relations(), every, F.lit("1999-06-30").cast("timestamp")
    ).withColumn("next_boundary", F.unix_millis("next_boundary"))


@query(
    "state_timeline",
    """SELECT entity_id, property, start, until, status, value_json, n_candidates FROM (
         SELECT i.entity_id, i.property, i.start, i.until, count(*) AS n_candidates,
           CASE WHEN count(DISTINCT value_json) = 1 THEN 'resolved' ELSE 'conflict' END AS status,
           CASE WHEN count(DISTINCT value_json) = 1 THEN min(value_json) END AS value_json
         FROM (
           SELECT i.entity_id, i.property, i.start, i.until, k.value_json,
             dense_rank() OVER (PARTITION BY i.entity_id, i.property, i.start ORDER BY k.rank, k.recorded_at DESC) AS dr
           FROM spans i JOIN ranked k ON k.entity_id = i.entity_id AND k.property = i.property
             AND k.valid_from <= i.start AND (k.fin IS NULL OR i.start < k.fin)) i
         WHERE dr = 1 GROUP BY 1, 2, 3, 4)""",
    {
        "active": """
            SELECT o.*, least(o.valid_to, (SELECT min(r.effective_from) FROM retractions r
              WHERE r.target_id = o.observation_id AND r.recorded_at <= 946598400000)) AS fin
            FROM observations o WHERE o.recorded_at <= 946598400000""",
        "ruled": STATE["ruled"],
        "ranked": STATE["ranked"],
        "points": """
            SELECT DISTINCT entity_id, property, unnest([valid_from, fin]) AS start FROM active WHERE fin IS NULL OR valid_from < fin""",
        "spans": """
            SELECT *, lead(start) OVER (PARTITION BY entity_id, property ORDER BY start) AS until FROM points WHERE start IS NOT NULL""",
    },
)
def state_timeline(lake: Lake) -> DataFrame:
    """State of the last century on every interval, known at its end."""
    t = rs.state_timeline(lake.observations(), lake.retractions(), lake.authority_rules(), "1999-12-31 00:00:00")
    return t.select(
        "entity_id", "property", F.unix_millis("start").alias("start"), F.unix_millis("until").alias("until"),
        "status", "value_json", "n_candidates",
    )


@query(
    "timeline_lookup",
    """SELECT probe_id, entity_id, property, status, value_json FROM (
         SELECT probe_id, i.entity_id, i.property,
           CASE WHEN count(DISTINCT value_json) = 1 THEN 'resolved' ELSE 'conflict' END AS status,
           CASE WHEN count(DISTINCT value_json) = 1 THEN min(value_json) END AS value_json
         FROM (
           SELECT q.probe_id, q.entity_id, q.property, k.value_json,
             dense_rank() OVER (PARTITION BY q.probe_id, q.entity_id, q.property ORDER BY k.rank, k.recorded_at DESC) AS dr
           FROM asks q JOIN ranked k ON k.entity_id = q.entity_id AND k.property = q.property
             AND k.valid_from <= q.valid_at AND (k.fin IS NULL OR q.valid_at < k.fin)) i
         WHERE dr = 1 GROUP BY 1, 2, 3)""",
    {
        "active": """
            SELECT o.*, least(o.valid_to, (SELECT min(r.effective_from) FROM retractions r
              WHERE r.target_id = o.observation_id AND r.recorded_at <= 946598400000)) AS fin
            FROM observations o WHERE o.recorded_at <= 946598400000""",
        "ruled": STATE["ruled"],
        "ranked": STATE["ranked"],
        "asks": """
            SELECT 'ask-' || o_orderkey AS probe_id, 'entity://customer/' || o_custkey AS entity_id,
              'Customer.lastOrderStatus' AS property, epoch_ms(o_orderdate) AS valid_at FROM orders""",
    },
)
def timeline_lookup(lake: Lake) -> DataFrame:
    """What was the customer's state on the day of each order?"""
    t = rs.state_timeline(lake.observations(), lake.retractions(), lake.authority_rules(), "1999-12-31 00:00:00")
    asks = lake.table("orders").select(
        F.concat(F.lit("ask-"), F.col("o_orderkey").cast("string")).alias("probe_id"),
        F.concat(F.lit("entity://customer/"), F.col("o_custkey").cast("string")).alias("entity_id"),
        F.lit("Customer.lastOrderStatus").alias("property"),
        F.col("o_orderdate").cast("timestamp").alias("valid_at"),
    )
    return rs.probe_timeline(t, asks).select("probe_id", "entity_id", "property", "status", "value_json")
