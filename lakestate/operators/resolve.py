"""Which of several contradictory values is the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.functions.ordering import as_of_lookup, locale, plain
from lakestate.operators.temporal import Probe, active, known_live, numbered_points
from lakestate.session import written

KEYS = ["probe_id", "entity_id", "property"]


def candidates_from_snapshots(snapshots: DataFrame, bindings: DataFrame) -> DataFrame:
    """Readable, present fields of observed snapshots as candidates."""
    readable = bindings.filter("readable").select("entity_id", "provider", "external_id", "external", "canonical")
    return (
        snapshots.filter(F.col("value_json").isNotNull())
        .join(readable, ["entity_id", "provider", "external_id", "external"])
        .select(
            "entity_id", F.col("canonical").alias("property"), "value_json", "provider", "external_id",
            "revision", "observed_at",
        )
    )


def candidates_from_active(rows: DataFrame) -> DataFrame:
    """Active observations as candidates; the freshness clock is ``recorded_at``."""
    return rows.select(
        *KEYS, "observation_id", "value_json", "provider", "external_id", "revision",
        F.col("recorded_at").alias("observed_at"),
    )


def last_rules(rules: DataFrame, order: str) -> DataFrame:
    """Of several rules for one property the last one counts."""
    return rules.groupBy("entity_id", "property").agg(
        F.max_by("kind", order).alias("kind"), F.max_by("providers", order).alias("providers")
    )


def _per_provider(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates reduced to the freshest clock of each provider."""
    by_clock = cands.groupBy(*keys, "provider", "observed_at").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value_json").alias("lo"),
        F.max("value_json").alias("hi"),
        F.min(F.struct(locale(F.col("external_id")).alias("external_id"), "value_json", "revision")).alias("first"),
    )
    return (
        by_clock.groupBy(*keys, "provider")
        .agg(F.max(F.struct("observed_at", "n", "lo", "hi", "first")).alias("top"))
        .select(*keys, "provider", "top.*")
    )


def _with_rank(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Place of the provider in the property's rule; 0 without a rule, dropped when not listed."""
    if rules is None:
        return rows.withColumn("rank", F.lit(0)).withColumn("trusted", F.lit(None).cast("string"))
    if "position" in rules.columns:
        rules = last_rules(rules, "position")
    listed = rules.select(
        "entity_id", "property", F.when(F.col("kind") == "provider", F.col("providers")).alias("providers")
    )
    place = F.array_position("providers", F.col("provider")).cast("int")
    return (
        rows.join(listed, ["entity_id", "property"], "left")
        .withColumn("rank", F.when(F.col("providers").isNull(), F.lit(0)).when(place > 0, place))
        .filter("rank IS NOT NULL")
        .withColumn("trusted", F.when(F.col("rank") > 0, F.col("provider")))
        .drop("providers")
    )


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The freshest tie of the best-ranked provider; rows may be partial summaries."""
    return _foremost(_tied(rows, keys), keys)


def _tied(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one rank and clock put together."""
    return rows.groupBy(*keys, "rank", "observed_at").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("trusted").alias("trusted"),
        F.min("winner").alias("winner"),
    )


def _foremost(tied: DataFrame, keys: list[str]) -> DataFrame:
    best = F.struct((-F.col("rank")).alias("order"), "rank", "observed_at", "n", "lo", "hi", "trusted", "winner")
    return tied.groupBy(*keys).agg(F.max(best).alias("top")).select(*keys, "top.*").drop("order")


def _verdict(best: DataFrame, keys: list[str]) -> DataFrame:
    agreed = F.col("lo") == F.col("hi")
    first = F.col("winner")["first"]
    return best.select(
        *keys,
        F.when(agreed, F.lit("resolved")).otherwise(F.lit("conflict")).alias("status"),
        F.when(
            ~agreed,
            F.when(F.col("trusted").isNull(), F.lit("ambiguous-freshest")).otherwise(F.lit("ambiguous-authority")),
        ).alias("reason"),
        F.when(agreed, first["value_json"]).alias("value_json"),
        F.when(agreed, plain(F.col("winner")["provider"])).alias("provider"),
        F.when(agreed, plain(first["external_id"])).alias("external_id"),
        F.when(agreed, first["revision"]).alias("revision"),
        "observed_at",
        F.col("n").alias("n_candidates"),
        "trusted",
    )


def _winner() -> Column:
    return F.struct(locale(F.col("provider")).alias("provider"), "first")


def resolve(cands: DataFrame, rules: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row per key with the winning value or the status ``conflict``.

    ``rules`` has one rule per property, or a ``position`` that tells the last.

    Only aggregations that combine before the shuffle: candidates shrink to
    one row per (key, provider, clock), then per (key, provider), and only
    then meet the rules, so a hot key never reaches a join or a sort whole.
    """
    ranked = _with_rank(_per_provider(cands, keys), rules).withColumn("winner", _winner())
    return _verdict(_best(ranked, keys), keys)


def canonical(resolved: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The properties that have one value."""
    return resolved.filter("status = 'resolved'").select(
        *keys, "value_json", "provider", "external_id", "revision", "observed_at"
    )


def conflict_candidates(resolved: DataFrame, cands: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per newest candidate of each conflict (long form, never one array)."""
    c = resolved.filter("status = 'conflict'").select(*keys, "observed_at", "reason", "trusted")
    return (
        cands.join(c, [*keys, "observed_at"])
        .filter(F.col("trusted").isNull() | (F.col("trusted") == F.col("provider")))
        .drop("trusted")
    )


def canonical_evidence(state: DataFrame, cands: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Active rows with the winner's whole source, clock and value."""
    s = state.select(*keys, "provider", "external_id", "observed_at", "value_json", F.col("revision").alias("__rev"))
    same = [*keys, "provider", "external_id", "observed_at", "value_json"]
    return cands.join(s, same).filter(F.col("revision").eqNullSafe(F.col("__rev"))).select(*keys, "observation_id")


def conflict_evidence(conflicts: DataFrame, cands: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Active rows equal to a candidate but for the revision."""
    same = [*keys, "provider", "external_id", "observed_at", "value_json"]
    return cands.join(conflicts.select(*same).distinct(), same, "left_semi").select(*keys, "observation_id")


def resolve_state(observations: DataFrame, retractions: DataFrame, rules: DataFrame | None, probes: list[Probe]) -> DataFrame:
    """As-of filter, retractions, authority and freshness for all entities and probes."""
    cands = candidates_from_active(active(observations, retractions, probes))
    return resolve(cands, rules, KEYS)


def latest_observation(observations: DataFrame) -> DataFrame:
    """Newest row per source and property, larger id on ties."""
    keys = ["entity_id", "provider", "external_id", "property"]
    newest = F.max(F.struct("recorded_at", "observation_id", "value_json")).alias("top")
    return observations.groupBy(*keys).agg(newest).select(*keys, "top.*")


def replay_diff(observations: DataFrame, retractions: DataFrame, rules: DataFrame | None, valid_at: str, before: str, after: str) -> DataFrame:
    """Answers about one valid time that later knowledge changed."""
    both = resolve_state(
        observations, retractions, rules, [Probe("before", valid_at, before), Probe("after", valid_at, after)]
    )
    answer = F.struct("status", "value_json")
    wide = both.groupBy("entity_id", "property").agg(
        F.max(F.when(F.col("probe_id") == "before", answer)).alias("b"),
        F.max(F.when(F.col("probe_id") == "after", answer)).alias("a"),
    )
    return wide.filter(~F.col("b").eqNullSafe(F.col("a"))).select(
        "entity_id", "property",
        F.col("b.status").alias("status_before"), F.col("b.value_json").alias("value_before"),
        F.col("a.status").alias("status_after"), F.col("a.value_json").alias("value_after"),
    )


def conflict_summary(resolved: DataFrame) -> DataFrame:
    """Conflicts by property and reason, with totals."""
    return (
        resolved.filter("status = 'conflict'")
        .rollup("property", "reason")
        .agg(F.count(F.lit(1)).alias("n_conflicts"), F.sum("n_candidates").alias("n_candidates"))
    )


def _blocks(first: Column, end: Column) -> Column:
    """The few dyadic blocks (level, block) that tile positions [first, end)."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2(end - first + 1)).cast("int"))

    def at_level(k: Column) -> Column:
        width = F.pow(F.lit(2), k).cast("bigint")
        low = ((first + width - 1) / width).cast("bigint")
        high = (end / width).cast("bigint")
        left = F.when((low < high) & (low % 2 == 1), F.struct(k.alias("level"), low.alias("block")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(levels, at_level))


def state_timeline(observations: DataFrame, retractions: DataFrame, rules: DataFrame | None, known_at: str) -> DataFrame:
    """State of every (entity, property) on each interval between change points.

    A row counts for a run of intervals. The run is tiled by O(log n) dyadic
    blocks, rows are summarised per block, and an interval reads the blocks
    above it; so the work is n log n even for one key with most of the rows.

    Change points are numbered through all keys. A block that a run of one key
    covers has no other key's points, so two numbers stand for block and key in
    all shuffles, and one for the interval. Each step is written, so that only
    one step's shuffles are on disk at once.
    """
    key = ["entity_id", "property"]
    live = written(
        known_live(observations, retractions, known_at)
        .select(*key, "value_json", "provider", "external_id", "revision", "valid_from", "effective_end", F.col("recorded_at").alias("observed_at")),
        "live",
    )
    points = written(numbered_points(live), "points")
    starts = points.select(*key, F.col("start").alias("valid_from"), F.col("at").alias("first"), "last")
    ends = points.select(*key, F.col("start").alias("effective_end"), F.col("at").alias("end"))
    runs = (
        live.join(starts, [*key, "valid_from"])
        .join(ends, [*key, "effective_end"], "left")
        .withColumn("end", F.coalesce("end", F.col("last") + 1))
        .select(*key, "first", "end", "provider", "observed_at", "value_json", "external_id", "revision")
    )
    ranked = written(_with_rank(runs, rules).drop(*key), "runs")
    block = ["level", "block"]
    tiled = ranked.withColumn("tile", F.explode(_blocks(F.col("first"), F.col("end")))).select("tile.*", *[c for c in ranked.columns if c not in ("first", "end")])
    # A provider has several ranks only where its property has several rules.
    tops = written(_per_provider(tiled, [*block, "rank", "trusted"]).withColumn("winner", _winner()).drop("provider", "first"), "tops")
    summaries = written(_best(tops, block), "blocks")
    up = F.sequence(F.lit(0), F.ceil(F.log2(F.col("size") + 1)).cast("int"))
    above = F.transform(
        up, lambda k: F.struct(k.alias("level"), (F.col("at") / F.pow(F.lit(2), k)).cast("bigint").alias("block"))
    )
    reads = points.select("at", F.explode(above).alias("tile")).select("at", "tile.*")
    seen = written(_tied(reads.join(summaries, block), ["at"]), "seen")
    best = written(_foremost(seen, ["at"]), "best")
    told = points.select("at", *key, "start", "until").join(best, "at")
    return _verdict(told, [*key, "start", "until"])


def probe_timeline(timeline: DataFrame, probes: DataFrame) -> DataFrame:
    """Look up (probe_id, entity_id, property, valid_at) rows in a timeline."""
    hit = as_of_lookup(probes, timeline, ["entity_id", "property"], "valid_at", "start")
    return hit.filter(F.col("until").isNull() | (F.col("valid_at") < F.col("until")))
