"""Bitemporal filters, retractions, boundaries and timelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.session import pinned, written

RECORD_IDS = {"observation": "observation_id", "relation": "relation_id"}


@dataclass(frozen=True)
class Probe:
    """A question about one valid time with the knowledge of one time."""

    probe_id: str
    valid_at: str
    known_at: str


def _probe_array(probes: list[Probe]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(p.probe_id).alias("probe_id"),
                F.lit(p.valid_at).cast("timestamp").alias("valid_at"),
                F.lit(p.known_at).cast("timestamp").alias("known_at"),
            )
            for p in probes
        ]
    )


def at_probes(df: DataFrame, probes: list[Probe], applies) -> DataFrame:
    """One row per (row, probe) for which ``applies(probe)`` holds; no join."""
    hits = F.filter(_probe_array(probes), applies)
    return df.withColumn("__probe", F.explode(hits)).select("__probe.*", *df.columns)


def _latest(probes: list[Probe], clock: str) -> Column:
    return F.lit(max(getattr(p, clock) for p in probes)).cast("timestamp")


def in_window(p: Column) -> Column:
    return (
        (F.col("valid_from") <= p["valid_at"])
        & (F.col("valid_to").isNull() | (p["valid_at"] < F.col("valid_to")))
        & (F.col("recorded_at") <= p["known_at"])
    )


def as_of(records: DataFrame, probes: list[Probe]) -> DataFrame:
    """Rows valid and known at each probe, retractions not yet applied."""
    earliest = F.lit(min(p.valid_at for p in probes)).cast("timestamp")
    bounded = records.filter(
        (F.col("recorded_at") <= _latest(probes, "known_at"))
        & (F.col("valid_from") <= _latest(probes, "valid_at"))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > earliest))
    )
    return at_probes(bounded, probes, in_window)


def as_of_entities(records: DataFrame, entity_probes: DataFrame) -> DataFrame:
    """T1 for a probe table (probe_id, entity_id, valid_at, known_at): equi-join plus range."""
    p, r = entity_probes.alias("p"), records.alias("r")
    hit = (
        (F.col("p.entity_id") == F.col("r.entity_id"))
        & (F.col("r.valid_from") <= F.col("p.valid_at"))
        & (F.col("r.valid_to").isNull() | (F.col("p.valid_at") < F.col("r.valid_to")))
        & (F.col("r.recorded_at") <= F.col("p.known_at"))
    )
    return r.join(p, hit).select("p.probe_id", "p.valid_at", "p.known_at", "r.*")


def known_ends(retractions: DataFrame, kind: str, probes: list[Probe]) -> DataFrame:
    """Earliest effective time of the retractions known at each probe, per target."""
    known = at_probes(
        retractions.filter(F.col("target_kind") == kind)
        .filter(F.col("recorded_at") <= _latest(probes, "known_at"))
        .select("target_id", "effective_from", "recorded_at"),
        probes,
        lambda p: F.col("recorded_at") <= p["known_at"],
    )
    return known.groupBy("probe_id", "target_id").agg(F.min("effective_from").alias("retracted_from"))


def effective_end(records: DataFrame, retractions: DataFrame, probes: list[Probe], kind: str = "observation") -> DataFrame:
    """Every record at every probe with the end its known retractions give it."""
    ident = RECORD_IDS[kind]
    each = at_probes(records, probes, lambda p: F.lit(True))
    ends = known_ends(retractions, kind, probes).withColumnRenamed("target_id", ident)
    return each.join(ends, ["probe_id", ident], "left").withColumn(
        "effective_end", F.least("valid_to", "retracted_from")
    )


def active(records: DataFrame, retractions: DataFrame, probes: list[Probe], kind: str = "observation") -> DataFrame:
    """Rows active at each probe. A known retraction effective by the
    probe's valid time removes its target, wherever the target's window began."""
    ident = RECORD_IDS[kind]
    gone = known_ends(retractions, kind, probes).withColumnRenamed("target_id", ident)
    valid = {p.probe_id: p.valid_at for p in probes}
    valid_at = F.create_map(*[F.lit(x) for kv in valid.items() for x in kv])[F.col("probe_id")].cast("timestamp")
    voiding = gone.filter(F.col("retracted_from") <= valid_at).select("probe_id", ident)
    return as_of(records, probes).join(voiding, ["probe_id", ident], "left_anti")


def applied_retractions(records: DataFrame, retractions: DataFrame, probes: list[Probe], kind: str = "observation") -> DataFrame:
    """Known retractions that set the end of their target, active or not."""
    ident = RECORD_IDS[kind]
    ends = known_ends(retractions, kind, probes)
    short = (
        records.select(F.col(ident).alias("target_id"), "valid_to")
        .join(ends, "target_id")
        .filter(F.col("valid_to").isNull() | (F.col("retracted_from") < F.col("valid_to")))
        .select("probe_id", "target_id", F.col("retracted_from").alias("effective_from"))
    )
    known = at_probes(
        retractions.filter(F.col("target_kind") == kind), probes, lambda p: F.col("recorded_at") <= p["known_at"]
    )
    return known.join(short, ["probe_id", "target_id", "effective_from"], "left_semi").dropDuplicates(
        ["probe_id", "retraction_id"]
    )


def retracted(observations: DataFrame, relations: DataFrame, retractions: DataFrame) -> DataFrame:
    """Retractions of known records beside their target's owner and end.

    It stands in for ``retractions`` where they are asked several times: the records meet them here only.
    Kinds are written one after the other, so that only one join's shuffles are on disk at once.
    """
    def of(kind: str, records: DataFrame, owner: str) -> DataFrame:
        target = records.select(F.col(RECORD_IDS[kind]).alias("target_id"), F.col(owner).alias("entity_id"), "valid_to")
        own = retractions.filter(F.col("target_kind") == kind).select("retraction_id", "target_kind", "target_id", "effective_from", "recorded_at")
        return written(own.join(target, "target_id"), "ended")

    return of("observation", observations, "entity_id").unionByName(of("relation", relations, "from_id"))


def applied(ended: DataFrame, probes: list[Probe]) -> DataFrame:
    """T3 over ``retracted`` rows, each with its target's owner."""
    known = at_probes(ended, probes, lambda p: F.col("recorded_at") <= p["known_at"])
    target = ["probe_id", "target_kind", "target_id"]
    first = known.groupBy(*target).agg(F.min("effective_from").alias("effective_from"))
    ends = known.filter(F.col("valid_to").isNull() | (F.col("effective_from") < F.col("valid_to")))
    return ends.join(first, [*target, "effective_from"], "left_semi")


def unknown_targets(retractions: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """T4: retractions whose target does not exist in the kind they name."""
    known = observations.select(F.lit("observation").alias("target_kind"), F.col("observation_id").alias("target_id"))
    known = known.unionByName(
        relations.select(F.lit("relation").alias("target_kind"), F.col("relation_id").alias("target_id"))
    )
    return retractions.join(known, ["target_kind", "target_id"], "left_anti")


def current(records: DataFrame, retractions: DataFrame, at: str, kind: str = "observation") -> DataFrame:
    """T5: active now, with all that is known now."""
    return active(records, retractions, [Probe("now", at, at)], kind)


def active_edges(relations: DataFrame, retractions: DataFrame, probes: list[Probe], frontier: DataFrame | None = None) -> DataFrame:
    """Active relation rows, optionally only those leaving a frontier (probe_id, from_id)."""
    if frontier is not None:
        relations = relations.join(frontier.select("from_id").distinct(), "from_id", "left_semi")
    rows = active(relations, retractions, probes, "relation")
    if frontier is None:
        return rows
    return rows.join(frontier.select("probe_id", "from_id").distinct(), ["probe_id", "from_id"], "left_semi")


def window_boundaries(records: DataFrame, owner: str, at: Column) -> DataFrame:
    """The first time after ``at`` at which a record starts or stops counting for current state."""
    start = F.greatest("valid_from", "recorded_at")
    real = F.col("valid_to").isNull() | (start < F.col("valid_to"))
    # Rows without such a time go before anything is shuffled.
    later = real & ((start > at) | (F.col("valid_to") > at))
    first = F.least(F.when(start > at, start), F.when(F.col("valid_to") > at, F.col("valid_to")))
    return records.filter(later).select(F.col(owner).alias("entity_id"), first.alias("boundary"))


def retraction_boundaries(ended: DataFrame) -> DataFrame:
    return ended.filter(F.col("valid_to").isNull() | (F.col("effective_from") < F.col("valid_to"))).select(
        "entity_id", F.greatest("effective_from", "recorded_at").alias("boundary")
    )


def next_boundary(
    aliases: DataFrame, observations: DataFrame, relations: DataFrame, retractions: DataFrame, at: Column, ended: DataFrame | None = None
) -> DataFrame:
    """Per entity, the first time after ``at`` at which its state may differ.

    ``ended`` are the ``retracted`` rows, if they are at hand.
    """
    ended = retracted(observations, relations, retractions) if ended is None else ended
    every = (
        aliases.select("entity_id", F.col("recorded_at").alias("boundary"))
        .unionByName(window_boundaries(observations, "entity_id", at))
        .unionByName(window_boundaries(relations, "from_id", at))
        .unionByName(retraction_boundaries(ended))
    )
    return every.filter(F.col("boundary") > at).groupBy("entity_id").agg(F.min("boundary").alias("next_boundary"))


def query_cutoff(text: Column) -> Column:
    """End of the ISO day a query names; NULL when it names none."""
    day = F.regexp_extract(text, r"\b(20\d{2}-\d{2}-\d{2})\b", 1)
    return F.when(day != "", F.concat(day, F.lit(" 23:59:59"))).try_cast("timestamp")


def scoped(asked: DataFrame, entities: DataFrame, aliases: DataFrame, observations: DataFrame, relations: DataFrame, retractions: DataFrame) -> DataFrame:
    """Ids (kind, record_id) of everything held about the asked entities; relations count at
    their start, retractions with what they retract."""
    ids = asked.select("entity_id").distinct()
    own = lambda df, kind, ident, who="entity_id": df.join(ids.withColumnRenamed("entity_id", who), who, "left_semi").select(
        F.lit(kind).alias("kind"), F.col(ident).alias("record_id")
    )
    said, tied = own(observations, "observation", "observation_id"), own(relations, "relation", "relation_id", "from_id")
    targets = said.unionByName(tied).select(F.col("kind").alias("target_kind"), F.col("record_id").alias("target_id"))
    ended = retractions.join(targets, ["target_kind", "target_id"], "left_semi").select(F.lit("retraction").alias("kind"), F.col("retraction_id").alias("record_id"))
    return own(entities, "entity", "entity_id").unionByName(own(aliases, "alias", "alias_id")).unionByName(said).unionByName(tied).unionByName(ended)


def known_live(observations: DataFrame, retractions: DataFrame, known_at: str) -> DataFrame:
    """Observations known at one time, with the end their retractions give them, empty windows left out."""
    known = effective_end(
        observations.filter(F.col("recorded_at") <= F.lit(known_at).cast("timestamp")),
        retractions,
        [Probe("k", known_at, known_at)],
    ).drop("probe_id", "valid_at", "known_at")
    return known.filter(F.col("effective_end").isNull() | (F.col("valid_from") < F.col("effective_end")))


def change_points(live: DataFrame) -> DataFrame:
    """Starts of every (entity, property) with their ordinal, the next one (``until``) and their number (``size``)."""
    from lakestate.functions.ordering import with_ordinal

    key = ["entity_id", "property"]
    points = live.select(*key, F.explode(F.array_compact(F.array("valid_from", "effective_end"))).alias("start")).distinct()
    placed = pinned(with_ordinal(points, key, ["start"]))
    following = placed.select(*key, (F.col("ordinal") - 1).alias("ordinal"), F.col("start").alias("until"))
    sizes = placed.groupBy(*key).agg(F.max("ordinal").alias("size"))
    return placed.join(following, [*key, "ordinal"], "left").join(sizes, key)


def numbered_points(live: DataFrame) -> DataFrame:
    """Starts of every (entity, property) with their number ``at`` among those of all keys in order, the next one of
    the key (``until``), the key's last number and how many it has (``size``)."""
    from lakestate.functions.ordering import with_sequence

    key = ["entity_id", "property"]
    points = live.select(*key, F.explode(F.array_compact(F.array("valid_from", "effective_end"))).alias("start")).distinct()
    placed = with_sequence(points, [*key, "start"], name="at")
    following = placed.select(*key, (F.col("at") - 1).alias("at"), F.col("start").alias("until"))
    sizes = placed.groupBy(*key).agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("size"))
    return placed.join(following, [*key, "at"], "left").join(sizes, key)


def state_changes(observations: DataFrame, retractions: DataFrame, known_at: str) -> DataFrame:
    """Change points of every (entity, property) with the knowledge of one time."""
    return change_points(known_live(observations, retractions, known_at)).drop("size")
