"""Change feeds of outside resources: receipts, slots, retractions, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions.ordering import with_ordinal
from lakestate.functions.values import tuple_id

RESOURCE = ["source_key", "external_type", "external_id"]


def receipts(changes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first delivery of each change id, its missing clocks filled once."""
    if seen is not None:
        changes = changes.join(seen.select("source_key", "change_id"), ["source_key", "change_id"], "left_anti")
    rest = [c for c in changes.columns if c not in ("source_key", "change_id")]
    first = changes.groupBy("source_key", "change_id").agg(F.min_by(F.struct(*rest), "ord").alias("c")).select(
        "source_key", "change_id", "c.*"
    )
    return first.withColumn("effective_at", F.coalesce("effective_at", "recorded_at", "first_observed_at")).withColumn(
        "recorded_at", F.coalesce("recorded_at", "first_observed_at")
    )


def collisions(changes: DataFrame) -> DataFrame:
    """Change ids delivered with different contents."""
    content = F.sha2(F.to_json(F.struct("kind", "external_type", "external_id", "props")), 256)
    return changes.groupBy("source_key", "change_id").agg(
        F.min(content).alias("a"), F.max(content).alias("b"), F.count(F.lit(1)).alias("deliveries")
    ).filter("a <> b").select("source_key", "change_id", "deliveries")


def project_slots(changes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields of an upsert as slots, absent ones left out."""
    options = F.array(
        *[
            F.struct(F.lit(slot).alias("slot_key"), F.expr(path).cast("string").alias("value"))
            for slot, path in fields.items()
        ]
    )
    each = changes.filter("kind = 'upsert'").withColumn("slot", F.explode(options)).filter("slot.value IS NOT NULL")
    return each.select(*RESOURCE, "ordinal", "change_id", "effective_at", "recorded_at", "slot.slot_key", "slot.value").withColumn(
        "record_id", tuple_id("observation", *[F.col(c) for c in RESOURCE], F.col("slot_key"), F.col("value"))
    )


def slot_retractions(changes: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots of the change before that the next change of the resource
    does not keep, with a deterministic retraction id.

    ``changes`` carries the dense position of each change within its resource
    (see ``in_order``), so "the change before" is an equi-join that spreads a
    resource with very many changes over all tasks. A delete has no slots and
    so ends everything that was open.
    """
    place = [*RESOURCE, "ordinal"]
    before = slots.select(*RESOURCE, (F.col("ordinal") + 1).alias("ordinal"), "slot_key", "record_id")
    kept = slots.select(*place, "slot_key", "record_id")
    lost = before.join(kept, [*place, "slot_key", "record_id"], "left_anti")
    by = changes.select(*place, "change_id", F.col("effective_at").alias("effective_from"), "recorded_at")
    return lost.join(by, place).select(
        tuple_id("retraction", *[F.col(c) for c in RESOURCE], F.col("slot_key"), F.col("record_id"), F.col("change_id")).alias("retraction_id"),
        F.lit("observation").alias("target_kind"), F.col("record_id").alias("target_id"),
        "effective_from", "recorded_at", "change_id", *RESOURCE, "slot_key",
    )


def in_order(changes: DataFrame) -> DataFrame:
    """Dense position of each change within its resource."""
    return with_ordinal(changes, RESOURCE, ["ord"])


def projections(changes: DataFrame, slots: DataFrame) -> DataFrame:
    """The last change of each resource and how many slots it leaves open."""
    last = changes.groupBy(*RESOURCE).agg(F.max(F.struct("ordinal", "kind", "change_id")).alias("c")).select(*RESOURCE, "c.*")
    open_slots = slots.groupBy(*RESOURCE, "ordinal").agg(F.count(F.lit(1)).alias("n_slots"))
    return last.join(open_slots, [*RESOURCE, "ordinal"], "left").select(
        *RESOURCE, "change_id", (F.col("kind") == "delete").alias("deleted"), F.coalesce("n_slots", F.lit(0)).alias("n_slots")
    )


def sweep(live: DataFrame, seen: DataFrame, generation: str, at: str) -> DataFrame:
    """Synthetic deletes for live resources a completed full read did not show."""
    gone = live.filter("NOT deleted").select(*RESOURCE).join(seen.select(*RESOURCE).distinct(), RESOURCE, "left_anti")
    return gone.select(
        *RESOURCE, F.lit("delete").alias("kind"),
        tuple_id("sweep", F.lit(generation), *[F.col(c) for c in RESOURCE]).alias("change_id"),
        F.lit(at).cast("timestamp").alias("effective_at"), F.lit(at).cast("timestamp").alias("recorded_at"),
    )


def artifact_actions(changes: DataFrame, has_bytes: str) -> DataFrame:
    """Upsert with bytes applies; a delete or an upsert without bytes deletes
    what the last upsert stored, else nothing is touched.

    The state before a change is the last change that was a delete or carried
    bytes: a change that stores nothing after "nothing stored" changes nothing,
    so looking one change back at "stored" is enough.
    """
    stores = (F.col("kind") == "upsert") & F.expr(has_bytes)
    marked = changes.withColumn("stores", F.coalesce(stores, F.lit(False)))
    before = marked.select(*RESOURCE, (F.col("ordinal") + 1).alias("ordinal"), F.col("stores").alias("stored_before"))
    return marked.join(before, [*RESOURCE, "ordinal"], "left").select(
        *RESOURCE, "ordinal", "change_id",
        F.when(F.col("stores"), F.lit("upsert"))
        .when(F.coalesce("stored_before", F.lit(False)), F.lit("delete"))
        .otherwise(F.lit("preserve")).alias("action"),
    )


def round_counters(changes: DataFrame, slots: DataFrame, lost: DataFrame) -> DataFrame:
    """What one round did, per source."""
    parts = [
        changes.groupBy("source_key").agg(
            F.count(F.lit(1)).alias("n_changes"), F.sum((F.col("kind") == "delete").cast("bigint")).alias("n_deletes"),
        ),
        slots.groupBy("source_key").agg(F.countDistinct("record_id").alias("n_observations")),
        lost.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_retractions")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "source_key", "left")
    return out.na.fill(0)


def generation_conflicts(generations: DataFrame) -> DataFrame:
    """Sources with more than one active generation, or one completed in two ways."""
    active = generations.filter("status = 'active'").groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "source_key", F.lit("several-active").alias("rule")
    )
    ends = generations.filter("status = 'complete'").groupBy("source_key", "generation_id").agg(
        F.countDistinct("final_checkpoint").alias("n")
    ).filter("n > 1").select("source_key", F.lit("conflicting-completion").alias("rule"))
    return active.unionByName(ends)
