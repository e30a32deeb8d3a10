"""Write-back planning: what must change in which system, and whether it may."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions import values as vl
from lakestate.operators import resolve as rs

KEYS = ["entity_id", "property"]


def sanitize(snapshots: DataFrame, bindings: DataFrame) -> DataFrame:
    """Only declared, readable fields of a snapshot survive."""
    readable = bindings.filter("readable").select("entity_id", "provider", "external_id", "external")
    return snapshots.join(readable, ["entity_id", "provider", "external_id", "external"], "left_semi")


def foreign_snapshots(snapshots: DataFrame, bindings: DataFrame) -> DataFrame:
    """Snapshots of things no binding ties to their entity."""
    return snapshots.join(bindings.select("entity_id", "provider", "external_id").distinct(),
                          ["entity_id", "provider", "external_id"], "left_anti")


def resolve_snapshots(snapshots: DataFrame, bindings: DataFrame, rules: DataFrame | None) -> DataFrame:
    """R1 to R3 over observed snapshots."""
    return rs.resolve(rs.candidates_from_snapshots(snapshots, bindings), rules, KEYS)


def mutations(canonical: DataFrame, snapshots: DataFrame, bindings: DataFrame) -> DataFrame:
    """Writable fields whose present value is not the canonical one; missing differs."""
    place = ["entity_id", "provider", "external_id", "external"]
    writable = bindings.filter("writable").select(*place, F.col("canonical").alias("property"))
    seen = snapshots.select(*place, F.col("value_json").alias("previous_json"), F.col("revision").alias("base_revision"))
    want = canonical.select(*KEYS, F.col("value_json").alias("next_json"))
    return (
        writable.join(want, KEYS)
        .join(seen, place, "left")
        .filter(~F.col("next_json").eqNullSafe(F.col("previous_json")))
    )


def proposals(entities: DataFrame, moves: DataFrame, resolved: DataFrame, doubts: DataFrame) -> DataFrame:
    """Per entity a status and an order-independent digest of its
    mutations, with the revisions they build on, and of all candidates of its
    conflicts (``doubts``, in long form); clocks left out."""
    material = moves.select(
        "entity_id", F.lit(True).alias("moves"),
        vl.json_list(F.lit("mutation"), "provider", "external_id", "external", "property", "next_json", "previous_json", "base_revision").alias("text"),
    ).unionByName(
        doubts.select(
            "entity_id", F.lit(False).alias("moves"),
            vl.json_list(F.lit("conflict"), "property", "reason", "provider", "external_id", "value_json").alias("text"),
        )
    )
    n_doubts = resolved.filter("status = 'conflict'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_conflicts"))
    # The mutations are counted where they are digested: they are read once.
    told = vl.group_digest(material, ["entity_id"], F.col("text"), counts={"n_mutations": F.col("moves")})
    none = F.lit(0).cast("bigint")
    return (
        entities.select("entity_id").distinct()
        .join(told, "entity_id", "left").join(n_doubts, "entity_id", "left")
        .select(
            "entity_id", F.coalesce("n_mutations", none).alias("n_mutations"), F.coalesce("n_conflicts", none).alias("n_conflicts"),
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"),
        )
        .withColumn(
            "status",
            F.when(F.col("n_conflicts") > 0, F.lit("blocked")).when(F.col("n_mutations") == 0, F.lit("noop")).otherwise(F.lit("ready")),
        )
    )


def plan_drift(expected: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Entities whose plan changed since it was proposed, appeared or vanished."""
    now = recomputed.select("entity_id", F.col("digest").alias("actual"))
    then = expected.select("entity_id", F.col("digest").alias("expected"))
    return then.join(now, "entity_id", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def apply_mutations(snapshots: DataFrame, moves: DataFrame, revision: str) -> DataFrame:
    """Snapshots after the mutations whose base revision still holds."""
    place = ["entity_id", "provider", "external_id", "external"]
    fresh = moves.select(*place, "next_json", "base_revision", F.lit(True).alias("hit"))
    joined = snapshots.join(fresh, place, "full_outer")
    held = F.col("hit") & F.col("revision").eqNullSafe(F.col("base_revision"))
    return joined.select(
        *place,
        F.when(held, F.col("next_json")).otherwise(F.col("value_json")).alias("value_json"),
        F.when(held, F.lit(revision)).otherwise(F.col("revision")).alias("revision"),
        "observed_at",
    ).filter("value_json IS NOT NULL")


def stale_mutations(moves: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Mutations planned on a revision that is no longer there."""
    place = ["entity_id", "provider", "external_id", "external"]
    now = snapshots.select(*place, "revision")
    return moves.join(now, place).filter(~F.col("revision").eqNullSafe(F.col("base_revision"))).select(*place)


def outcomes(before: DataFrame, left_over: DataFrame | None, drifted: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Blocked, noop, drifted, dry-run, converged or not-converged per entity.

    ``drifted`` has the entities whose plan no longer holds when it is to be
    applied; ``left_over`` the mutations that a new plan still has; a dry run does not ask for them.
    """
    joined = before
    if not dry_run:
        rest = left_over.groupBy("entity_id").agg(F.count(F.lit(1)).alias("rest"))
        joined = joined.join(rest, "entity_id", "left")
    if drifted is not None:
        joined = joined.join(drifted.select("entity_id", F.lit(True).alias("moved")), "entity_id", "left")
    else:
        joined = joined.withColumn("moved", F.lit(None).cast("boolean"))
    outcome = F.when(F.col("status") != "ready", F.col("status")).when(F.col("moved"), F.lit("drifted"))
    if dry_run:
        outcome = outcome.otherwise(F.lit("dry-run"))
    else:
        outcome = outcome.when(F.col("rest").isNull(), F.lit("converged")).otherwise(F.lit("not-converged"))
    return joined.select("entity_id", outcome.alias("outcome"))
