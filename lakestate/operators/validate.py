"""Rules per record kind; violations come out as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.functions import values as vl


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


def _bad_entity(name: str) -> Column:
    return ~F.coalesce(F.col(name).startswith("entity://") & (F.length(name) > 9), F.lit(False))


def _bad_clock(name: str) -> Column:
    return F.col(name).isNotNull() & vl.parse_clock(F.col(name)).isNull()


def _inverted(start: str, end: str) -> Column:
    return F.coalesce(vl.parse_clock(F.col(end)) <= vl.parse_clock(F.col(start)), F.lit(False))


# Rule codes per kind. Clocks arrive as text here.
RULES = {
    "entity": lambda: {"entity-id": _bad_entity("entity_id"), "type": _blank("entity_type")},
    "alias": lambda: {
        "id": _blank("alias_id"), "entity-id": _bad_entity("entity_id"),
        "empty-alias": F.coalesce(tx.normalize(F.col("value")) == "", F.lit(True)), "recorded-at": _bad_clock("recorded_at"),
    },
    "observation": lambda: {
        "id": _blank("observation_id"), "entity-id": _bad_entity("entity_id"), "property": _blank("property"),
        "provider": _blank("provider"), "external-id": _blank("external_id"),
        "value": F.try_parse_json("value_json").isNull(),
        "valid-from": F.col("valid_from").isNull() | _bad_clock("valid_from"), "valid-to": _bad_clock("valid_to"),
        "recorded-at": F.col("recorded_at").isNull() | _bad_clock("recorded_at"),
        "interval": _inverted("valid_from", "valid_to"),
    },
    "relation": lambda: {
        "id": _blank("relation_id"), "from": _bad_entity("from_id"), "to": _bad_entity("to_id"), "type": _blank("relation_type"),
        "valid-from": F.col("valid_from").isNull() | _bad_clock("valid_from"), "valid-to": _bad_clock("valid_to"),
        "recorded-at": F.col("recorded_at").isNull() | _bad_clock("recorded_at"), "interval": _inverted("valid_from", "valid_to"),
    },
    "retraction": lambda: {
        "id": _blank("retraction_id"), "kind": ~F.coalesce(F.col("target_kind").isin("observation", "relation"), F.lit(False)),
        "target": _blank("target_id"), "effective-from": F.col("effective_from").isNull() | _bad_clock("effective_from"),
        "recorded-at": F.col("recorded_at").isNull() | _bad_clock("recorded_at"),
    },
    "artifact": lambda: {
        "id": _blank("mutation_id"), "resource": _blank("external_id"),
        "kind": ~F.coalesce(F.col("kind").isin("upsert", "delete"), F.lit(False)),
        "digest": (F.col("kind") == "upsert") & ~F.coalesce(F.col("blob_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "media-type": (F.col("kind") == "upsert") & ~F.coalesce(F.col("media_type").rlike("^[^/ ]+/[^/ ]+$"), F.lit(False)),
        "blob-on-delete": (F.col("kind") == "delete") & F.col("blob_digest").isNotNull(),
        "title": F.col("title").rlike(r"\S") == F.lit(False),
    },
    "journal": lambda: {
        "id": _blank("event_id"), "run": _blank("run_id"), "actor": _blank("actor_subject"),
        "type": ~F.coalesce(
            F.col("type").isin(
                "run.started", "run.finished", "snapshot.observed", "plan.created", "mutation.requested",
                "mutation.applied", "mutation.failed", "plan.drifted",
            ), F.lit(False),
        ),
    },
    "change": lambda: {
        "id": _blank("change_id"), "source": _blank("source_key"), "resource": _blank("external_id"),
        "kind": ~F.coalesce(F.col("kind").isin("upsert", "delete"), F.lit(False)),
        "payload": (F.col("kind") == "upsert") & F.col("props").isNull(),
    },
    "capsule": lambda: {
        "entity-id": _bad_entity("entity_id"), "version": _blank("configuration_version"),
        "digest": ~F.coalesce(F.col("material_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "boundary": F.coalesce(F.col("next_boundary") <= F.col("materialized_at"), F.lit(False)),
    },
}


def violations(kind: str, df: DataFrame, ident: str) -> DataFrame:
    """V1, V5, V8: (id, rule) for every broken rule."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in RULES[kind]().items()]))
    return df.select(F.col(ident).alias("id"), F.explode(broken).alias("rule"))


def valid(kind: str, df: DataFrame) -> DataFrame:
    """Rows that break no rule."""
    every = list(RULES[kind]().values())
    bad = every[0]
    for rule in every[1:]:
        bad = bad | rule
    return df.filter(~bad)


def duplicate_ids(df: DataFrame, ident: str) -> DataFrame:
    """V2: ids that occur more than once, equal content or not."""
    return df.groupBy(F.col(ident).alias("id")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def identity_violations(entities: DataFrame, aliases: DataFrame, types: DataFrame, relations: DataFrame, relation_types: DataFrame) -> DataFrame:
    """V3: unknown types and endpoints, entities without a name."""
    def rule(df: DataFrame, ident: str, code: str) -> DataFrame:
        return df.select(F.col(ident).alias("id"), F.lit(code).alias("rule"))

    known = entities.select("entity_id")
    return (
        rule(entities.join(types.select(F.col("type_id").alias("entity_type")), "entity_type", "left_anti"), "entity_id", "unknown-type")
        .unionByName(rule(entities.join(aliases.select("entity_id"), "entity_id", "left_anti"), "entity_id", "no-alias"))
        .unionByName(rule(
            relations.join(relation_types.select(F.col("type_id").alias("relation_type")), "relation_type", "left_anti"),
            "relation_id", "unknown-relation-type"))
        .unionByName(rule(relations.join(known.withColumnRenamed("entity_id", "from_id"), "from_id", "left_anti"), "relation_id", "unknown-from"))
        .unionByName(rule(relations.join(known.withColumnRenamed("entity_id", "to_id"), "to_id", "left_anti"), "relation_id", "unknown-to"))
    )


def projection_violations(projections: DataFrame, slots: DataFrame) -> DataFrame:
    """V6: repeated slot keys, empty record ids, deleted resources with open slots."""
    res = ["source_key", "external_type", "external_id"]
    repeated = slots.groupBy(*res, "slot_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*res, F.lit("repeated-slot").alias("rule"))
    empty = slots.filter(_blank("record_id")).select(*res, F.lit("empty-record").alias("rule"))
    gone = projections.filter("deleted").select(*res).join(slots, res, "left_semi").select(*res, F.lit("open-slots").alias("rule"))
    return repeated.unionByName(empty).unionByName(gone)
