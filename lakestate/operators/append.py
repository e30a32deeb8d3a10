"""Immutable append, feed numbers, published batches."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakestate.functions.ordering import with_sequence
from lakestate.session import pinned, written

# Feed order of the record kinds.
KIND_ORDER = {"entity": 1, "alias": 2, "observation": 3, "relation": 4, "retraction": 5}

# Rows from the beginning of a feed that one task may sort.
NEAR = 1 << 16

# So many families of names are told apart by a filter at most.
FAMILIES = 256


def classify(batch: DataFrame, base: DataFrame) -> DataFrame:
    """K1, K7: per id of a batch: inserted, unchanged or collision.

    ``batch`` and ``base`` have (kind, record_id, payload); payloads compare by
    digest, and only digests are shuffled.
    """
    key = ["kind", "record_id"]
    inside = batch.select(*key, F.sha2("payload", 256).alias("digest")).groupBy(*key).agg(
        F.min("digest").alias("digest"), F.max("digest").alias("other"), F.count(F.lit(1)).alias("copies")
    )
    held = base.select(*key, F.sha2("payload", 256).alias("held"))
    return inside.join(held, key, "left").select(
        *key, "digest", "copies",
        F.when((F.col("digest") != F.col("other")) | (F.col("held") != F.col("digest")), F.lit("collision"))
        .when(F.col("held").isNotNull(), F.lit("unchanged"))
        .otherwise(F.lit("inserted")).alias("action"),
    )


def unknown_refs(observations: DataFrame, aliases: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """K2: rows that name entities nobody declared.

    Names are compared before rows: each name of a rule once, without the row that has it. Only rows whose
    name is of a family (all before the last slash) with an unknown one are shuffled to meet these; where
    such families are many, all rows are.
    """
    family = F.coalesce(F.regexp_extract("entity_id", "^(.*)/", 1), F.lit(""))
    rules = {
        "observation-entity": (observations, "observation_id", "entity_id"),
        "alias-entity": (aliases, "alias_id", "entity_id"),
        "relation-from": (relations, "relation_id", "from_id"),
        "relation-to": (relations, "relation_id", "to_id"),
    }

    def names(rule: str) -> DataFrame:
        df, _, ref = rules[rule]
        return df.select(F.col(ref).alias("entity_id")).distinct().withColumn("rule", F.lit(rule))

    every = reduce(DataFrame.unionByName, [names(rule) for rule in rules])
    # Written, so that its size is known where the rows are read.
    unknown = written(every.join(entities.select("entity_id"), "entity_id", "left_anti"), "unknown")
    found = unknown.select("rule", family.alias("family")).distinct().limit(FAMILIES + 1).collect()

    def lost(rule: str) -> DataFrame:
        df, ident, ref = rules[rule]
        rows = df.select(F.col(ident).alias("id"), F.col(ref).alias("entity_id"))
        if len(found) <= FAMILIES:
            rows = rows.filter(family.isin([f["family"] for f in found if f["rule"] == rule]))
        hit = unknown.filter(F.col("rule") == rule).select(F.col("entity_id").alias("lost_id"))
        # A row that names nobody names an unknown entity.
        return rows.join(hit, F.col("entity_id").eqNullSafe(F.col("lost_id")), "left_semi").select("id", "entity_id", F.lit(rule).alias("rule"))

    return reduce(DataFrame.unionByName, [lost(rule) for rule in rules])


def retraction_changes(retractions: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """K3: feed rows of retractions. One of an observation touches its entity, one of a relation both ends.

    Kinds are joined apart and written, so that only one join's shuffles are on disk at once; a relation has its
    two ends in one row until it has met its retraction.
    """
    def of(kind: str, targets: DataFrame, owners: Column) -> DataFrame:
        asked = retractions.filter(F.col("target_kind") == kind).select("retraction_id", "target_id")
        met = asked.join(targets, "target_id").select("retraction_id", F.explode(owners).alias("primary_entity_id"))
        return written(met, "retraction-changes").select(
            F.lit("retraction").alias("kind"), F.col("retraction_id").alias("record_id"), "primary_entity_id"
        )

    said = observations.select(F.col("observation_id").alias("target_id"), "entity_id")
    tied = relations.select(F.col("relation_id").alias("target_id"), "from_id", "to_id")
    return of("observation", said, F.array("entity_id")).unionByName(of("relation", tied, F.array_distinct(F.array("from_id", "to_id"))))


def emit_changes(rows: DataFrame, last_seq: int) -> DataFrame:
    """K3: feed rows (kind, record_id, primary_entity_id) numbered after ``last_seq``
    in kind order, then id, then entity, without gathering the rows in one task.

    Each kind is sorted and written alone, so that only one kind's shuffle is on disk at once. Kinds
    without a place come first.
    """
    kind = F.col("kind")
    parts, done = [], last_seq
    for own in [kind.isNull() | ~kind.isin(*KIND_ORDER), *[kind == k for k in sorted(KIND_ORDER, key=KIND_ORDER.get)]]:
        numbered = with_sequence(rows.filter(own), ["record_id", "primary_entity_id"], done)
        parts.append(numbered)
        done += numbered.count()
    return reduce(DataFrame.unionByName, parts)


def emit_page(rows: DataFrame, last_seq: int, after: int, limit: int) -> DataFrame:
    """K3, S3: one page of the feed that ``emit_changes`` would number.

    A page near the beginning needs the rows up to its end only: every task keeps its first so many,
    and these alone are numbered. Further on the whole feed is.
    """
    upto = max(after, last_seq) - last_seq + limit
    if upto <= NEAR:
        rank = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])[F.col("kind")]
        rows = rows.orderBy(rank, "record_id", "primary_entity_id").limit(upto)
    return changes_after(emit_changes(rows, last_seq), after, limit)


def append_batch(spark: SparkSession, root: str, batch_id: str, batch: DataFrame) -> DataFrame:
    """K1 as a sink: write the new rows under the batch id, then publish it.

    A batch with any collision is refused whole. Rows become visible when the
    marker file of their batch exists; writing the same batch again after a
    crash overwrites its own folder only.
    """
    batch = pinned(batch)
    base = read_published(spark, root, batch.schema)
    verdict = pinned(classify(batch, base))
    refused = verdict.filter("action = 'collision'").limit(1).count() > 0
    counts = verdict.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    if refused:
        return counts.withColumn("published", F.lit(False))
    fresh = batch.dropDuplicates(["kind", "record_id"]).join(
        verdict.filter("action = 'inserted'").select("kind", "record_id"), ["kind", "record_id"], "left_semi"
    )
    folder = quote(batch_id, safe="")
    fresh.write.mode("overwrite").parquet(f"{root}/data/batch={folder}")
    spark.range(1).select(F.lit(batch_id).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{root}/published/{folder}")
    return counts.withColumn("published", F.lit(True))


def read_published(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of published batches only; an absent table is empty."""
    from pyspark.errors import AnalysisException

    try:
        marks = spark.read.schema("batch string").parquet(f"{root}/published/*")
        data = spark.read.option("basePath", f"{root}/data").schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(f"{root}/data")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # The partition column: folders of other batches are pruned, and escaped ids come back as they were.
    return data.join(marks, "batch", "left_semi").drop("batch")


def changes_after(feed: DataFrame, after: int, limit: int) -> DataFrame:
    """S3: one ordered page of the feed."""
    return feed.filter(F.col("seq") > after).orderBy("seq").limit(limit)


def bootstrap_view(entities: DataFrame, feed: DataFrame) -> DataFrame:
    """All entity ids with the number the feed ended at."""
    tail = feed.agg(F.max("seq").alias("seq")).select("seq").scalar()
    return entities.select("entity_id", tail.alias("change_seq"))


def classify_upsert(new: DataFrame, old: DataFrame) -> DataFrame:
    """K4: inserted, updated or unchanged per entity, on digest and configuration."""
    held = old.select("entity_id", F.col("material_digest").alias("d"), F.col("configuration_version").alias("v"))
    same = (F.col("material_digest") == F.col("d")) & (F.col("configuration_version") == F.col("v"))
    return new.join(held, "entity_id", "left").select(
        "entity_id", F.when(F.col("d").isNull(), F.lit("inserted")).when(same, F.lit("unchanged")).otherwise(F.lit("updated")).alias("action")
    )


def latest_projection(history: DataFrame, order: str) -> DataFrame:
    """K5: the last projection of each resource."""
    res = ["source_key", "external_type", "external_id"]
    rest = [c for c in history.columns if c not in res]
    return history.groupBy(*res).agg(F.max_by(F.struct(*rest), order).alias("p")).select(*res, "p.*")
