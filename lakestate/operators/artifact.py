"""Versioned documents over content-addressed bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.operators.temporal import Probe, at_probes

RESOURCE = ["source_key", "external_type", "external_id"]


def resource_uri() -> Column:
    """Stable address of a resource."""
    return F.concat(F.lit("artifact://resource/"), F.sha2(F.to_json(F.array(*RESOURCE)), 256))


def version_uri() -> Column:
    return F.concat(F.lit("artifact://version/"), F.sha2(F.to_json(F.array(*RESOURCE, "mutation_id")), 256))


def blob_uri(digest: Column) -> Column:
    return F.concat(F.lit("artifact://blob/"), digest)


def put_blobs(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """K6: bytes not yet held, once per digest; addressed before anything is shuffled.

    Copies are told apart by digest alone and the bytes travel once per digest.
    """
    named = incoming.select(F.sha2("bytes", 256).alias("digest"), F.length("bytes").cast("bigint").alias("size"), "bytes")
    return named.join(held.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])


def append_violations(mutations: DataFrame, blobs: DataFrame) -> DataFrame:
    """upserts whose bytes are absent or of another size."""
    have = blobs.select(F.col("digest").alias("blob_digest"), F.col("size").alias("held"))
    return mutations.filter("kind = 'upsert'").join(have, "blob_digest", "left").select(
        "mutation_id",
        F.when(F.col("held").isNull(), F.lit("missing-blob")).when(F.col("held") != F.col("blob_size"), F.lit("size-mismatch")).alias("rule"),
    ).filter("rule IS NOT NULL")


def catalog(mutations: DataFrame) -> DataFrame:
    """one row per resource with its address and number of versions."""
    return mutations.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("n_versions")).withColumn("uri", resource_uri())


def uri_collisions(rows: DataFrame) -> DataFrame:
    """addresses that stand for more than one resource."""
    return rows.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def as_of(mutations: DataFrame, probes: list[Probe]) -> DataFrame:
    """the version of every resource at each probe: none, deleted or present.

    A max over (effective, recorded, id) combines before the shuffle, so a
    resource with very many versions is no burden.
    """
    order = F.struct("effective_at", "recorded_at", "mutation_id")
    seen = at_probes(
        mutations, probes, lambda p: (F.col("recorded_at") <= p["known_at"]) & (F.col("effective_at") <= p["valid_at"])
    )
    best = seen.groupBy("probe_id", *RESOURCE).agg(
        F.max_by(F.struct("mutation_id", "kind", "blob_digest", "blob_size"), order).alias("m")
    )
    asked = at_probes(mutations.select(*RESOURCE).distinct(), probes, lambda p: F.lit(True)).select("probe_id", *RESOURCE)
    return asked.join(best, ["probe_id", *RESOURCE], "left").select(
        "probe_id", *RESOURCE, "m.mutation_id", "m.blob_digest", "m.blob_size",
        F.when(F.col("m").isNull(), F.lit("none")).when(F.col("m.kind") == "delete", F.lit("deleted")).otherwise(F.lit("present")).alias("status"),
    )


def history(mutations: DataFrame) -> DataFrame:
    """versions in order with the one before, by position and equi-join."""
    from lakestate.functions.ordering import previous, with_ordinal

    placed = with_ordinal(
        mutations.select(*RESOURCE, "effective_at", "recorded_at", "mutation_id", "kind", "blob_digest"),
        RESOURCE, ["effective_at", "recorded_at", "mutation_id"],
    )
    return previous(placed, RESOURCE, ["mutation_id", "blob_digest"])


def unreferenced(blobs: DataFrame, mutations: DataFrame) -> DataFrame:
    """stored bytes no version points to."""
    return blobs.select("digest").distinct().join(mutations.select(F.col("blob_digest").alias("digest")), "digest", "left_anti")


def unindexed(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """files (path) in the store whose digest the index does not have."""
    named = files.select("path", F.regexp_extract("path", r"([0-9a-f]{64})", 1).alias("digest"))
    return named.join(blobs.select("digest"), "digest", "left_anti").select("path")


def read_ranges(requests: DataFrame, blobs: DataFrame, max_bytes: int) -> DataFrame:
    """(digest, start, length) requests with their bytes or a refusal."""
    end = F.col("start") + F.col("length")
    rule = (
        F.when(F.col("size").isNull(), F.lit("not-found"))
        .when((F.col("start") < 0) | (F.col("length") <= 0), F.lit("bad-range"))
        .when(F.col("length") > max_bytes, F.lit("too-long"))
        .when(end > F.col("size"), F.lit("past-end"))
        .otherwise(F.lit("ok"))
    )
    return requests.join(blobs.select("digest", "size", "bytes"), "digest", "left").withColumn("status", rule).withColumn(
        "range", F.when(F.col("status") == "ok", F.col("bytes").substr(F.col("start").cast("int") + 1, F.col("length").cast("int")))
    ).drop("bytes")


def audit(blobs: DataFrame) -> DataFrame:
    """F8: stored bytes that do not have the digest or size they are filed under."""
    checks = F.array_compact(
        F.array(
            F.when(F.sha2("bytes", 256) != F.col("digest"), F.lit("digest")),
            F.when(F.length("bytes") != F.col("size"), F.lit("size")),
        )
    )
    return blobs.select("digest", F.explode(checks).alias("problem"))
