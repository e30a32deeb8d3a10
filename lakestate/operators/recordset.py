"""Immutable keyed record sets: inventory, comparison, merge, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.session import pinned

from lakestate.functions.values import json_list

DESCRIPTOR = ["key", "kind", "record_id", "payload_digest", "payload_bytes", "fingerprint"]


def fingerprint(kind: Column, ident: Column, payload_digest: Column, size: Column) -> Column:
    """Digest over everything a descriptor says but its key, as a JSON list."""
    return F.sha2(json_list(kind, ident, payload_digest, size), 256)


def records(rows: DataFrame) -> DataFrame:
    """(kind, record_id, payload) with key, digest, size and fingerprint.

    Hashing is a projection in the scan stage: no payload is ever shuffled.
    """
    sized = rows.select(
        F.concat_ws(":", "kind", "record_id").alias("key"), "kind", "record_id", "payload",
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )
    return sized.withColumn(
        "fingerprint", fingerprint(F.col("kind"), F.col("record_id"), F.col("payload_digest"), F.col("payload_bytes"))
    )


def descriptors(recs: DataFrame) -> DataFrame:
    return recs.select(*DESCRIPTOR)


def normalize(descs: DataFrame) -> DataFrame:
    """One row per key and what is wrong with it, if anything."""
    return (
        descs.groupBy("key")
        .agg(
            F.min("kind").alias("kind"), F.min("record_id").alias("record_id"),
            F.min("payload_digest").alias("payload_digest"), F.min("payload_bytes").alias("payload_bytes"),
            F.min("fingerprint").alias("fingerprint"),
            F.max("payload_digest").alias("d2"), F.max("fingerprint").alias("f2"), F.count(F.lit(1)).alias("copies"),
        )
        .withColumn(
            "problem",
            F.when(F.col("payload_digest") != F.col("d2"), F.lit("collision")).when(
                F.col("fingerprint") != F.col("f2"), F.lit("inconsistent")
            ),
        )
        .drop("d2", "f2")
    )


def verify(recs: DataFrame) -> DataFrame:
    """Records whose digest, size, key or fingerprint disagree with the payload."""
    digest = F.sha2("payload", 256)
    size = F.octet_length("payload").cast("bigint")
    checks = F.array_compact(
        F.array(
            F.when(F.col("payload_digest") != digest, F.lit("digest")),
            F.when(F.col("payload_bytes") != size, F.lit("size")),
            F.when(F.col("key") != F.concat_ws(":", "kind", "record_id"), F.lit("key")),
            F.when(
                F.col("fingerprint")
                != fingerprint(F.col("kind"), F.col("record_id"), F.col("payload_digest"), F.col("payload_bytes")),
                F.lit("fingerprint"),
            ),
        )
    )
    return recs.select("key", F.explode(checks).alias("problem"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys on one side only, or on both with different payloads."""
    a = left.select("key", F.col("payload_digest").alias("left_digest"), F.col("fingerprint").alias("left_print"))
    b = right.select("key", F.col("payload_digest").alias("right_digest"), F.col("fingerprint").alias("right_print"))
    status = (
        F.when(F.col("right_digest").isNull(), F.lit("local-only"))
        .when(F.col("left_digest").isNull(), F.lit("remote-only"))
        .when(F.col("left_digest") != F.col("right_digest"), F.lit("collision"))
        .when(F.col("left_print") != F.col("right_print"), F.lit("inconsistent"))
    )
    return a.join(b, "key", "full_outer").withColumn("status", status).filter("status IS NOT NULL").select("key", "status")


def diff_summary(differences: DataFrame) -> DataFrame:
    return differences.groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"))


def merge(sets: list[DataFrame]) -> DataFrame:
    """Union of record sets; keys with colliding payloads come out as problems."""
    return normalize(reduce(DataFrame.unionByName, [descriptors(s) for s in sets]))


def by_keys(recs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The asked records, and the asked keys that are missing."""
    asked = keys.select("key").distinct()
    return recs.join(asked, "key", "left_semi"), asked.join(recs.select("key"), "key", "left_anti")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """X21."""
    return left.join(right.select("key"), "key", "left_semi")


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """X21."""
    return left.join(right.select("key"), "key", "left_anti")


def transfer_bytes(recs: DataFrame) -> DataFrame:
    """Size of each record on the wire."""
    wire = F.octet_length(F.to_json(F.struct(*DESCRIPTOR, "payload"))).cast("bigint")
    return recs.select("key", wire.alias("wire_bytes"))


def transfer_batches(recs: DataFrame, scope: list[str], max_rows: int, max_bytes: int) -> DataFrame:
    """Batches of records in key order, cut by rows and by bytes on the wire: batch, n, wire_bytes, first and last key.

    A key that stands for different records is not sent: its rows come out with the
    rule ``collision`` and no batch, one per key; repeats of one record travel once.
    """
    from lakestate.sources.feeds import byte_bounded_pages

    told = recs.groupBy(*scope, "key").agg(
        F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"),
        F.max(F.octet_length(F.to_json(F.struct(*DESCRIPTOR, "payload"))).cast("bigint")).alias("wire_bytes"),
    )
    told = pinned(told)
    single = told.filter("low = high").select(*scope, "key", "wire_bytes")
    batches = byte_bounded_pages(single, scope, "key", "wire_bytes", max_rows, max_bytes).join(single, [*scope, "key"])
    out = batches.groupBy(*scope, F.col("page").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("wire_bytes").alias("wire_bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    ).withColumn("rule", F.lit(None).cast("string"))
    refused = told.filter("low <> high").select(
        *scope, F.lit(None).cast("int").alias("batch"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("wire_bytes"),
        F.col("key").alias("first_key"), F.col("key").alias("last_key"), F.lit("collision").alias("rule"),
    )
    return out.unionByName(refused)


def export(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """K8: typed tables as (kind, record_id, payload): canonical JSON without nulls."""
    parts = [
        df.select(F.lit(kind).alias("kind"), F.col(ident).alias("record_id"), F.to_json(F.struct(*sorted(df.columns))).alias("payload"))
        for kind, (df, ident) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def imported(recs: DataFrame, kind: str, schema: str) -> DataFrame:
    """K9: verified records of one kind back as typed rows, with a corrupt marker."""
    bad = verify(recs).select("key").distinct()
    good = recs.filter(F.col("kind") == kind).join(bad, "key", "left_anti")
    parsed = F.from_json("payload", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return good.select(parsed.alias("r")).select("r.*")


def disagreements(rows: DataFrame, ident: str, columns: list[str], schema: str) -> DataFrame:
    """V4: stored columns that differ from the stored JSON they were taken from."""
    parsed = rows.withColumn("__json", F.from_json("payload", schema))
    checks = [
        F.when(~F.col(c).eqNullSafe(F.col("__json")[c].cast(rows.schema[c].dataType)), F.lit(c)) for c in columns
    ]
    return parsed.select(ident, F.explode(F.array_compact(F.array(*checks))).alias("column"))


def required_blobs(mutations: DataFrame) -> DataFrame:
    """One row per digest with its size; more than one size is a conflict."""
    return (
        mutations.filter(F.col("blob_digest").isNotNull())
        .groupBy(F.col("blob_digest").alias("digest"))
        .agg(
            F.min("blob_size").alias("size"), F.max("blob_size").alias("max_size"),
            F.array_sort(F.collect_set("media_type")).alias("media_types"), F.count(F.lit(1)).alias("n_references"),
        )
        .withColumn("conflict", F.col("size") != F.col("max_size"))
        .drop("max_size")
    )


def missing_blobs(required: DataFrame, have: DataFrame) -> DataFrame:
    """Required digests not held, or held with another size."""
    held = have.select("digest", F.col("size").alias("held_size"))
    return required.join(held, "digest", "left").select(
        "digest", "size",
        F.when(F.col("held_size").isNull(), F.lit("missing")).when(F.col("held_size") != F.col("size"), F.lit("size-conflict")).alias("status"),
    ).filter("status IS NOT NULL")
