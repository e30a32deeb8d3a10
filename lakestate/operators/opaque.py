"""Pseudonymous descriptors: keyed tags per epoch, ordered keys, guarded diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestate.functions.values import epoch_key, hmac_pads, hmac_tag, json_list
from lakestate.operators import recordset

# Fixed value: order of the URL-safe alphabet, mapped to ranks of a binary sort.
ALPHABET = "_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
RANKS = "".join(chr(0x30 + i) for i in range(len(ALPHABET)))


def epoch_keys(spark: SparkSession, secret: bytes, epoch_ids: list[str]) -> DataFrame:
    """Pads of the epochs' keys: one row per epoch, as data, so that no plan holds key material."""
    rows = [(epoch, *map(bytearray, hmac_pads(epoch_key(secret, epoch)))) for epoch in epoch_ids]
    return spark.createDataFrame(rows, "epoch_id string, inner_pad binary, outer_pad binary")


def opaque(recs: DataFrame, secret: bytes, epoch_id: str, kind: str = "record") -> DataFrame:
    """What may be shown of each record: keyed tags and a size."""
    keys = epoch_keys(recs.sparkSession, secret, [epoch_id])
    return opaque_by_epoch(recs.withColumn("epoch_id", F.lit(epoch_id)), keys, kind)


def opaque_by_epoch(recs: DataFrame, keys: DataFrame, kind: str = "record") -> DataFrame:
    """X17 for records of many epochs at once; ``keys`` has one row per epoch."""
    tag = lambda purpose, value: hmac_tag(F.col("inner_pad"), F.col("outer_pad"), "opaque", purpose, F.col(value))
    return recs.join(keys, "epoch_id").select(
        "epoch_id", F.lit(kind).alias("object_kind"), tag("key", "key").alias("opaque_key"), tag("content", "payload_digest").alias("content_tag"),
        (F.col("payload_bytes") + 28).alias("ciphertext_bytes"),
    ).withColumn(
        "fingerprint",
        F.sha2(json_list("epoch_id", "object_kind", "opaque_key", "content_tag", "ciphertext_bytes"), 256),
    )


def order_key(tag: Column) -> Column:
    """A text whose binary order is the defined order of tags."""
    return F.translate(tag, ALPHABET, RANKS)


def violations(descs: DataFrame, max_bytes: int) -> DataFrame:
    """V7: shape of tags, size bound, recomputed fingerprint."""
    want = F.sha2(
        json_list("epoch_id", "object_kind", "opaque_key", "content_tag", "ciphertext_bytes"), 256
    )
    checks = F.array_compact(
        F.array(
            F.when(~F.col("opaque_key").rlike("^[0-9a-f]{64}$"), F.lit("key-shape")),
            F.when(~F.col("content_tag").rlike("^[0-9a-f]{64}$"), F.lit("tag-shape")),
            F.when(~F.col("object_kind").isin("record", "blob"), F.lit("kind")),
            F.when((F.col("ciphertext_bytes") <= 0) | (F.col("ciphertext_bytes") > max_bytes), F.lit("size")),
            F.when(F.col("fingerprint") != want, F.lit("fingerprint")),
        )
    )
    return descs.select("opaque_key", F.explode(checks).alias("rule"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compare within one epoch; keys of an epoch only one side has are refused.

    Tags of different epochs never match by construction, so comparing across
    epochs would report everything as different.
    """
    def sides(d: DataFrame) -> DataFrame:
        return d.select(
            "epoch_id", F.concat_ws(":", "epoch_id", "object_kind", "opaque_key").alias("key"),
            F.col("content_tag").alias("payload_digest"), "fingerprint",
        )

    a, b = sides(left), sides(right)
    left_epochs, right_epochs = a.select("epoch_id").distinct(), b.select("epoch_id").distinct()
    shared = left_epochs.join(right_epochs, "epoch_id", "left_semi")
    compared = recordset.diff(a.join(shared, "epoch_id", "left_semi"), b.join(shared, "epoch_id", "left_semi"))
    refused = (
        a.unionByName(b).join(shared, "epoch_id", "left_anti")
        .select(F.col("epoch_id").alias("key"), F.lit("epoch-mismatch").alias("status")).distinct()
    )
    return compared.unionByName(refused)
