"""What the operators share: reading documents, Arrow batches, hashes of fixed meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestate.functions.values import spread  # noqa: F401
from lakestate.session import prepare, ship

#: Python workers see at most so many rows and about so many bytes of text at once.
BATCH_ROWS = "2000"
BATCH_BYTES = str(16 << 20)


def settle(spark: SparkSession) -> SparkSession:
    """Session settings under which Python workers hold one bounded batch of text."""
    prepare(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return settle(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``labels`` table."""
    return settle(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no further column can clash or be read."""
    settle(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def per_batch(step: Callable[[pa.RecordBatch], dict | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that maps each batch to columns, built by ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (columns := step(batch)) is not None:
                yield pa.RecordBatch.from_pydict(columns)

    return run


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit mix of 64-bit values (splitmix64)."""
    # The constants of the public splitmix64 finaliser.
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def text_digest():
    """What tells the texts of one ``doc_id`` apart; a null text counts as empty."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def kept_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` and ``text_digest`` are a row of ``keys``, one row for each such pair.

    A null id matches a null id. Rows that repeat an id with another text are
    rows of their own; only repeats of both are the same row.
    """
    from pyspark.sql import Window

    wanted = keys.select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest")).distinct()
    marked = docs.withColumn("__digest", text_digest())
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest"))
    order = Window.partitionBy("doc_id", "__digest").orderBy(F.col("text").asc_nulls_last())
    return (
        marked.join(wanted, same, "left_semi")
        .withColumn("__kept_row", F.row_number().over(order))
        .filter("__kept_row = 1")
        .drop("__kept_row", "__digest")
    )
