"""Structured Streaming jobs. Capsule heads are a table per batch id in the shared folder, so a
batch that runs twice writes the same folder twice; slots and boundaries are in ``keyed``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakestate.operators import capsule as cp
from lakestate.operators import policy as po
from lakestate.session import pinned



def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run over all that has landed, then stop; the checkpoint is the cursor."""
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _upto(spark: SparkSession, root: str, schema: str, batch_id: int) -> DataFrame:
    """Rows written by batches before this one (``batch`` names the writer)."""
    try:
        rows = spark.read.option("basePath", root).schema(schema + ", batch bigint").parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema + ", batch bigint")
    return rows.filter(F.col("batch") < batch_id)


def _write(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def capsule_stream(spark: SparkSession, feed: DataFrame, tables: dict[str, DataFrame], at: str, out: str, version: str = "v1") -> StreamingQuery:
    """ST1: refresh the capsules that feed rows touch and those whose time has come by then; only touched entities are read and written."""

    def each(batch: DataFrame, batch_id: int) -> None:
        heads = current_capsules(spark, out, batch_id)
        touched = pinned(cp.to_refresh(batch, heads, F.lit(at).cast("timestamp"), version))
        fresh = cp.materialize(tables, at, only=touched, version=version)[1]
        _write(fresh.select(*HEADS), f"{out}/heads", batch_id)

    return start(feed, each, f"{out}/checkpoint")


HEADS = ["entity_id", "material_digest", "next_boundary", "configuration_version", "n_state", "n_conflict", "n_relation", "n_retraction"]
HEAD_SCHEMA = (
    "entity_id string, material_digest string, next_boundary timestamp, configuration_version string, "
    "n_state bigint, n_conflict bigint, n_relation bigint, n_retraction bigint"
)


def current_capsules(spark: SparkSession, out: str, before: int = 1 << 62) -> DataFrame:
    """The newest head of each entity."""
    rows = _upto(spark, f"{out}/heads", HEAD_SCHEMA, before)
    rest = [c for c in HEADS if c != "entity_id"]
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*rest), "batch").alias("h")).select("entity_id", "h.*")


def unfinished_stream(journal: DataFrame, patience: str, out: str) -> StreamingQuery:
    """ST4: requests without a word on them within ``patience`` of event time.

    The outer row of a stream join appears once the watermark rules out a late answer.
    """
    asked = journal.filter("type = 'mutation.requested'").select(
        "mutation_id", F.col("occurred_at").alias("requested_at")
    ).withWatermark("requested_at", "1 minute")
    done = journal.filter(F.col("type").isin("mutation.applied", "mutation.failed")).select(
        F.col("mutation_id").alias("done_id"), F.col("occurred_at").alias("done_at")
    ).withWatermark("done_at", "1 minute")
    on = F.expr(f"mutation_id = done_id AND done_at >= requested_at AND done_at <= requested_at + INTERVAL {patience}")
    late = asked.join(done, on, "left_outer").filter("done_id IS NULL").select("mutation_id", "requested_at")
    return to_files(late, out)


def dedupe_stream(messages: DataFrame, key: str, clock: str, expiry: str, out: str) -> StreamingQuery:
    """ST5, J7: a nonce counts once while it is remembered."""
    return to_files(messages.withWatermark(clock, expiry).dropDuplicatesWithinWatermark([key]), out)


def audit_stream(events: DataFrame, out: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """ST6, A14: allowed and refused per closed window."""
    return to_files(po.audit_rollup(events.withWatermark("at", late), width), out)


def to_files(df: DataFrame, out: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
