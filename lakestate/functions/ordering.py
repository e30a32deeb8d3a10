"""Orders that need care at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestate.session import pinned, written


def locale(text: Column) -> Column:
    """Root-locale order for visible tie-breaks."""
    return F.collate(text, "UNICODE")


def plain(text: Column) -> Column:
    """Back to the default binary string type."""
    return F.collate(text, "UTF8_BINARY")


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal", totals: dict[str, str] | None = None) -> DataFrame:
    """Dense 1-based position of each row within ``keys`` in ``order``.

    ``totals`` names columns to be added up to each row, by the names of their sums.

    Works however many rows one key holds: rows are range-partitioned by key
    and order, counted within (partition, key), and shifted by what the key's
    earlier partitions hold. Only keys that span partitions need a shift, and
    n partitions can split at most n - 1 keys, so the shift table has fewer
    than 2n rows whatever the data. The ranged rows are written once, as a
    re-run could sample other range bounds.
    """
    ranged = pinned(
        df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    )
    local = Window.partitionBy("__part", *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: F.count(F.lit(1))} | {total: F.sum(of) for of, total in (totals or {}).items()}
    here = {name: F.row_number().over(local).cast("bigint")} | {total: F.sum(of).over(upto) for of, total in (totals or {}).items()}
    counted = ranged.groupBy("__part", *keys).agg(*[s.alias(f"__of_{c}") for c, s in sums.items()])
    spans = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__parts")).filter("__parts > 1")
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counted.join(F.broadcast(spans.drop("__parts")), keys, "left_semi")
        .withColumns({f"__shift_{c}": F.coalesce(F.sum(f"__of_{c}").over(earlier), F.lit(0)) for c in sums})
        .drop(*[f"__of_{c}" for c in sums])
    )
    return (
        ranged.withColumns(here)
        .join(F.broadcast(shifts), ["__part", *keys], "left")
        .withColumns({c: F.col(c) + F.coalesce(F.col(f"__shift_{c}"), F.lit(0)) for c in sums})
        .drop("__part", *[f"__shift_{c}" for c in sums])
    )


def with_sequence(df: DataFrame, order: list[str], start: int = 0, name: str = "seq") -> DataFrame:
    """Dense global numbers after ``start`` in ``order``, without one sorting task.

    Sorted rows are written as columns, as which they take the least room.
    """
    ranged = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sorted",
    )
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__row") + F.col("__offset") + F.lit(start + 1))
        .drop("__part", "__row", "__offset")
    )


def previous(df: DataFrame, keys: list[str], columns: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Columns of the row before, as ``prev_<name>``: an equi-join on the position.

    The position is part of the join key, so a hot key spreads over all tasks.
    """
    before = df.select(
        *keys, (F.col(ordinal) + 1).alias(ordinal), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return df.join(before, [*keys, ordinal], "left")


def as_of_lookup(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str) -> DataFrame:
    """Each left row with the right row of its key whose ``start`` is the latest not after ``at``.

    Both sides are laid out once in (key, time) order; a row takes the last
    start seen in its own partition, or the last one of the key's earlier
    partitions, so a key may hold any share of the rows on either side.
    """
    starts = right.select(*keys, F.col(start).alias("__t")).distinct().withColumn("__side", F.lit(0))
    asks = left.select(*keys, F.col(at).alias("__t")).distinct().withColumn("__side", F.lit(1))
    order = ["__t", "__side"]
    laid = pinned(
        starts.unionByName(asks).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    )
    seen = F.when(F.col("__side") == 0, F.col("__t"))
    here = Window.partitionBy("__part", *keys).orderBy(*order)
    tails = laid.groupBy("__part", *keys).agg(F.max(seen).alias("__tail"))
    spans = tails.groupBy(*keys).agg(F.count(F.lit(1)).alias("__parts")).filter("__parts > 1")
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.join(F.broadcast(spans.drop("__parts")), keys, "left_semi")
        .withColumn("__carry", F.max("__tail").over(earlier))
        .drop("__tail")
    )
    found = (
        laid.withColumn("__last", F.max(seen).over(here))
        .join(F.broadcast(carried), ["__part", *keys], "left")
        .filter("__side = 1")
        .select(*keys, F.col("__t").alias(at), F.coalesce("__last", "__carry").alias(start))
        .filter(F.col(start).isNotNull())
    )
    return left.join(found, [*keys, at]).join(right, [*keys, start])
