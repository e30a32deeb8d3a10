"""Connected components by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest it knows. Rounds grow with the logarithm of a component's size, every
table stays within the number of links, and no component is ever gathered in
one place. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.session import pinned


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than u hangs on the smallest of u and its neighbours."""
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(pinned(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """u and every smaller neighbour hang on the smallest of them; links come with v < u."""
    least = pinned(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def roots(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of a link (u, v).

    Nodes are longs. Links to oneself, repeated links and nulls do no harm. No
    links give no rows.
    """
    clean = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    current = pinned(clean)
    state = _state(current)
    while state[0]:
        current = pinned(_small_star(pinned(_large_star(current).distinct())).distinct())
        after = _state(current)
        if after == state:
            break
        state = after
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
