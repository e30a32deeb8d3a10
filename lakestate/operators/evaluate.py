"""How well returned records answer known questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(returned: DataFrame, facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per (method, query) recall, contradictions, share of irrelevant records, tokens.

    returned(method, query_id, record_id, cost), facts(record_id, entity_id,
    property, value_json), expected(query_id, entity_id, property, value_json).
    """
    told = returned.join(facts, "record_id")
    want = expected.withColumnRenamed("value_json", "wanted")
    met = told.join(want, ["query_id", "entity_id", "property"]).withColumn(
        "right", F.col("value_json") == F.col("wanted")
    )
    per_fact = met.groupBy("method", "query_id", "entity_id", "property").agg(
        F.max(F.col("right").cast("int")).alias("hit"), F.sum((~F.col("right")).cast("int")).alias("wrong")
    )
    hits = per_fact.groupBy("method", "query_id").agg(F.sum("hit").alias("hits"), F.sum("wrong").alias("contradictions"))
    relevant = met.filter("right").select("method", "query_id", "record_id").distinct().groupBy("method", "query_id").agg(
        F.count(F.lit(1)).alias("relevant")
    )
    size = returned.groupBy("method", "query_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("cost").alias("tokens"))
    asked = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    methods = returned.select("method").distinct()
    # Every (method, query) pair is reported; methods are a handful of labels.
    labels = methods.agg(F.array_sort(F.collect_set("method")).alias("m")).select("m").scalar()
    every = asked.withColumn("labels", labels).withColumn("method", F.explode("labels")).drop("labels")
    joined = (
        every.join(size, ["method", "query_id"], "left")
        .join(hits, ["method", "query_id"], "left")
        .join(relevant, ["method", "query_id"], "left")
        .na.fill(0, ["n_records", "tokens", "hits", "contradictions", "relevant"])
    )
    return joined.select(
        "method", "query_id", "n_records", "tokens", "contradictions",
        F.round(F.col("hits") / F.col("wanted"), 3).alias("recall"),
        F.round(F.when(F.col("n_records") == 0, 0.0).otherwise(1 - F.col("relevant") / F.col("n_records")), 3).alias("irrelevant"),
        ((F.col("hits") == F.col("wanted")) & (F.col("contradictions") == 0)).cast("int").alias("success"),
    )


def summarise(scores: DataFrame) -> DataFrame:
    """Means per method."""
    return scores.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("success"), 4).alias("success"),
        F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("irrelevant"), 4).alias("irrelevant"),
        F.round(F.avg("tokens"), 2).alias("tokens"),
        F.sum("contradictions").alias("contradictions"),
    )


def search_disagreements(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(query, entity) pairs only one of two search methods finds."""
    both = ["query_id", "entity_id"]
    return (
        indexed.select(*both).exceptAll(scanned.select(*both)).withColumn("side", F.lit("index"))
        .unionByName(scanned.select(*both).exceptAll(indexed.select(*both)).withColumn("side", F.lit("scan")))
    )
