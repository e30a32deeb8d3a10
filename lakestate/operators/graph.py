"""One temporal hop from resolved entities, under an edge cap and a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.operators.retrieve import fill_budget


def relation_texts(edges: DataFrame, names: DataFrame, relation_types: DataFrame) -> DataFrame:
    """G1: "From alias / alias To." for each edge. ``names`` has (entity_id, name)."""
    left = names.select(F.col("entity_id").alias("from_id"), F.col("name").alias("from_name"))
    right = names.select(F.col("entity_id").alias("to_id"), F.col("name").alias("to_name"))
    words = relation_types.select(F.col("type_id").alias("relation_type"), F.array_join("aliases", " / ").alias("words"))
    text = F.concat(
        F.coalesce("from_name", "from_id"), F.lit(" "), F.coalesce("words", "relation_type"), F.lit(" "),
        F.coalesce("to_name", "to_id"), F.lit("."),
    )
    return (
        edges.join(words, "relation_type", "left")
        .join(left, "from_id", "left")
        .join(right, "to_id", "left")
        .select(*edges.columns, text.alias("text"))
    )


def relevance(query_terms: Column, text: Column) -> Column:
    return F.size(F.array_intersect(query_terms, tx.terms(tx.normalize(text))))


def relation_candidates(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges leaving each query's entity with a positive term overlap.

    ``direct`` has (query_id, entity_id, text); ``edges`` carry their text.
    """
    asked = direct.select(
        "query_id", F.col("entity_id").alias("from_id"), tx.terms(tx.normalize(F.col("text"))).alias("asked")
    )
    priced = edges.withColumn("cost", tx.record_cost(F.col("text"))).withColumn(
        "terms", tx.terms(tx.normalize(F.col("text")))
    )
    return (
        priced.join(asked, "from_id")
        .withColumn("overlap", F.size(F.array_intersect("asked", "terms")))
        .filter("overlap > 0")
        .drop("asked", "terms")
    )


def pick_edges(candidates: DataFrame, queries: DataFrame, max_edges: int) -> DataFrame:
    """In order of overlap, then cost, then id; skip what does not fit, stop at the cap.

    Cost is folded into the score as a fraction below one step of overlap, so
    the order is the same and one fold serves both budgets.
    """
    ranked = candidates.select(
        "query_id", F.col("relation_id").alias("record_id"), "cost",
        (F.col("overlap") - F.col("cost") / F.lit(1e9)).alias("score"),
    )
    picks = fill_budget(ranked, queries, max_picks=max_edges)
    return picks.withColumnRenamed("record_id", "relation_id")


def frontier(direct: DataFrame, candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Per query the entities reached: the direct one and the picked targets."""
    hop = picks.select("query_id", "relation_id").join(
        candidates.select("query_id", "relation_id", "to_id"), ["query_id", "relation_id"]
    )
    reached = hop.select("query_id", F.col("to_id").alias("entity_id"))
    return direct.select("query_id", "entity_id").unionByName(reached).distinct()


def traversal_stats(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Edges seen and taken per query, with the tokens they cost."""
    seen = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_edges"))
    taken = picks.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("traversed_edges"), F.sum("cost").alias("relation_tokens")
    )
    return seen.join(taken, "query_id", "left").na.fill(0, ["traversed_edges", "relation_tokens"])


def relation_records(edges: DataFrame) -> DataFrame:
    """Picked edges as records of the entity they leave."""
    return edges.select(
        "query_id", F.concat(F.lit("graph-relation:"), F.col("relation_id")).alias("record_id"),
        F.col("from_id").alias("entity_id"), "text",
    )


def degree_profile(edges: DataFrame) -> DataFrame:
    """Active edges per entity and type."""
    return edges.groupBy("probe_id", "from_id", "relation_type").agg(
        F.count(F.lit(1)).alias("n_edges"), F.countDistinct("to_id").alias("n_targets")
    )
