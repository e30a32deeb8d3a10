"""Names to entities: n-gram equi-joins, scores, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestate.functions import text as tx


def alias_index(aliases: DataFrame) -> DataFrame:
    """I8: normalised names with their score, one row per (entity, name).

    The set of token counts in use is kept per row and is small: it is the
    only thing the query side needs to cut its n-grams.
    """
    named = tx.with_normalized(aliases, "value", "norm").filter("norm <> ''")
    return (
        named.groupBy("entity_id", "norm")
        .agg(F.min("value").alias("value"), F.min("recorded_at").alias("recorded_at"))
        .withColumn("tokens", tx.token_count(F.col("norm")))
        .withColumn("score", tx.alias_score(F.col("norm")))
    )


def lookup_alias(values: DataFrame, index: DataFrame, entities: DataFrame) -> DataFrame:
    """Exact normalised names to entities. ``values`` has (value)."""
    asked = tx.with_normalized(values, "value", "norm").select("value", "norm").distinct()
    return asked.join(index.select("norm", "entity_id"), "norm").join(entities, "entity_id")


def query_ngrams(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, norm) for each token run whose length some name has."""
    lengths = index.agg(F.collect_set("tokens").alias("lengths")).select("lengths").scalar()
    tokens = tx.with_normalized(queries, "text", "qnorm").select(
        "query_id", F.split("qnorm", " ").alias("tokens"), lengths.alias("lengths")
    )
    by_length = tokens.select("query_id", "tokens", F.explode("lengths").alias("n"))
    grams = F.array_distinct(tx.ngrams(F.col("tokens"), F.col("n")))
    return by_length.select("query_id", F.explode(grams).alias("norm")).filter("norm <> ''")


def match_aliases(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Names standing in a query as whole-token phrases."""
    return query_ngrams(queries, index).join(
        index.select("norm", "entity_id", "value", "score"), "norm"
    )


def untyped(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Every entity one of whose names the query contains."""
    return match_aliases(queries, index).select("query_id", "entity_id").distinct()


def scan_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, qnorm, norm): each distinct name beside the queries that have its rarest token.

    No name is in a query that lacks one of its tokens, so these are all that can match, and a word
    that many names and queries have pairs nothing.
    """
    tokens = tx.with_normalized(queries, "text", "qnorm")
    held = tokens.select("query_id", "qnorm", F.explode(F.array_distinct(F.split("qnorm", " "))).alias("token"))
    asked = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    names = index.select("norm").distinct().select("norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("token"))
    rarest = names.join(asked, "token", "left").groupBy("norm").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    return held.join(rarest, "token").select("query_id", "qnorm", "norm")


def scanned(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``untyped`` without n-grams, by testing containment."""
    inside = F.concat(F.lit(" "), "qnorm", F.lit(" ")).contains(F.concat(F.lit(" "), "norm", F.lit(" ")))
    found = scan_pairs(queries, index).filter(inside).select("query_id", "norm")
    return found.join(index.select("norm", "entity_id"), "norm").select("query_id", "entity_id").distinct()


def type_cues(queries: DataFrame, entity_types: DataFrame) -> DataFrame:
    """Best cue score per (query, type)."""
    cues = entity_types.select(F.col("type_id").alias("entity_type"), F.explode("aliases").alias("value"))
    scored = tx.with_normalized(cues, "value", "norm").filter("norm <> ''").select(
        "entity_type", "norm", tx.token_count(F.col("norm")).alias("tokens"), tx.alias_score(F.col("norm")).alias("cue_score"),
        F.col("value").alias("cue"),
    )
    return (
        query_ngrams(queries, scored)
        .join(scored, "norm")
        .groupBy("query_id", "entity_type")
        .agg(F.max("cue_score").alias("cue_score"), F.array_sort(F.collect_set("cue")).alias("cues"))
    )


def score_candidates(queries: DataFrame, index: DataFrame, entities: DataFrame, entity_types: DataFrame) -> DataFrame:
    """I4: best name, plus 10,000 and the best cue when a cue of the type occurs.

    A query holds few names of one entity, so the name list stays short.
    """
    best = (
        match_aliases(queries, index)
        .groupBy("query_id", "entity_id")
        .agg(F.max("score").alias("alias_score"), F.array_sort(F.collect_set("value")).alias("matched"))
    )
    typed = best.join(entities, "entity_id").join(
        entity_types.select(F.col("type_id").alias("entity_type")), "entity_type", "left_semi"
    )
    return typed.join(type_cues(queries, entity_types), ["query_id", "entity_type"], "left").withColumn(
        "score", F.col("alias_score") + F.when(F.col("cue_score").isNull(), 0).otherwise(10000 + F.col("cue_score"))
    )


def match_evidence(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Evidence of the matched names, one row per (query, entity, reference)."""
    named = tx.with_normalized(aliases, "value", "norm").select("entity_id", "norm", F.explode("evidence_refs").alias("ref"))
    hit = candidates.select("query_id", "entity_id", F.explode("matched").alias("value"))
    return (
        tx.with_normalized(hit, "value", "norm").join(named, ["entity_id", "norm"]).select("query_id", "entity_id", "ref").distinct()
    )


def resolve_entities(queries: DataFrame, index: DataFrame, entities: DataFrame, entity_types: DataFrame) -> DataFrame:
    """One row per query: none, resolved with its entity, or ambiguous with the tie size.

    Ties are counted by aggregation, so a name shared by very many entities
    costs no sort.
    """
    scored = score_candidates(queries, index, entities, entity_types)
    by_score = scored.groupBy("query_id", "score").agg(
        F.count(F.lit(1)).alias("tied"), F.min("entity_id").alias("entity_id")
    )
    top = by_score.groupBy("query_id").agg(
        F.max(F.struct("score", "tied", "entity_id")).alias("t"), F.sum("tied").alias("n_candidates")
    )
    return queries.select("query_id").join(top, "query_id", "left").select(
        "query_id",
        F.when(F.col("t").isNull(), F.lit("none"))
        .when(F.col("t.tied") == 1, F.lit("resolved"))
        .otherwise(F.lit("ambiguous")).alias("status"),
        F.when(F.col("t.tied") == 1, F.col("t.entity_id")).alias("entity_id"),
        F.col("t.score").alias("score"),
        F.col("t.tied").alias("tied"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k best entities per query by name score, entity id on ties.

    The constant rank limit lets Spark cut each group before the shuffle.
    """
    best = match_aliases(queries, index).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hydrate(entities: DataFrame, aliases: DataFrame, known_at: Column | None = None) -> DataFrame:
    """Entities with their known first name (in alias id order) and name count."""
    known = aliases if known_at is None else aliases.filter(F.col("recorded_at") <= known_at)
    names = known.groupBy("entity_id").agg(
        F.min_by("value", "alias_id").alias("name"), F.count(F.lit(1)).alias("n_aliases")
    )
    return entities.join(names, "entity_id", "left").select(
        "entity_id", "entity_type", F.coalesce("name", "entity_id").alias("name"),
        F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"),
    )


def ambiguous_names(index: DataFrame) -> DataFrame:
    """Names that several entities carry."""
    return index.groupBy("norm").agg(F.count(F.lit(1)).alias("n_entities")).filter("n_entities > 1")
