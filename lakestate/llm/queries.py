"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakestate.llm import (
    automaton, chunking, common, grammar, merkle_manifest, packing, parity_join, quality, ranked_search, repetition, secret_scan, simhash, toxicity, weighted,
)
from lakestate.session import run_dir

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, 2 bits."""
    return simhash.near_duplicates(common.documents(spark, sf_dir), words=3, distance=2)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as Re-Pair grammars in doc_id order, and read back."""
    path = run_dir(spark, "tokens")
    grammar.write_tokens(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), path, end_id=2)
    return grammar.read_tokens(spark, path)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with suffix arrays over every document."""
    columns = ["doc_id", *repetition.COUNTS, "base_failed", "kept"]
    return repetition.rules(common.documents(spark, sf_dir)).select(*columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.scan(common.documents(spark, sf_dir), public_tokenizers.path(RANKS))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    return chunking.dedup(common.documents(spark, sf_dir))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the tokenization automaton."""
    return automaton.encode_and_decode(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by boosted trees."""
    docs = common.documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, common.labels(spark, sf_dir)))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return weighted.fingerprints(common.documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by two Kneser-Ney models."""
    docs = common.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, common.labels(spark, sf_dir)))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witness of every document, folded with the leaf of its tampered text."""
    return merkle_manifest.verify(merkle_manifest.manifest(common.documents(spark, sf_dir), merkle_manifest.tampered_text()))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), k=10)


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by four-word shingles with a Jaccard similarity of 0.85 or more."""
    return parity_join.similarity_join(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_token_files, op3_repetition, op4_secrets, op5_chunk_dedup, op6_bpe_automaton, op7_quality_trees,
        op8_weighted_sampling, op9_toxicity, op10_best_fit, op11_merkle_manifest, op12_ranked_search,
        op13_parity_join,
    )
}
ORACLES: dict[str, str] = {"op12_ranked_search": ranked_search.SQL, "op13_parity_join": parity_join.SQL}
