"""From raw documents to packed training sequences.

Five stages, each over all rows that the one before kept, written as Parquet and
read again in between:

1. quality: documents that the boosted trees reject go;
2. near-duplicates: of each group of texts with like five-word shingles the smallest id stays;
3. substrings: passages that an earlier document has are cut out of the texts;
4. secrets: their spans are masked in the texts;
5. packing: the texts' tokens, best-fit packed into sequences of 2048.

All but the last return the columns of ``documents``; ``n_chars`` follows the
texts as they are shortened and masked. The steps are a fitted model, hashes and a tokenizer, which
SQL does not express, so there is no statement; the stages are tested against
brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestate.llm import chunking, common, near_copies, packing, quality, secret_scan
from lakestate.session import written


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, as the length of the text; null texts keep theirs."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of sufficient quality; the trees learn from the labelled rows among ``docs``."""
    return quality.accepted(docs, quality.learn(docs, common.labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return near_copies.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts."""
    return _counted(chunking.without_repeats(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return _counted(secret_scan.mask(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' tokens into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_trees", quality_stage),
    ("simhash_near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("secret_masking", secret_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
