"""The pipeline's near-duplicate stage: SimHash of shingle sets, by multi-index hashing.

Texts are linked whose sets of five-word shingles have a Jaccard similarity of
0.8 or more. A bit of a SimHash differs with the angle between two sets, 0.15 at
0.8, so a fingerprint of 64 bits cannot tell; this one has ``BITS``, the first of
which make ``SEGMENTS`` segments of ``WIDTH`` bits. A bit is set if it is set in more than half of the shingles'
hashes, each shingle once.

Each segment's values index a table. Every distinct set lists, for each segment,
the Hamming ball of radius one around its value, so sets meet whose segments
differ in two bits or fewer. What meets is verified on all bits (``DISTANCE``),
then shingle by shingle; entries of any size are linked without pairs
(``meetings``), and groups are the components of the links that hold.

By calculation a pair at exactly 0.8 meets with probability 0.88 and passes the
distance with 0.99; at 0.85 and 0.9 it meets with 0.97 and 0.999. Chance meetings grow
with the square of the corpus over 2 ** WIDTH: longer segments are for larger
corpora, and need more of them for the same recall.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import kept_rows, mixed, per_batch, text_digest, texts, utf8
from lakestate.llm.meetings import Measure, links, meet
from lakestate.llm.simhash import SEED, shingle_set
from lakestate.session import written

WORDS = 5
#: The similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
SEGMENTS, WIDTH = 12, 29
#: Bits of a fingerprint, and the largest number of them that differ.
BITS, DISTANCE = 640, 118
_SEEDS = mixed(np.arange(BITS // 64))
#: Shingles whose bits are counted at once, and fingerprints whose balls are listed at once.
_TOGETHER, _LISTED = 1024, 400


def fingerprint(shingles: np.ndarray) -> bytes:
    """The fingerprint of a set of shingle hashes; zero for an empty set."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(shingles), _TOGETHER):
        words = mixed(shingles[start : start + _TOGETHER, None] ^ _SEEDS)
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def balls(prints: np.ndarray) -> np.ndarray:
    """The entries (segment and value, mixed) of some fingerprints: a row of each, segment by segment."""
    bits = np.unpackbits(prints, axis=1, bitorder="little")[:, : SEGMENTS * WIDTH].reshape(-1, SEGMENTS, WIDTH)
    values = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(WIDTH, dtype=np.uint64))
    masks = np.array([sum(1 << b for b in chosen) for r in (0, 1) for chosen in itertools.combinations(range(WIDTH), r)], dtype=np.uint64)
    segment = np.arange(SEGMENTS, dtype=np.uint64)[:, None] << np.uint64(WIDTH)
    return mixed((values[:, :, None] ^ masks) | segment).reshape(len(prints), -1)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _LISTED):
            some = batch.slice(start, _LISTED)
            entries = balls(np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1))
            nodes = np.repeat(some.column(0).to_numpy(), entries.shape[1])
            yield pa.RecordBatch.from_pydict({"entry": pa.array(entries.reshape(-1).view(np.int64)), "node": pa.array(nodes)})


def marked(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``digest``, ``node`` (a hash of the set), ``size`` and ``sketch`` (the fingerprint) of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(text, words) for text in utf8(batch)]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], dtype=np.uint64)
        return {
            "doc_id": batch.column(0), "digest": batch.column(2), "node": pa.array(nodes.view(np.int64)),
            "size": pa.array([len(s) for s in found], pa.int64()), "sketch": pa.array([fingerprint(s) for s in found], pa.binary()),
        }

    schema = "doc_id bigint, digest string, node bigint, size bigint, sketch binary"
    return texts(docs).withColumn("digest", text_digest()).mapInArrow(per_batch(step), schema)


def similar_groups(docs: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``node`` and ``root`` of all nodes of the ``marked`` rows that are linked to another one."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("least")
    some = rows.filter("size > 0").groupBy("node").agg(least, F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = written(some, "nodes")
    met = written(meet(nodes.select("node", "sketch").mapInArrow(_listed, "entry bigint, node bigint")), "met")
    return links(met, nodes, docs, Measure(words, NUMERATOR, DENOMINATOR, lambda a, b: DISTANCE))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Documents with one row of each group of near-duplicates: the smallest id.

    Rows with equal sets of shingles are one node. Blank and null texts are
    equal. An empty table gives no rows.
    """
    rows = written(marked(docs, words), "sets")
    rooted = similar_groups(docs, rows, words)
    held = rows.select("doc_id", "digest", "node").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("least")
    return kept_rows(docs, written(held.groupBy("root").agg(first).select("least.doc_id", "least.digest"), "survivors"))
