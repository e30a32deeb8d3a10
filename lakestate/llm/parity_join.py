"""N-gram Jaccard join by parity sketches.

A text's set are its distinct word shingles, by their XXH64. Two sets of sizes
a and b whose Jaccard similarity reaches t differ in at most
(a + b)(1 - t) / (1 + t) shingles, and each shingle that only one of them has
flips one bit of a parity sketch (every shingle is XORed in at one place). So the
Hamming distance of sketches bounds the difference from below.

* **Size bands.** Band k ends where its smallest size divided by t begins, so
  partners are in the same band or the next. A set is listed for its own band
  (with the larger ones of the next) and for the band before (as the larger one).
* **Pigeonhole.** For each band the places are cut into m segments, m greater
  than the largest difference D of a pair by the number of empty segments that
  are allowed for. A segment is as wide as the hashes are, and known by the XOR
  of the shingles' mixed hashes in it. D differences touch D segments at most, so
  the sketches of linked sets have an equal segment that is not empty. A set with
  more empty segments than allowed is also listed under the next seed, until it
  has few enough; of two such sets both are listed under the seed at which the
  first of them has, so empty segments are never needed.
* **Verify.** Sets that share a segment meet; who passes the Hamming distance of
  narrow sketches is compared shingle by shingle.

How entries of any size are linked without pairs is in ``meetings``.

Blank and null texts have an empty set and are linked with nothing. Texts with
fewer words than a shingle have one shingle. Repeated rows and texts with equal
sets share a node. Null ids are no id: they name no component, and a component
without any id has none. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import mixed, per_batch, text_digest, texts, utf8
from lakestate.llm.meetings import Measure, links, meet
from lakestate.llm.simhash import SEED, shingle_set
from lakestate.session import written

WORDS = 4
#: The similarity, as a fraction.
NUMERATOR, DENOMINATOR = 85, 100
#: Deviations above the mean number of empty segments that are allowed for.
DEVIATIONS = 2.5


@functools.cache
def band_start(k: int) -> int:
    """The smallest size in band k."""
    return 1 if k == 0 else band_start(k - 1) * DENOMINATOR // NUMERATOR + 1


_STARTS = [1]


def band_of(size: int) -> int:
    """The band of a size of at least 1."""
    while _STARTS[-1] <= size:
        _STARTS.append(band_start(len(_STARTS)))
    return bisect.bisect_right(_STARTS, size) - 1


def most_differing(a: int, b: int) -> int:
    """The largest difference of sets of these sizes that are linked."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def _spare(differing: int, allowed: int, size: int) -> float:
    """By how many deviations the empty segments of a set of this size stay below what is allowed for."""
    m = differing + 1 + allowed
    mean = m * (1 - 1 / m) ** size
    return (allowed - mean) / math.sqrt(mean)


@functools.cache
def segments_of(k: int) -> tuple[int, int]:
    """Number of segments in band k, and how many of them may be empty."""
    largest = band_start(k + 1) - 1
    differing = most_differing(largest, largest * DENOMINATOR // NUMERATOR)
    allowed = 0
    if differing:
        # In small bands no number is surely enough; there the best one makes do, and more sets have a second seed.
        allowed = next((x for x in range(differing + 9) if _spare(differing, x, band_start(k)) >= DEVIATIONS), None)
        if allowed is None:
            allowed = max(range(differing + 9), key=lambda x: _spare(differing, x, band_start(k)))
    return differing + 1 + allowed, allowed


def sketch(shingles: np.ndarray) -> bytes:
    """The narrow parity sketch: a power of two of bits, as many as shingles or more, 512 at least."""
    bits = max(512, 1 << max(0, len(shingles) - 1).bit_length())
    place = (mixed(shingles ^ np.uint64(0xA5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def listed(shingles: np.ndarray) -> np.ndarray:
    """The entries a set is listed in: a hash of band, seed, segment and the segment's value."""
    if not len(shingles):
        return np.empty(0, dtype=np.int64)
    own = band_of(len(shingles))
    out = []
    for k in (own, own - 1):
        if k < 0:
            continue
        m, allowed = segments_of(k)
        seed = 0
        while True:
            name = np.uint64(k << 32 | seed << 20)
            values = mixed(shingles ^ mixed(np.array([name])))
            at = ((values >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
            found = np.zeros(m, dtype=np.uint64)
            np.bitwise_xor.at(found, at, mixed(values))
            full = np.flatnonzero(np.bincount(at, minlength=m))
            out.append(mixed(found[full] ^ mixed(full.astype(np.uint64) + (name << np.uint64(20)) + np.uint64(1))))
            if m - len(full) <= allowed:
                break
            seed += 1
    return np.concatenate(out).view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``digest``, ``node`` (a hash of the set; null for none), ``size``, ``sketch`` and ``entries`` of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(text, words) for text in utf8(batch)]
        nodes = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else None for s in found]
        return {
            "doc_id": batch.column(0), "digest": batch.column(2), "node": pa.array(nodes, pa.int64()), "size": pa.array([len(s) for s in found], pa.int64()),
            "sketch": pa.array([sketch(s) for s in found], pa.binary()), "entries": pa.array([listed(s) for s in found], pa.list_(pa.int64())),
        }

    schema = "doc_id bigint, digest string, node bigint, size bigint, sketch binary, entries array<bigint>"
    return texts(docs).withColumn("digest", text_digest()).mapInArrow(per_batch(step), schema)


def similarity_join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    A component is named by the smallest document id that links reach; a row without shingles by its own.
    """
    marked = written(_sets(docs, words), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("least")
    held = marked.filter(F.col("node").isNotNull()).groupBy("node").agg(least, F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("entries").alias("entries"))
    nodes = written(held, "nodes")
    met = written(meet(nodes.select(F.explode("entries").alias("entry"), "node")), "met")
    rooted = links(met, nodes.drop("entries"), docs, Measure(words, NUMERATOR, DENOMINATOR, most_differing))
    firsts = nodes.select("node", F.col("least.doc_id").alias("own")).join(rooted, "node")
    named = firsts.groupBy("root").agg(F.min("own").alias("component"))
    known = written(firsts.join(named, "root").select("node", "component"), "components")
    whole = nodes.select("node", F.col("least.doc_id").alias("own")).join(known, "node", "left").select("node", F.coalesce("component", "own").alias("component"))
    rows = marked.select("doc_id", "node", F.col("size").alias("n_shingles"))
    return rows.join(whole, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


#: All links by shingles that texts share, and what they reach.
SQL = r"""
WITH RECURSIVE numbered AS (SELECT ROW_NUMBER() OVER () AS row_id, doc_id, text FROM documents),
words AS (
  SELECT row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM numbered),
sets AS (
  SELECT DISTINCT row_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (SELECT row_id, COUNT(*) AS n FROM sets GROUP BY row_id),
shared AS (SELECT a.row_id AS u, b.row_id AS v, COUNT(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.row_id <> b.row_id GROUP BY ALL),
linked AS (
  SELECT u, v FROM shared JOIN sizes a ON a.row_id = u JOIN sizes b ON b.row_id = v WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)),
reached AS (SELECT row_id AS u, row_id AS v FROM numbered UNION SELECT r.u, l.v FROM reached r JOIN linked l ON l.u = r.v),
named AS (SELECT r.u, MIN(d.doc_id) AS component_id FROM reached r JOIN numbered d ON d.row_id = r.v GROUP BY r.u)
SELECT d.doc_id, COALESCE(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM numbered d JOIN named c ON c.u = d.row_id LEFT JOIN sizes s ON s.row_id = d.row_id
"""
