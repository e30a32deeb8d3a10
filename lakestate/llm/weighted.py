"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, weighted by how often each occurs. For each of
``samples`` positions every word draws r and c from a Gamma(2, 1) and beta from
[0, 1), all from hashes of word and position, so that they are the same in every
text. With weight w the word gets t = floor(ln w / r + beta) and ln a = ln c -
r (t + 1 - beta); the word with the smallest a is the sample, together with t.
Two texts have the same sample at a position with the probability of their
generalised Jaccard similarity, sum of the smaller weights by sum of the larger.

A fingerprint is 16 bits of each sample's hash, written in hex. A text without
words (null, empty, blank) has a fingerprint of its own, and likeness 1 with
other such texts only (but for chance). Rows with equal ids are ordered by their
texts' hash; null ids come last in descending order. A table of one row follows
itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import mixed, texts
from lakestate.session import written

SAMPLES = 64
#: Texts that are fingerprinted together, in bytes.
TOGETHER = 4 << 20


def _uniform(bits: np.ndarray) -> np.ndarray:
    """(0, 1) from 32 bits."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of words with weights: two arrays, words by positions."""
    low = np.uint64(0xFFFFFFFF)
    position = mixed(np.arange(samples, dtype=np.uint64) + np.uint64(1))
    first = mixed(hashes[:, None] ^ position[None, :])
    second, third = mixed(first), mixed(first ^ low)
    with np.errstate(divide="ignore"):
        r = -np.log(_uniform(first & low)) - np.log(_uniform(first >> np.uint64(32)))
        c = -np.log(_uniform(second & low)) - np.log(_uniform(second >> np.uint64(32)))
    beta = np.minimum(_uniform(third >> np.uint64(32)), np.float32(1 - 2.0**-24))
    r = np.maximum(r, np.float32(1e-12))
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
    return np.log(np.maximum(c, np.float32(1e-30))) - r * (t + np.float32(1) - beta), t.astype(np.int32)


def signatures(batch: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """16 bits of each text's samples, texts by positions."""
    words = [text.split() for text in batch]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(batch), samples), dtype=np.uint16)
    blank = mixed(np.arange(samples, dtype=np.uint64) + np.uint64(1 << 40)).astype(np.uint16)
    out[counts == 0] = blank
    if not counts.any():
        return out
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    owner = np.repeat(np.arange(len(batch), dtype=np.int64), counts)
    keys, weights = np.unique(owner << 32 | coded.indices.to_numpy().astype(np.int64), return_counts=True)
    owner, word = keys >> 32, keys & 0xFFFFFFFF
    # Each pair of a word and a weight is drawn once, however many texts have it.
    pairs, at = np.unique(word << 32 | np.minimum(weights, 0xFFFFFFFF), return_inverse=True)
    word, weight = pairs >> 32, pairs & 0xFFFFFFFF
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for low in range(0, samples, 16):  # a few positions at a time bound the memory
        high = min(samples, low + 16)
        ranked = np.empty((len(pairs), high - low), dtype=np.uint64)
        for begin in range(0, len(pairs), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            a, t = _positions(hashes[word[part]], weight[part], low, high)
            mark = mixed(hashes[word[part]][:, None] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            # Ordered by a, then by mark, so that equal bags agree; the lowest 16 bits are the sample.
            ranked[part] = _ordered(a) << np.uint64(16) | mark & np.uint64(0xFFFF)
        least = np.minimum.reduceat(ranked[at], starts, axis=0)
        out[owner[starts], low:high] = least.astype(np.uint16)
    return out


def _ordered(values: np.ndarray) -> np.ndarray:
    """Numbers in the order of 32-bit floats."""
    bits = values.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


def _positions(hashes: np.ndarray, weights: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    keyed = mixed(hashes + np.uint64(low))
    return draws(keyed, weights, high - low)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def _hex(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u2")]


def _bounds(rows: DataFrame, count: int) -> list[int]:
    """At most ``count`` - 1 ids that cut the ids into ranges of about equal size."""
    share = [i / count for i in range(1, count)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 10 * count).alias("cuts")).first()["cuts"] if share else None
    return sorted(set(cuts or []))


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows laid out by descending id in ``range``s; each range ends with a copy (``extra``) of the row after it.

    The texts are shuffled once. Only ids are read before that: cuts between the
    ranges, then the largest id of each range, whose row follows the range
    above. Both have at most one entry per range, whose number is a setting.
    """
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    ids = rows.select("doc_id")
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _bounds(ids, count)
    lowest = F.lit(-(1 << 63)).cast("bigint")
    # Ranges are numbered downwards: the largest ids are in range 0, null ids at the end of the last.
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.coalesce("doc_id", lowest))) if cuts else F.lit(0)
    placed = rows.withColumn("range", above.cast("int"))
    tops = ids.withColumn("range", above.cast("int")).groupBy("range").agg(F.max("doc_id").alias("top")).collect()
    full = sorted((t["range"], t["top"]) for t in tops)
    follows = {full[(i + 1) % len(full)][1]: r for i, (r, _) in enumerate(full)}  # whose row ends range r
    if not follows:
        return placed.withColumn("extra", F.lit(False))
    named = [(top, r) for top, r in follows.items()]
    ends = F.coalesce(*[F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("bigint")), F.lit(r)) for top, r in named]) if len(named) < 2 else _lookup(named)
    copies = placed.withColumn("range", ends.cast("int")).filter(F.col("range").isNotNull()).withColumn("extra", F.lit(True))
    return (
        placed.withColumn("extra", F.lit(False)).unionByName(copies)
        .repartition(count, "range")
        .sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), "tie")
    )


def _lookup(named: list[tuple]):
    known = [x for x in named if x[0] is not None]
    table = F.map_from_arrays(F.array(*[F.lit(top).cast("bigint") for top, _ in known]), F.array(*[F.lit(r) for _, r in known]))
    found = F.try_element_at(table, F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")))
    for top, r in named:
        if top is None:
            found = F.coalesce(F.when(F.col("doc_id").isNull(), F.lit(r)), found)
    return found


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, samples: int = SAMPLES, partitions: int | None = None) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to both the edited and the next text.

    The edited text has its last third (of the code points, rounded down)
    replaced by as many first code points of the next row's text, in descending
    order of id; the first row follows the last.
    """

    def finish(held: list[tuple[int | None, str]], following: str | None) -> pa.RecordBatch:
        own = [t for _, t in held]
        after = own[1:] + [following if following is not None else own[-1]]
        edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(own, after, strict=True)]
        raw = [t.encode() for t in own]
        changed = [t.encode() for t in edited]
        found = signatures(raw + [after[-1].encode()] + changed, samples)
        marks, new = found[: len(raw) + 1], found[len(raw) + 1 :]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([d for d, _ in held], pa.int64()), "n_chars": pa.array([len(t) for t in own], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            "fingerprint": pa.array(_hex(marks[:-1])), "edited_fingerprint": pa.array(_hex(new)),
            "near_edited": pa.array(likeness(marks[:-1], new)), "near_next": pa.array(likeness(marks[:-1], marks[1:])),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, current = 0, None
        for batch in batches:
            for doc, text, number, extra in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "extra")], strict=True):
                if number != current:
                    if held:
                        yield finish(held, None)
                    held, size, current = [], 0, number
                if extra:
                    if held:  # the first extra row is the next one; equal ids may bring more
                        yield finish(held, text)
                        held, size = [], 0
                    continue
                if size >= TOGETHER:
                    last = held.pop()
                    if held:
                        yield finish(held, last[1])
                    held, size = [last], len(last[1])
                held.append((doc, text))
                size += len(text)
        if held:
            yield finish(held, None)

    laid = with_next(docs, partitions).select("doc_id", "text", "range", "extra")
    return laid.mapInArrow(run, RESULT)
