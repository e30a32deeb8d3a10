"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes: at each byte it is shifted by one bit and
a number drawn for the byte is added, so it depends on the last 32 bytes alone.
A chunk may end before a word where the hash of the bytes before it has
``cut_bits`` zero bits; so chunk ends depend on the text around them, and an
insertion moves only the ends next to it. Chunks have ``min_words`` to
``max_words`` words and are identified by a 128-bit digest of their words.

The first document with a chunk keeps it, by ascending id (null ids last) and then
by the hash of the text, and within a document its first occurrence; all others
are duplicates. Duplicate chunks that follow
each other form a run; runs of ``min_run`` words or more are cut out of the text.
Shorter runs (a shared line, a common phrase) stay.

Digests are counted with map-side combining, and duplicates found by an
equi-join on the digest whose hot keys Spark can split; a digest shared by any
share of the documents never meets in one task. Texts are shuffled once, to meet
their own spans.

Null and empty texts have no chunks and stay as they are. Rows that have both the
id (or none) and the text in common are repeats of one document and get equal
results; rows that share an id, or have none, with different texts are documents
of their own. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import mixed, per_batch, settle, utf8
from lakestate.session import written

MIN_WORDS, CUT_BITS, MAX_WORDS, MIN_RUN = 4, 2, 16, 12
WINDOW = 32
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LAST = (1 << 63) - 1


@functools.lru_cache(maxsize=1)
def gears() -> np.ndarray:
    """A 32-bit number for each byte."""
    return (mixed(np.arange(256, dtype=np.uint64) + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling the window: 1, 2, 4, ... 32 bytes."""
    h = gears()[raw]
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span)
        h = h + shifted
        span *= 2
    return h


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a text's bytes."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def chunk_words(text: bytes, starts: np.ndarray, min_words: int, cut_bits: int, max_words: int) -> np.ndarray:
    """Numbers of the words that begin a chunk, and the number of words at the end."""
    n = len(starts)
    before = rolling(np.frombuffer(text, np.uint8))[starts[1:] - 1]
    ends = np.flatnonzero((before >> np.uint32(32 - cut_bits)) == 0) + 1
    cuts, last = [0], 0
    for end in ends.tolist():
        while end - last > max_words:
            last += max_words
            cuts.append(last)
        if end - last >= min_words:
            last = end
            cuts.append(last)
    while n - last > max_words:
        last += max_words
        cuts.append(last)
    cuts.append(n)
    return np.array(cuts, dtype=np.int64)


def chunks_of(text: bytes, min_words: int = MIN_WORDS, cut_bits: int = CUT_BITS, max_words: int = MAX_WORDS) -> list[tuple[int, int, int, int]]:
    """(digest, first word, words, byte start) of each chunk of a text."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(raw)
    if not len(starts):
        return []
    words = _WORD.findall(text)
    cuts = chunk_words(text, starts, min_words, cut_bits, max_words).tolist()
    digest = xxhash.xxh3_128_intdigest
    return [(digest(b" ".join(words[a:b])), a, b - a, int(starts[a])) for a, b in zip(cuts, cuts[1:], strict=False)]


CHUNKS = "owner decimal(38,0), high bigint, low bigint, first_word int, words int, again boolean"
#: Bits of the text's hash in an owner: with 64 of the id they fit a decimal of 38 digits.
_MARK_BITS = 61


def _owner() -> Column:
    """One number that orders documents by id, null ids last, and by a hash of their text."""
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).cast("decimal(19,0)")
    mark = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << _MARK_BITS) - 1)).cast("decimal(19,0)")
    return (number * F.lit(1 << _MARK_BITS).cast("decimal(19,0)") + mark).cast("decimal(38,0)")


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with the place of their documents in the order (``owner``)."""
    settle(docs.sparkSession)
    return docs.select(_owner().alias("owner"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def chunks(docs: DataFrame, min_words: int = MIN_WORDS, cut_bits: int = CUT_BITS, max_words: int = MAX_WORDS) -> DataFrame:
    """All chunks of all texts; ``again`` marks those that occurred before in their text."""

    def step(batch: pa.RecordBatch) -> dict | None:
        at, found, again = [], [], []
        for i, text in enumerate(utf8(batch)):
            seen: set[int] = set()
            for chunk in chunks_of(text, min_words, cut_bits, max_words):
                at.append(i)
                found.append(chunk)
                again.append(chunk[0] in seen)
                seen.add(chunk[0])
        if not found:
            return None
        at = pa.array(at, pa.int32())
        half = (1 << 64) - 1
        return {
            "owner": batch.column(0).take(at),
            "high": pa.array(np.array([c[0] >> 64 for c in found], np.uint64).view(np.int64)),
            "low": pa.array(np.array([c[0] & half for c in found], np.uint64).view(np.int64)),
            "first_word": pa.array([c[1] for c in found], pa.int32()), "words": pa.array([c[2] for c in found], pa.int32()),
            "again": pa.array(again),
        }

    return _keyed(docs).mapInArrow(per_batch(step), CHUNKS)


def duplicates(docs: DataFrame, min_words: int = MIN_WORDS, cut_bits: int = CUT_BITS, max_words: int = MAX_WORDS) -> DataFrame:
    """Chunks that an earlier document, or their own text before, has: owner, first_word, words, first_owner."""
    found = written(chunks(docs, min_words, cut_bits, max_words), "chunks")
    seen = found.filter("not again").groupBy("high", "low").agg(F.min("owner").alias("first_owner"), F.max("owner").alias("last_owner"))
    shared = written(seen.filter("first_owner < last_owner").select("high", "low", "first_owner"), "shared-chunks")
    met = found.join(shared, ["high", "low"], "left").filter("again or first_owner < owner")
    return met.select("owner", "first_word", "words", F.coalesce("first_owner", "owner").alias("first_owner"))


def runs(spans: list[dict], min_run: int) -> list[tuple[int, int, list[int]]]:
    """Runs (first word, end word, first owners) of duplicate chunks of ``min_run`` words or more."""
    out: list[tuple[int, int, list[int]]] = []
    for span in sorted((s["first_word"], s["words"], s["first_owner"]) for s in spans):
        if out and out[-1][1] == span[0]:
            begin, _, owners = out[-1]
            out[-1] = (begin, span[0] + span[1], owners + [span[2]])
        else:
            out.append((span[0], span[0] + span[1], [span[2]]))
    return [r for r in out if r[1] - r[0] >= min_run]


def cut_out(text: bytes, found: list[tuple[int, int, list[int]]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the runs, and their byte spans. A run goes with the white space after it."""
    starts, ends = word_bounds(np.frombuffer(text, np.uint8))
    kept, at, spans = [], 0, []
    for begin, end, _ in found:
        start = int(starts[begin])
        stop = int(starts[end]) if end < len(starts) else len(text)
        kept.append(text[at:start])
        spans.append((start, int(ends[end - 1])))
        at = stop
    return b"".join(kept) + text[at:], spans


def _spans(docs: DataFrame, min_words: int, cut_bits: int, max_words: int) -> DataFrame:
    return duplicates(docs, min_words, cut_bits, max_words).groupBy("owner").agg(
        F.collect_set(F.struct("first_word", "words", "first_owner")).alias("__spans")
    )


RESULT = "doc_id bigint, n_words bigint, n_removed_words bigint, n_runs bigint, removed string, first_doc_ids array<bigint>, text string"


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, cut_bits: int = CUT_BITS, max_words: int = MAX_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """Every row with its text without duplicate runs.

    ``removed`` has the runs as start:end (bytes of the UTF-8 text), comma-joined;
    ``first_doc_ids`` the documents that keep them. A duplicate of a document
    with a null id has that id left out of the list.
    """
    spans = _spans(docs, min_words, cut_bits, max_words)
    rows = _keyed(docs.select("doc_id", "text")).join(spans, "owner", "left").select("owner", "text", "__spans")

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("n_words", "n_removed_words", "n_runs", "removed", "first_doc_ids", "text")}
        for text, spans in zip(utf8(batch), batch.column(2).to_pylist(), strict=True):
            found = runs(spans or [], min_run)
            left, cut = cut_out(text, found) if found else (text, [])
            out["n_words"].append(sum(1 for _ in _WORD.finditer(text)))
            out["n_removed_words"].append(sum(e - b for b, e, _ in found))
            out["n_runs"].append(len(found))
            out["removed"].append(",".join(f"{b}:{e}" for b, e in cut))
            firsts = {int(o) >> _MARK_BITS for _, _, owners in found for o in owners}
            out["first_doc_ids"].append(sorted(firsts - {_LAST}))
            out["text"].append(left.decode())
        numbers = np.array([int(o) >> _MARK_BITS for o in batch.column(0).to_pylist()], dtype=np.int64)
        return {"doc_id": pa.array(numbers, mask=numbers == _LAST)} | {
            k: pa.array(v, pa.list_(pa.int64()) if k == "first_doc_ids" else pa.string() if k in ("removed", "text") else pa.int64()) for k, v in out.items()
        }

    return rows.mapInArrow(per_batch(step), RESULT)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, cut_bits: int = CUT_BITS, max_words: int = MAX_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with duplicate runs cut out of their texts; all rows and other columns stay."""
    spans = _spans(docs, min_words, cut_bits, max_words).withColumnRenamed("owner", "__owner")

    def shorten(text: pa.Array, found: pa.Array) -> pa.Array:
        out = text.to_pylist()
        for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
            own = runs(found[i].as_py(), min_run)
            if own and out[i] is not None:
                out[i] = cut_out(out[i].encode(), own)[0].decode()
        return pa.array(out, pa.string())

    settle(docs.sparkSession)
    joined = docs.join(spans, _owner() == F.col("__owner"), "left")
    return joined.withColumn("text", F.arrow_udf(shorten, "string")(F.col("text"), F.col("__spans"))).drop("__owner", "__spans")
