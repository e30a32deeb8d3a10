"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; a bit is set if more than half of the text's word
shingles (repeats included) have it set in their XXH64 hash. Fingerprints that
differ in few bits are linked:

* the fingerprint is cut into segments, and each segment's value is a key of a
  table of all distinct fingerprints;
* by the pigeonhole principle two fingerprints within d bits agree in one of m
  segments up to d // m bits (up to one less from the segment on that follows
  the first d % m + 1), so every fingerprint asks for the small Hamming ball
  around its own value of each segment;
* what it meets there is verified on all 64 bits.

A table entry may hold any share of the fingerprints (copies edited in places
that move few bits). Entries above ``bucket_limit`` are left to an exact second
way, which makes no pairs: two fingerprints are within d bits (d even) exactly
if their balls of radius d / 2 meet. Each fingerprint that asks for such an
entry lists its ball, and all that list one value are linked to the smallest of
them: as many rows as listings, however many fingerprints are close together.

Texts without a word (null, empty, blank) have fingerprint zero and are linked
like any other. Repeated rows and ties share a fingerprint. Null ids count as
no id: they never name a component unless it has no other id. An empty table
gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import per_batch, texts, utf8
from lakestate.llm.components import roots
from lakestate.session import pinned, written

SEED = 42
BITS = 64
BUCKET_LIMIT = 64
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, size: int = BLOCK):
    """The text's words, block by block, without cutting a word."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def shingle_blocks(text: bytes, words: int):
    """Hashes of the text's word shingles, block by block; a shorter text is one shingle, a blank one has none."""
    carried, found = [], False
    for block in word_blocks(text.lower()):  # of bytes, so A-Z only
        carried = carried + block
        if len(carried) >= words:
            yield _hashed(list(map(b" ".join, zip(*[carried[i:] for i in range(words)], strict=False))))
            found = True
            carried = carried[len(carried) - words + 1 :]
    if carried and not found:
        yield _hashed([b" ".join(carried)])


def _hashed(shingles: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), dtype="<u8", count=len(shingles))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of one text, as an unsigned number."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_blocks(text, words):
        ones += _bit_counts(hashes)
        total += len(hashes)
    if not total:
        return 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and the signed 64-bit ``fp`` of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(text, words) for text in utf8(batch)], dtype=np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))}

    return texts(docs).mapInArrow(per_batch(step), "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _ball(bits: range, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the given bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in itertools.combinations(bits, r)]


def _segments(distance: int, count: int) -> list[tuple[int, range, int]]:
    """Number, bits and radius of each segment that has to be asked."""
    edges = [BITS * i // count for i in range(count + 1)]
    radius, rest = divmod(distance, count)
    planned = [(i, range(edges[i], edges[i + 1]), radius if i <= rest else radius - 1) for i in range(count)]
    return [p for p in planned if p[2] >= 0]


def _keys(fps: DataFrame, segments: list[tuple[int, range, int]], ball: bool) -> DataFrame:
    """``segment``, ``value``, ``fp``: the table's entries, or what each fingerprint asks for.

    A pair is found from both sides; of a ball only the values not below one's
    own are asked, so that one of the two sides remains.
    """
    asked = [_asked(fps, number, bits, radius if ball else 0) for number, bits, radius in segments]
    return functools.reduce(DataFrame.unionByName, asked)


def _asked(fps: DataFrame, number: int, bits: range, radius: int) -> DataFrame:
    """One segment's values within ``radius`` bits, none below one's own."""
    own = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))), bits.start)
    flips = F.array(*[F.lit(m >> bits.start).cast("bigint") for m in _ball(bits, radius)])
    # The lambdas take one argument: a second one would be the position.
    values = F.filter(F.transform(flips, lambda m: own.bitwiseXOR(m)), lambda v: v >= own)
    return fps.select(F.lit(number).alias("segment"), F.explode(values).alias("value"), "fp")


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(fps: DataFrame, distance: int = 2, segments: int = 2, bucket_limit: int = BUCKET_LIMIT, dense: bool = True) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp``: each is within ``distance``,
    and whatever is within ``distance`` is connected through links.

    ``dense`` takes entries above ``bucket_limit`` by ball meetings (distance
    0, 2 or 4); without it every entry is paired.
    """
    if distance % 2 or (dense and distance > 4):
        raise ValueError("the distance has to be even, and at most 4 for dense entries")
    plan = _segments(distance, segments)
    table, probes = _keys(fps, plan, False), _keys(fps, plan, True)
    found = None
    if dense:
        counts = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
        large = written(counts.filter(F.col("n") > bucket_limit).select("segment", "value"), "large-entries")
        if not large.isEmpty():
            table = table.join(large, ["segment", "value"], "left_anti")
            asking = probes.join(large, ["segment", "value"], "left_semi").select("fp").distinct()
            found = _ball_links(pinned(asking), distance)
    asks = probes.select("segment", "value", F.col("fp").alias("u"))
    entries = table.select("segment", "value", F.col("fp").alias("v"))
    # Equal values of a segment are met from both sides; the smaller number asks then.
    own = [F.when(F.col("segment") == n, F.col("u").bitwiseXOR(F.col("v")).bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))) == 0) for n, bits, _ in plan]
    level = F.coalesce(*own)
    pairs = asks.join(entries, ["segment", "value"]).filter(_near("u", "v", distance) & (F.col("u") != F.col("v")) & (~level | (F.col("u") < F.col("v"))))
    pairs = pairs.select("u", "v")
    return pairs.unionByName(found) if found is not None else pairs


def _ball_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints to the smallest that shares a value of their balls of half the distance."""
    masks = F.array(*[F.lit(_signed(m)) for m in _ball(range(BITS), distance // 2)])
    listed = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    hubs = listed.groupBy("value").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).filter("hub < top")
    met = listed.join(pinned(hubs.select("value", "hub")), "value")
    return met.filter((F.col("fp") != F.col("hub")) & _near("fp", "hub", distance)).select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, segments: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row.

    The component is named by the smallest document id reachable over links.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    fps = pinned(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = pinned(roots(links(fps.select("fp"), distance, segments)))
    firsts = fps.join(rooted, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(firsts, "root").select(F.col("node").alias("fp"), "least")
    whole = written(fps.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")
    return marked.join(whole, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    blocks = list(shingle_blocks(text, words))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, dtype="<u8")
