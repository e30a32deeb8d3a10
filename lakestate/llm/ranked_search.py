"""Ranked lexical search: the best documents of every item, by dual-tree search.

Items and documents are sparse vectors over the items' terms. An item's
coordinate is a term's count times its weight, a document's the term's
importance, and the score is their product, all in whole numbers:

* N documents have a term, L is the number of all their terms, n that of one;
* a term in df documents has the weight floor(1000 ln((2N + 2) / (2df + 1)));
* tf occurrences have the importance (10^9 tf) div (1000 tf + 8 m), with
  m = 100 - 75 + ((75 n N) div L).

Each task takes its documents batch by batch and builds a hierarchy over them,
as there is one over the items: neighbours in the order of their heaviest terms
make leaves, leaves make nodes, and every node holds the largest value of each
coordinate below it. The product of two nodes' maxima bounds every score of an
item below one and a document below the other. Walking down both hierarchies
at once, a pair of nodes is dropped when its bound is below the weakest kth score
that the items below it have so far; of the leaves that remain, those with the
largest bounds are scored first, so that the kth scores rise early. Bounds and
kth scores are exact, so nothing is lost. Sums are exact in doubles up to 2^53
and taken in 64-bit integers beyond.

A task hands on at most ``k`` rows per item, which are ranked per item with
partial ranks before the shuffle. Items are taken in blocks of bounded size
(``ITEMS``, ``CELLS``), whatever their number: each block is one pass over all
documents, and only a block is at the driver or broadcast at once.

Null and blank texts have no terms: as a document they count nowhere, as an item
they have no rows. Repeated items have rows each; a document that is there twice
takes two ranks. Equal scores are in ascending doc_id, null last. Empty tables
give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestate.functions.ordering import with_sequence
from lakestate.llm.common import per_batch, settle, texts, utf8
from lakestate.session import written

#: Items of a block, and items times distinct terms of a block (one item may have more).
ITEMS, CELLS = 256, 1 << 22
#: Children of a node; items and documents of a leaf.
FANOUT, ITEM_LEAF, DOC_LEAF = 8, 8, 32
SCALE, IMPORTANCE = 1000, 1_000_000_000
K1_TERM, BASE, SLOPE = 8, 100, 75
_EXACT = 1 << 53

# What is no term character is a blank; of letters only A to Z are lowered.
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_PLAIN).split()


class Items:
    """A block of items over its own vocabulary: term numbers and counts of each item."""

    def __init__(self, keys: list[int], texts_: list[bytes]):
        counted = [Counter(terms(t)) for t in texts_]
        self.keys = keys
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        self.counts = [{self.vocabulary[t]: n for t, n in c.items()} for c in counted]


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """All items (seq from 0, text) in blocks of at most ITEMS items and CELLS cells, a larger item alone."""
    total, start = items.count(), 0
    while start < total:
        rows = items.filter((F.col("seq") >= start) & (F.col("seq") < start + ITEMS)).orderBy("seq").select("seq", "text").toLocalIterator()
        keys, held, words = [], [], set()
        for row in rows:
            more = set(terms((row["text"] or "").encode()))
            if keys and (len(keys) + 1) * len(words | more) > CELLS:
                break
            keys.append(row["seq"])
            held.append((row["text"] or "").encode())
            words |= more
        yield Items(keys, held)
        start += len(keys)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (all terms of the row), ``term`` and ``tf`` (arrays, ascending terms of the vocabulary) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def step(batch: pa.RecordBatch) -> dict:
        known = shared.value
        sizes, numbers, counts = [], [], []
        for text in utf8(batch):
            words = terms(text)
            found = Counter(filter(None.__ne__, map(known.get, words)))
            order = sorted(found)
            sizes.append(len(words))
            numbers.append(order)
            counts.append([found[t] for t in order])
        return {
            "doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()),
            "term": pa.array(numbers, pa.list_(pa.int32())), "tf": pa.array(counts, pa.list_(pa.int64())),
        }

    return texts(docs).mapInArrow(per_batch(step), "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


def weights(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The weight of each of ``size`` terms, N and L."""
    totals = rows.filter("n > 0").agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    held = rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = np.zeros(size, dtype=np.int64)
    for row in held:
        df[row["term"]] = row["df"]
    n = totals["N"] or 0
    weight = [math.floor(SCALE * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
    return np.array(weight, dtype=np.int64), n, totals["L"] or 0


def importance(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Importances of terms with ``tf`` occurrences in documents of ``n`` terms, in whole numbers."""
    m = (BASE - SLOPE) + np.array([SLOPE * x * documents // length for x in n.tolist()], dtype=np.int64)
    return (IMPORTANCE * tf) // (SCALE * tf + K1_TERM * m)


def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
    """The largest value of each coordinate of every ``size`` rows."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


class Search:
    """The items' hierarchy and the best documents found so far."""

    def __init__(self, items: Items, weight: np.ndarray, documents: int, length: int, k: int):
        self.k, self.documents, self.length = k, documents, length
        self.size = len(weight)
        table = np.zeros((len(items.keys), self.size), dtype=np.int64)
        for i, counts in enumerate(items.counts):
            for term, count in counts.items():
                table[i, term] = count * weight[term]
        # The largest importance is below IMPORTANCE / SCALE.
        largest = int(table.sum(axis=1, dtype=np.float64).max(initial=0)) * (IMPORTANCE // SCALE)
        self.kind = np.float64 if 2 * largest < _EXACT else np.int64
        # Neighbours share their heaviest terms.
        order = np.lexsort((table.argmax(axis=1), -table.max(axis=1, initial=0)))
        self.keys = np.array(items.keys, dtype=np.int64)[order]
        self.levels = [table[order].astype(self.kind)]
        for size in (ITEM_LEAF, *[FANOUT] * 32):
            if len(self.levels[-1]) == 1 and len(self.levels) > 1:
                break
            self.levels.append(_maxima(self.levels[-1], size))
        self.best: list[list[tuple[int, float, int | None]]] = [[] for _ in self.keys]
        self.kth = np.zeros(len(self.keys), dtype=self.kind)  # a score has to be above 0

    def add(self, ids: list, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Search one batch of documents; their terms and counts lie in a row, up to ``ends``."""
        counts = np.diff(np.concatenate([[0], ends]))
        some = np.flatnonzero(counts)
        if not len(some) or not len(self.keys):
            return
        owner = np.repeat(np.arange(len(counts)), counts)
        value = importance(tf, n[owner], self.documents, self.length)
        columns, local = np.unique(term, return_inverse=True)
        # Documents are neighbours if their heaviest coordinate is the same.
        heavy = value * self.levels[1][:, columns].max(axis=0).astype(np.int64)[local]
        starts = (ends - counts)[some]
        top = np.maximum.reduceat(heavy, starts)
        first = np.full(len(counts), len(columns), dtype=np.int64)
        np.minimum.at(first, owner, np.where(heavy == np.repeat(top, counts[some]), local, len(columns)))
        order = some[np.lexsort((-top, first[some]))]
        rank = np.full(len(counts), -1, dtype=np.int64)
        rank[order] = np.arange(len(order))
        at = rank[owner]
        leaves = -(-len(order) // DOC_LEAF)
        maxima = np.zeros((leaves, len(columns)), dtype=np.int64)
        np.maximum.at(maxima, (at // DOC_LEAF, local), value)
        hierarchy = [maxima.astype(self.kind)]
        while len(hierarchy[-1]) > 1:
            hierarchy.append(_maxima(hierarchy[-1], FANOUT))
        by_leaf = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[by_leaf] // DOC_LEAF, np.arange(leaves + 1))
        item_levels = [level[:, columns] for level in self.levels]
        pairs, bounds = self._near(item_levels, hierarchy)
        for (node, leaf), bound in sorted(zip(pairs, bounds, strict=True), key=lambda p: -p[1]):
            items = slice(node * ITEM_LEAF, (node + 1) * ITEM_LEAF)
            if bound < self.kth[items].min():
                continue
            entries = by_leaf[edges[leaf] : edges[leaf + 1]]
            used, place = np.unique(local[entries], return_inverse=True)
            dense = np.zeros((DOC_LEAF, len(used)), dtype=self.kind)
            dense[at[entries] % DOC_LEAF, place] = value[entries]
            scores = item_levels[0][items][:, used] @ dense.T
            self._offer(items.start, scores, order[leaf * DOC_LEAF : (leaf + 1) * DOC_LEAF], ids)

    def _near(self, items: list[np.ndarray], docs: list[np.ndarray]) -> tuple[list, list]:
        """Pairs of item leaf and document leaf that can change a result, and their bounds."""
        i, d = len(items) - 1, len(docs) - 1
        kth = [self.kth]
        for size in (ITEM_LEAF, *[FANOUT] * (i - 1)):
            kth.append(np.minimum.reduceat(kth[-1], np.arange(0, len(kth[-1]), size)))
        alive = np.ones((len(items[i]), len(docs[d])), dtype=bool)
        while True:
            nodes, groups = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            bound = np.full(alive.shape, -1, dtype=self.kind)
            bound[np.ix_(nodes, groups)] = items[i][nodes] @ docs[d][groups].T
            alive &= (bound >= kth[i][:, None]) & (bound > 0)
            if i == 1 and d == 0:
                return list(zip(*map(np.ndarray.tolist, np.nonzero(alive)), strict=True)), bound[alive].tolist()
            if i > 1:
                i -= 1
                alive = np.repeat(alive, FANOUT, axis=0)[: len(items[i])]
            if d > 0:
                d -= 1
                alive = np.repeat(alive, FANOUT, axis=1)[:, : len(docs[d])]

    def _offer(self, start: int, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        scores = scores[:, : len(rows)]
        for i in np.flatnonzero((scores >= self.kth[start : start + len(scores), None]).any(axis=1) & (scores > 0).any(axis=1)).tolist():
            item, own = start + i, scores[i]
            chosen = np.flatnonzero((own >= self.kth[item]) & (own > 0))
            held = self.best[item] + [(int(own[c]), ids[rows[c]]) for c in chosen.tolist()]
            held.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
            self.best[item] = held[: self.k]
            if len(held) >= self.k:
                self.kth[item] = self.best[item][-1][0]

    def found(self) -> pa.RecordBatch:
        rows = [(key, doc, score) for key, held in zip(self.keys.tolist(), self.best, strict=True) for score, doc in held]
        seq, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_pydict({"seq": pa.array(seq, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})


def _searched(rows: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, documents, length, k)
        for batch in batches:
            if batch.num_rows:
                term, tf = batch.column(2), batch.column(3)
                ends = np.cumsum([len(x) for x in term])
                search.add(
                    batch.column(0).to_pylist(), batch.column(1).to_numpy(), ends,
                    term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64),
                )
        yield search.found()

    return rows.select("doc_id", "n", "term", "tf").mapInArrow(run, "seq bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item (item_id, text)."""
    settle(docs.sparkSession)
    plain = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = written(with_sequence(plain, ["item_id", "text"], start=-1), "items")
    found = None
    for block in item_blocks(numbered):
        rows = written(vectors(docs, block.vocabulary), "vectors")
        weight, documents, length = weights(rows, len(block.vocabulary))
        some = written(_searched(rows, block, weight, documents, length, k), "candidates")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "seq bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("seq").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("seq", "item_id"), "seq").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same ranking, term by term.
SQL = r"""
WITH words AS (
  SELECT ROW_NUMBER() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT COUNT(*) AS nn, CAST(SUM(n) AS BIGINT) AS ll FROM docs),
posts AS (SELECT row_id, doc_id, n, term, COUNT(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
items AS (
  SELECT ROW_NUMBER() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT item, item_id, term, COUNT(*) AS c FROM items GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, COUNT(*) AS df FROM posts GROUP BY term), totals),
scored AS (
  SELECT item, item_id, row_id, doc_id,
    CAST(SUM(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN posts USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT item_id, ROW_NUMBER() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
