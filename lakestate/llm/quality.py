"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are. The trees are fitted on a bounded
sample of labelled rows (``SAMPLE_ROWS``; numbers only), in histograms of 64 bins
per statistic, and flattened into arrays: one row per node with its statistic,
threshold, children and value. Scoring goes down all trees level by level with
numpy, a batch of texts at a time; the arrays have a fixed bound (trees times
nodes) and travel with the function.

Null and empty texts have all statistics zero and get a score like any other.
Repeated rows get equal scores; an empty table gives no rows. Without labelled
rows the score is one half everywhere; with labels of one kind it is the
smoothed share of that kind.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import per_batch, settle, texts, utf8

#: Labelled rows that the trees are fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, L2 = 60, 4, 0.15, 64, 10, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

STATISTICS = (
    "log_words", "log_chars", "word_length", "symbols", "digits", "upper", "letters", "marks", "pipes", "newlines", "wide",
    "distinct_words", "top_word", "adjacent_equal", "dup_lines", "words_per_line", "short_words", "long_words", "marked_words", "repeated_triples", "stops",
)
_MARKS = np.frombuffer(b"!?.,;:'\"()-", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~_=+{}[]\\/", np.uint8)


def _classes() -> np.ndarray:
    """A class for each byte, so that one count gives all shares."""
    out = np.zeros(256, dtype=np.int64)
    out[48:58], out[65:91], out[97:123], out[128:] = 1, 2, 3, 8
    out[_MARKS], out[_SYMBOLS], out[ord("|")], out[10] = 4, 5, 6, 7
    return out


_CLASS = _classes()


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9) / size
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, n)
    last = Counter(w[-1] for w in words)
    marked = sum(last.get(c, 0) for c in b"!#$%&*|")
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), shares[5], shares[1], shares[2], shares[3], shares[4], shares[6], shares[7], shares[8],
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), marked / n, 1 - len(set(triples)) / len(triples) if triples else 0.0,
        sum(last.get(c, 0) for c in b".!?") / n,
    ]


def matrix(batch: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in batch], dtype=np.float64).reshape(-1, len(STATISTICS))


class Trees:
    """Flattened trees: ``feature`` -1 marks a leaf; a row goes left if its value is at most the threshold."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots):
        self.base = base
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = map(np.asarray, (feature, threshold, left, right, value, roots))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves' values, all trees level by level."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        while (self.feature[node] >= 0).any():
            feature = self.feature[node]
            below = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(feature < 0, node, np.where(below, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf_rows: int = LEAF_ROWS) -> Trees:
    """Boosted trees for labels 0 and 1 under logistic loss."""
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        offsets = np.arange(x.shape[1]) * bins
        current = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-current))
            gradient, hessian = y - p, p * (1 - p)
            roots.append(node())
            waiting = [(roots[-1], np.arange(len(y)), 0)]
            while waiting:
                at, rows, level = waiting.pop()
                g, h = gradient[rows].sum(), hessian[rows].sum()
                best = None
                if level < depth and len(rows) >= 2 * leaf_rows:
                    flat = (binned[rows] + offsets).ravel()
                    size = bins * x.shape[1]
                    each = x.shape[1]
                    hg = np.bincount(flat, np.repeat(gradient[rows], each), size).reshape(each, bins).cumsum(axis=1)
                    hh = np.bincount(flat, np.repeat(hessian[rows], each), size).reshape(each, bins).cumsum(axis=1)
                    hn = np.bincount(flat, minlength=size).reshape(each, bins).cumsum(axis=1)
                    gain = hg**2 / (hh + L2) + (g - hg) ** 2 / (h - hh + L2) - g**2 / (h + L2)
                    gain[(hn < leaf_rows) | (len(rows) - hn < leaf_rows)] = -1
                    f, b = divmod(int(gain.argmax()), bins)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = (f, b)
                if best is None:
                    value[at] = rate * float(g / (h + L2))
                    current[rows] += value[at]
                    continue
                f, b = best
                feature[at], threshold[at], left[at], right[at] = f, float(edges[f][b]), node(), node()
                below = binned[rows, f] <= b
                waiting += [(left[at], rows[below], level + 1), (right[at], rows[~below], level + 1)]
    if not roots:
        roots.append(node())
    return Trees(base, feature, threshold, left, right, value, roots)


def fold(folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from a bounded sample of the labelled rows outside the held-out fold."""
    settle(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter((fold(FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1)).dropDuplicates(["doc_id"])
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows).drop("h")
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def step(batch: pa.RecordBatch) -> dict:
        x = matrix(utf8(batch))
        return {"quality": batch.column(0), "x": pa.array(list(x), pa.list_(pa.float64()))}

    # A repeated id could bring more rows than the sample has, hence the second limit.
    found = rows.mapInArrow(per_batch(step), "quality int, x array<double>").limit(2 * sample_rows).toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    y = found["quality"].to_numpy(dtype=np.float64)
    order = np.lexsort((y, *x.T)) if len(y) else np.arange(0)  # rows come in any order; equal fits need one order
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": pa.array(trees.score(matrix(utf8(batch))))}

    scored = texts(docs).mapInArrow(per_batch(step), "doc_id bigint, score double")
    held = F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, with all their columns."""

    def marks(text: pa.Array) -> pa.Array:
        return pa.array(trees.score(matrix([t or b"" for t in text.cast(pa.binary()).to_pylist()])))

    settle(docs.sparkSession)
    return docs.filter(F.arrow_udf(marks, "double")(F.col("text").cast("string")) >= threshold)
