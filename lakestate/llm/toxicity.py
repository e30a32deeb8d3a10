"""Toxicity by class-conditional Kneser-Ney models.

Texts are lower-cased; letters and digits make words. Each class, toxic and
ordinary, has two models with its own discounted counts: one of words, and one
of characters of order ``ORDER`` that reads each word from a blank context to the
blank after it. What the discounts leave goes to backoffs that the classes share:
the joint vocabulary for words, and for characters the lower orders' continuation
probabilities, counted over both classes. So an expression that is rare, or
unseen in one class, is smoothed with what both know of it, and where neither
class has seen one the shared factor cancels: only the backoff weights are
compared.

A word's evidence is the sum of both models' log-likelihood differences, within
``LIMIT`` either way. A text's is the log of the mean likelihood ratio of its
words: normalised by length, and, unlike the mean of the logs, not drowned where
a few toxic words stand among many ordinary ones. A logistic function, fitted on
a bounded sample of training texts that the counts leave out, makes it a score.

Counts cover all other labelled training texts and are Spark tables of words and
n-grams, as large as the texts make them. A word's evidence depends on the word
alone, so it is computed once for each distinct word of the texts to be scored,
from the whole tables. The ``CACHED`` most frequent n-grams, contexts and words are
broadcast; words are joined with the tables for their other n-grams, and texts
for their other words only. So the cache decides what is fast, never what is known. Words are told apart by 64-bit
hashes where they are joined.

Where the counts would lack a kind of label without the sample, nothing is left out; where the sample
lacks one, or so few rows turn the logistic function around, the difference is added to the
log-odds of the labels as it is: it is a log-likelihood ratio. So few labels still rank.

Null and empty texts have no words and a difference of zero. Repeated rows get
equal scores; an empty table gives no rows. Without labelled rows of both kinds
the score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import settle, texts
from lakestate.session import pinned, written

ORDER = 5
DISCOUNT = 0.75
#: Grams, contexts and words that are broadcast (words of at most CACHED_LENGTH characters).
CACHED, CACHED_LENGTH = 1 << 18, 64
#: Largest evidence of a word, in nats.
LIMIT = 8.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: The calibration's sample: at most SAMPLE_ROWS of every CALIBRATION-th training row. All others are counted.
CALIBRATION, SAMPLE_ROWS = 5, 20_000
#: Distinct words a task holds before it hands them on, and n-grams of a batch.
HELD_WORDS, HELD_GRAMS = 500_000, 100_000
_OTHER = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    """The text's words in lower case."""
    return _OTHER.sub(" ", text.lower()).split()


def word_counts(rows: DataFrame) -> DataFrame:
    """``word``, ``toxic``, ``ordinary``: occurrences in all rows (toxic 0/1, text). Each task adds up its own first."""

    def counted(words: list[Counter]) -> pa.RecordBatch:
        names = list(words[0] | words[1])
        return pa.RecordBatch.from_pydict({
            "word": pa.array(names, pa.string()), "toxic": pa.array([words[1][w] for w in names], pa.int64()),
            "ordinary": pa.array([words[0][w] for w in names], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Counter(), Counter()]
        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[kind].update(words_of(text))
            if len(words[0]) + len(words[1]) > HELD_WORDS:
                yield counted(words)
                words = [Counter(), Counter()]
        if words[0] or words[1]:
            yield counted(words)

    found = rows.select("toxic", "text").mapInArrow(run, "word string, toxic bigint, ordinary bigint")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def spelled(words: DataFrame) -> DataFrame:
    """``id`` and ``gram``, with the other columns, for every n-gram of words (id, word, ...).

    A word is read behind ORDER - 1 blanks, and up to the blank after it.
    """
    rest = [f for f in words.schema.fields if f.name not in ("id", "word")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            grams: list[str] = []

            def flush(batch=batch) -> pa.RecordBatch:
                at = pa.array(owners, pa.int32())
                columns = {"id": batch.column(0).take(at), "gram": pa.array(grams, pa.string())}
                return pa.RecordBatch.from_pydict(columns | {f.name: batch.column(2 + i).take(at) for i, f in enumerate(rest)})

            for i, word in enumerate(batch.column(1).to_pylist()):
                whole = " " * (ORDER - 1) + word + " "
                for start in range(0, len(word) + 1, HELD_GRAMS):
                    some = [whole[j : j + ORDER] for j in range(start, min(len(word) + 1, start + HELD_GRAMS))]
                    grams += some
                    owners += [i] * len(some)
                    if len(grams) >= HELD_GRAMS:
                        yield flush()
                        owners, grams = [], []
            if grams:
                yield flush()

    schema = ", ".join(["id bigint", "gram string", *[f"{f.name} {f.dataType.simpleString()}" for f in rest]])
    return words.select("id", "word", *[f.name for f in rest]).mapInArrow(run, schema)


def counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words, and n-grams (``gram``), with their toxic and ordinary occurrences in all rows (toxic 0/1, text)."""
    words = written(word_counts(rows), "word-counts")
    grams = spelled(words.select(F.xxhash64("word").alias("id"), "word", "toxic", "ordinary"))
    summed = grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return words, written(summed, "gram-counts")


def _continued(grams: DataFrame) -> DataFrame:
    """``gram`` and ``p``: shared continuation probabilities of the grams one character shorter than ``grams``'.

    ``grams`` has distinct grams; a shorter one counts once for each character found before it.
    """
    size = ORDER - 1
    levels = []
    current = grams.select("gram")
    for length in range(size, 0, -1):
        current = pinned(current.groupBy(F.substring("gram", 2, length).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        levels.append(current)
    total = levels[-1].agg(F.sum("n").alias("total"))
    shared = levels[-1].crossJoin(F.broadcast(total)).select("gram", (F.col("n") / F.col("total")).alias("p"))
    for length, level in zip(range(2, size + 1), levels[-2::-1], strict=True):
        context = F.substring("gram", 1, length - 1)
        sums = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        lower = shared.select(F.col("gram").alias("lower"), F.col("p").alias("p_lower"))
        shared = (
            level.withColumn("context", context).join(sums, "context").withColumn("lower", F.substring("gram", 2, length - 1)).join(lower, "lower")
            .select("gram", ((F.col("n") - DISCOUNT) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("p_lower")).alias("p"))
        )
    return shared


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-ratios of toxic to ordinary probability: of grams seen (``gram``, ``weight``, ``ratio``), and of
    contexts for anything unseen after them (``gram`` is the context)."""
    context = F.substring("gram", 1, ORDER - 1)
    has = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    sums = pinned(grams.groupBy(context.alias("context")).agg(
        F.sum("toxic").alias("t_toxic"), F.sum("ordinary").alias("t_ordinary"), has("toxic").alias("k_toxic"), has("ordinary").alias("k_ordinary")
    ))
    backoff = lambda c: F.when(F.col(f"t_{c}") > 0, DISCOUNT * F.col(f"k_{c}") / F.col(f"t_{c}")).otherwise(1.0)
    shared = pinned(_continued(grams)).select(F.col("gram").alias("lower"), "p")

    def probability(c: str):
        own = F.when(F.col(f"t_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"t_{c}")).otherwise(0.0)
        return own + backoff(c) * F.col("p")

    seen = (
        grams.withColumn("context", context).join(sums, "context").withColumn("lower", F.substring("gram", 2, ORDER - 1)).join(shared, "lower")
        .select("gram", (F.col("toxic") + F.col("ordinary")).alias("weight"), (F.log(probability("toxic")) - F.log(probability("ordinary"))).alias("ratio"))
    )
    unseen = sums.select(
        F.col("context").alias("gram"), (F.col("t_toxic") + F.col("t_ordinary")).alias("weight"), (F.log(backoff("toxic")) - F.log(backoff("ordinary"))).alias("ratio")
    )
    return seen, unseen


def word_ratios(words: DataFrame) -> tuple[DataFrame, float]:
    """Log-ratios of words (``word``, ``ratio``), and that of any unseen word."""
    has = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    sums = words.agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), has("toxic").alias("k_toxic"), has("ordinary").alias("k_ordinary"), F.count(F.lit(1)).alias("all")
    ).first()
    if not sums["toxic"] or not sums["ordinary"]:
        return words.select("word", F.lit(0.0).alias("ratio")), 0.0
    left = {c: DISCOUNT * sums[f"k_{c}"] / sums[c] for c in ("toxic", "ordinary")}

    def probability(c: str):
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / float(sums[c]) + left[c] / float(sums["all"])

    ratio = F.log(probability("toxic")) - F.log(probability("ordinary"))
    return words.select("word", ratio.alias("ratio")), float(np.log(left["toxic"] / left["ordinary"]))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (constant first) of a logistic regression, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1])
    w[0] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * np.r_[0, w[1:]]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag(np.r_[1e-6, np.ones(len(w) - 1)])
        change = np.linalg.solve(hessian, gradient)
        w = w + np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-8:
            break
    return w


def calibrated(x: np.ndarray, y: np.ndarray, toxic: int, ordinary: int) -> np.ndarray:
    """Constant and slope from a sample (x, y) out of so many labelled rows of either kind."""
    if not toxic or not ordinary:
        return np.array([np.log((toxic + 1) / (ordinary + 1)), 0.0])
    w = logistic(x[:, None], y)
    return w if w[1] > 0 else np.array([np.log((toxic + 1) / (ordinary + 1)), 1.0])


def fold():
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


class Model:
    """The whole tables of ratios (grams seen, contexts, words), the ratio of an unseen word, and the calibration."""

    def __init__(self, tables: tuple[DataFrame, DataFrame, DataFrame], unseen_word: float):
        self.tables, self.unseen_word = tables, unseen_word
        self.weights = np.zeros(2)


def _frequent(table: DataFrame) -> tuple[dict[str, float], bool]:
    """The ratios of the CACHED most frequent grams of a table, and whether these are all."""
    rows = table.orderBy(F.desc("weight"), "gram").limit(CACHED + 1).select("gram", "ratio").toArrow()
    grams, ratios_ = (rows.column(c).to_pylist()[:CACHED] for c in ("gram", "ratio"))
    return dict(zip(grams, ratios_, strict=True)), rows.num_rows <= CACHED


def _summed(words: DataFrame, model: Model) -> DataFrame:
    """``id``, ``word``, ``n``, ``known``, ``others`` of words (id, word, n): the sum of the ratios that the cache
    tells, and the grams that only the whole tables can. A long word has further rows without word and n."""
    shared = words.sparkSession.sparkContext.broadcast((*_frequent(model.tables[0]), *_frequent(model.tables[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, all_seen, unseen, all_unseen = shared.value
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for ident, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                whole = " " * (ORDER - 1) + word + " "
                for start in range(0, len(word) + 1, HELD_GRAMS):
                    known, others = 0.0, []
                    for j in range(start, min(len(word) + 1, start + HELD_GRAMS)):
                        gram = whole[j : j + ORDER]
                        ratio = seen.get(gram)
                        if ratio is None and all_seen:
                            ratio = unseen.get(gram[:-1], 0.0 if all_unseen else None)
                        if ratio is None:
                            others.append(gram)
                        else:
                            known += ratio
                    rows.append({"id": ident, "word": None if start else word, "n": None if start else n, "known": known, "others": others})
                    held += len(others)
                    if held >= HELD_GRAMS:
                        yield pa.RecordBatch.from_pylist(rows, _SUMMED)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SUMMED)

    return words.select("id", "word", "n").mapInArrow(run, "id bigint, word string, n bigint, known double, others array<string>")


_SUMMED = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("known", pa.float64()), ("others", pa.list_(pa.string()))])


def evidence(words: DataFrame, model: Model) -> DataFrame:
    """``id``, ``word``, ``n`` and ``evidence`` of distinct words (word, n), from the whole tables."""
    seen, unseen, by_word = model.tables
    rows = written(_summed(words.select(F.xxhash64("word").alias("id"), "word", "n"), model), "spelled")
    grams = rows.select("id", F.explode("others").alias("gram"))
    own = grams.join(seen.select("gram", F.col("ratio").alias("own")), "gram", "left").withColumn("context", F.substring("gram", 1, ORDER - 1))
    both = own.join(unseen.select(F.col("gram").alias("context"), F.col("ratio").alias("other")), "context", "left")
    asked = both.select("id", F.coalesce("own", "other", F.lit(0.0)).alias("ratio"))
    further = rows.filter("word IS NULL").select("id", F.col("known").alias("ratio"))
    more = asked.unionByName(further).groupBy("id").agg(F.sum("ratio").alias("more"))
    found = rows.filter("word IS NOT NULL").join(more, "id", "left").join(by_word.select("word", F.col("ratio").alias("whole")), "word", "left")
    whole = F.col("known") + F.coalesce("more", F.lit(0.0)) + F.coalesce("whole", F.lit(model.unseen_word))
    return found.select("id", "word", "n", whole.alias("evidence"))


def differences(rows: DataFrame, model: Model) -> DataFrame:
    """``id`` and ``x`` of every row (id, text): the log of the mean likelihood ratio of its words; 0 without words."""
    vocabulary = word_counts(rows.select(F.lit(0).alias("toxic"), "text")).select("word", F.col("ordinary").alias("n"))
    bounded = F.exp(F.greatest(F.least("evidence", F.lit(LIMIT)), F.lit(-LIMIT)))
    known = written(evidence(written(vocabulary, "vocabulary"), model).withColumn("ratio", bounded), "evidence")
    frequent = known.filter(F.char_length("word") <= CACHED_LENGTH).orderBy(F.desc("n"), "word").limit(CACHED).select("word", "ratio").toArrow()
    words, ratios_ = (frequent.column(c).to_pylist() for c in ("word", "ratio"))
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(words, ratios_, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, cache = TaskContext.get().partitionId(), 0, shared.value
        for batch in batches:
            totals, sizes, others = [], [], []
            for text in batch.column(1).to_pylist():
                counted = Counter(words_of(text))
                total, units = 0.0, []
                for word, n in counted.items():
                    ratio = cache.get(word)
                    if ratio is None:
                        units.append({"unit": int(np.uint64(xxhash.xxh64_intdigest(word.encode(), 42)).view(np.int64)), "n": n})
                    else:
                        total += ratio * n
                totals.append(total)
                sizes.append(counted.total())
                others.append(units)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array((task << 40) + number + np.arange(batch.num_rows)), "id": batch.column(0), "total": pa.array(totals, pa.float64()),
                "words": pa.array(sizes, pa.int64()), "units": pa.array(others, pa.list_(pa.struct([("unit", pa.int64()), ("n", pa.int64())]))),
            })
            number += batch.num_rows

    schema = f"row bigint, id {rows.schema['id'].dataType.simpleString()}, total double, words bigint, units array<struct<unit:bigint,n:bigint>>"
    summed = written(rows.select("id", "text").mapInArrow(run, schema), "sums")
    asked = summed.select("row", F.explode("units").alias("u")).select("row", "u.unit", "u.n")
    found = asked.join(known.select(F.col("id").alias("unit"), "ratio"), "unit")
    more = found.groupBy("row").agg(F.sum(F.col("ratio") * F.col("n")).alias("more"))
    whole = F.col("total") + F.coalesce("more", F.lit(0.0))
    x = F.when(F.col("words") > 0, F.log(whole / F.col("words"))).otherwise(0.0)
    return summed.drop("units").join(more, "row", "left").select("id", x.alias("x"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Counts over all labelled training rows but the calibration's sample, then the calibration."""
    settle(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter((fold() != HELD_OUT) & F.col("toxic").isin(0, 1)).dropDuplicates(["doc_id"])
    known = written(known.join(texts(docs).select("doc_id"), "doc_id", "left_semi"), "labelled")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION))
    ranked = known.filter(part == 0).withColumn("h", F.xxhash64("doc_id", F.lit(1))).orderBy("h", "doc_id").limit(sample_rows)
    sample = written(ranked.drop("h"), "calibration")
    kinds = lambda rows: {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    of_known, of_sample = kinds(known), kinds(sample)
    if any(of_sample.get(kind) == n for kind, n in of_known.items()):
        sample = sample.limit(0)
    rest = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    # One plan at every size: both sides are shuffled by id. The counting tasks are few and large, so that
    # each word is handed on by few of them.
    training = texts(docs).join(rest.hint("merge"), "doc_id").select("toxic", "text")
    words, grams = counts(training.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism))
    seen, unseen = (written(t, "ratios") for t in ratios(grams))
    by_word, unseen_word = word_ratios(words)
    model = Model((seen, unseen, written(by_word, "word-ratios")), unseen_word)
    chosen = texts(docs).join(F.broadcast(sample), "doc_id").select(F.col("toxic").alias("id"), "text")
    found = differences(chosen, model).select(F.col("id").alias("toxic"), "x").limit(2 * sample_rows).toPandas()
    order = np.lexsort((found["toxic"], found["x"]))
    x, y = (found[c].to_numpy(np.float64)[order] for c in ("x", "toxic"))
    model.weights = calibrated(x, y, of_known.get(1, 0), of_known.get(0, 0))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    raw = float(model.weights[0]) + float(model.weights[1]) * F.col("x")
    found = differences(texts(docs).select(F.col("doc_id").alias("id"), "text"), model)
    scored = found.select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
