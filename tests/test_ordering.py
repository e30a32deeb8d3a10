"""Positions and look-ups with one key holding most rows, against brute force."""

import random

from pyspark.sql import functions as F

from lakestate.functions.ordering import as_of_lookup, previous, with_ordinal, with_sequence


def hot_rows(n=4000, seed=1):
    rng = random.Random(seed)
    times = rng.sample(range(100000), n)
    return [("hot" if i % 3 else f"k{rng.randrange(40)}", t) for i, t in enumerate(times)]


def test_ordinal_is_dense_with_a_hot_key(spark):
    rows = hot_rows()
    got = with_ordinal(spark.createDataFrame(rows, "k string, t long").repartition(7), ["k"], ["t"]).collect()
    want = {}
    for key, t in sorted(rows):
        want.setdefault(key, []).append(t)
    assert len(got) == len(rows)
    assert all(want[r.k][r.ordinal - 1] == r.t for r in got)


def test_previous_is_lag(spark):
    rows = hot_rows(600)
    placed = with_ordinal(spark.createDataFrame(rows, "k string, t long"), ["k"], ["t"])
    got = {(r.k, r.t): r.prev_t for r in previous(placed, ["k"], ["t"]).collect()}
    last = {}
    for key, t in sorted(rows):
        assert got[(key, t)] == last.get(key)
        last[key] = t


def test_sequence_is_dense_and_ordered(spark):
    rows = hot_rows(3000)
    got = with_sequence(spark.createDataFrame(rows, "k string, t long"), ["k", "t"], 50).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(51, 51 + len(rows)))
    assert [(r.k, r.t) for r in got] == sorted(rows)


def test_as_of_lookup_with_a_hot_key(spark):
    rows, asks = hot_rows(2000, 2), hot_rows(1500, 3)
    right = spark.createDataFrame(rows, "k string, s long")
    left = spark.createDataFrame(asks, "k string, at long")
    got = {(r.k, r["at"]): r.s for r in as_of_lookup(left, right, ["k"], "at", "s").collect()}
    for key, at in asks:
        best = max((s for k, s in rows if k == key and s <= at), default=None)
        assert got.get((key, at)) == best
