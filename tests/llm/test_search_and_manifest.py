"""Merkle manifest and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD, frame
from pyspark.sql import functions as F

from lakestate.llm import merkle_manifest, ranked_search


def digest(text):
    return hashlib.sha256(text).hexdigest()


def leaf(row):
    return digest(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3]).encode()) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, place):
    runs = []
    for nodes in tree[:-1]:
        start = place // 3 * 3
        runs.append((nodes[start : start + 3], place - start))
        place //= 3
    return runs


def slow_manifest(rows):
    """What the query returns for rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = Counter()
    for i, s in enumerate(sources):
        for place, row in enumerate(by[s]):
            runs = path(trees[s], place) + path(top, i)
            proof = digest("".join(n for run, at in runs for j, n in enumerate(run) if j != at).encode())
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*row[:4], text))
            for run, at in runs:
                node = digest("".join([*run[:at], node, *run[at + 1 :]]).encode())
            out[row[0], leaf(row), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]] += 1
    return out


def verified(docs, **options):
    found = merkle_manifest.verify(merkle_manifest.manifest(docs, merkle_manifest.tampered_text(), **options))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("count", "height"), [(500, 2), (60, 1), (300, 8), (1, 2), (0, 2)])
def test_manifest_by_brute_force(spark, count, height):
    rng = random.Random(count)
    sources = [None, "", "a", "Z", "é", "hot", "hot", "hot", *[f"s{i}" for i in range(20)]]
    rows = [
        (None if rng.random() < 0.05 else rng.randrange(-50, 400), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "plain", "é\n\n"]))
        for _ in range(count)
    ]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert verified(docs, levels=height) == slow_manifest(rows)


def test_manifest_of_odd_rows(odd, none):
    rows = [(d, "src", "en", None if t is None else len(t), t) for d, t in ODD]
    assert verified(odd) == slow_manifest(rows)
    assert not verified(none)


def test_witnesses_grow_with_the_tree():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 82):
        leaves = [rng.randbytes(32) for _ in range(n)]
        tree = merkle_manifest.Appender()
        for one in leaves:
            tree.append(one)
        root = tree.finish()
        assert root.hex() == levels([x.hex() for x in leaves])[-1][0]
        for one, witness, steps in zip(leaves, tree.witnesses, tree.paths, strict=True):
            assert merkle_manifest.fold(one, bytes(witness), bytes(steps)) == root
            if n > 1:
                assert merkle_manifest.fold(rng.randbytes(32), bytes(witness), bytes(steps)) != root


def slow_search(docs, items, k):
    """All scores, term by term."""
    split = lambda t: re.findall("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(split(t))) for d, t in docs]
    some = [c for _, c in counted if c]
    n_docs, length = len(some), sum(c.total() for c in some)
    df = Counter(t for c in some for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, c in counted:
            total = 0
            for t in split(text):
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * c.total() * n_docs // length
                    total += weight * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if total > 0:
                scores.append((-total, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def ranked(spark, docs, items, k=10):
    found = ranked_search.search(docs, spark.createDataFrame(items, "item_id bigint, text string"), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("cells", [1 << 22, 2000])
def test_search_by_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)] + ["Café", "日本", "x9", "A"]
    text = lambda n: " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(n))
    docs = [(rng.randrange(2000) if rng.random() < 0.97 else None, text(rng.randrange(0, 120))) for _ in range(700)]
    items = [(i, text(rng.randrange(1, 40))) for i in range(60)] + [(7, "w1 w1 w2"), (7, None), (None, "w3-W4"), (70, ""), (71, "unseen")]
    docs += [(5000 + i, items[3][1]) for i in range(25)] + [(None, None), (6000, "...")]
    assert ranked(spark, frame(spark, docs).repartition(3), items) == slow_search(docs, items, 10)


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "one two"), (2, "same TEXT here word3 of1"), (3, "日本語のテキスト é" * 3), (4, None)]
    assert ranked(spark, odd, items, 3) == slow_search(ODD, items, 3)
    assert not ranked(spark, none, items)
    assert not ranked(spark, odd, [])


def test_whole_numbers_beyond_doubles():
    items = ranked_search.Items([0, 1], [b"a " * 3_000_000 + b"b", b"b"])
    weight = np.array([9000, 7000])
    search = ranked_search.Search(items, weight, 10, 100, 2)
    assert search.kind is np.int64
    search.add([4, 3, 9], np.array([2, 2, 5]), np.array([2, 3, 4]), np.array([0, 1, 1, 0]), np.array([1, 1, 2, 3]))
    value = lambda tf, n: 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * 10 // 100))
    want = sorted([(-3_000_000 * 9000 * value(1, 2) - 7000 * value(1, 2), 4), (-7000 * value(2, 2), 3), (-3_000_000 * 9000 * value(3, 5), 9)])[:2]
    got = [r for r in search.found().to_pylist() if r["seq"] == 0]
    assert [(-r["score"], r["doc_id"]) for r in got] == want


def test_manifest_without_a_claim_verifies(odd):
    assert merkle_manifest.verify(merkle_manifest.manifest(odd)).filter(~F.col("verified")).count() == 0
