"""Greedy budget, text rules, names, hidden rows."""

import math
import random
import unicodedata

from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.functions import values as vl
from lakestate.operators import identity as idn
from lakestate.operators import policy as po
from lakestate.operators import retrieve as rt
from lakestate.sources.adapters import Lake


def walk(rows, budget, cap=None):
    used, out = 0, []
    for score, ident, cost in sorted(rows, key=lambda r: (-r[0], r[1])):
        if cap is not None and len(out) >= cap:
            break
        if used + cost <= budget:
            used += cost
            out.append(ident)
    return out


def test_budget_equals_plain_walk(spark):
    rng = random.Random(3)
    budgets = {f"q{i}": rng.choice([0, 9, 60, 200, 777]) for i in range(8)}
    rows = [(q, f"r{i:04d}", rng.randrange(9, 120), float(rng.randrange(40))) for q in budgets for i in range(300)]
    ranked = spark.createDataFrame(rows, "query_id string, record_id string, cost int, score double")
    queries = spark.createDataFrame(list(budgets.items()), "query_id string, budget_tokens int")
    for cap in (None, 3):
        got = {q: [] for q in budgets}
        for r in rt.fill_budget(ranked, queries, max_picks=cap).orderBy("query_id", "position").collect():
            got[r.query_id].append(r.record_id)
        for q, budget in budgets.items():
            assert got[q] == walk([(s, i, c) for qq, i, c, s in rows if qq == q], budget, cap)


def test_text_rules(spark):
    samples = ["ﬁne  Ａbc-é!", "étude", "İ", "", "a b2 c", "😀 x", "Größe №5"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select("s", tx.nfkc(F.col("s")).alias("n"), tx.normalize(F.col("s")).alias("f"),
                    tx.term_list(tx.normalize(F.col("s"))).alias("t"), tx.utf16_length(F.col("s")).alias("u")).collect()
    for r in got:
        assert r.n == unicodedata.normalize("NFKC", r.s)
        assert r.u == len(r.s.encode("utf-16-be")) // 2
    assert got[0].f == "fine abc é" and got[4].t == ["b2"]


def test_values(spark):
    rows = [('{"b":1.0,"a":[true,null,"x, 1.0"]}',), ('"entity://a/1"',), ('{"entity://k/1":{"r":["entity://b/2"]}}',), ("{bad",), ("1e2",)]
    got = spark.createDataFrame(rows, "v string").select(
        vl.canonical_json(F.col("v")).alias("c"), vl.entity_refs(F.col("v")).alias("r")).collect()
    assert got[0].c == '{"a":[true,null,"x, 1.0"],"b":1}'
    assert got[1].r == ["entity://a/1"] and got[2].r == ["entity://b/2"]
    assert got[3].c is None and got[4].c == "100"


def test_hmac_equals_library(spark):
    import hashlib
    import hmac

    key = vl.epoch_key(b"s", "e1")
    inner, outer = (F.lit(bytearray(p)) for p in vl.hmac_pads(key))
    got = spark.range(1).select(vl.hmac_tag(inner, outer, "d", "p", F.lit("v")).alias("t")).first().t
    assert got == hmac.new(key, b'["d","p","v"]', hashlib.sha256).hexdigest()


NAMES = "alias_id string, entity_id string, value string, recorded_at timestamp, evidence_refs array<string>"


def names(spark, rows):
    return spark.createDataFrame(rows, "alias_id string, entity_id string, value string").withColumn(
        "recorded_at", F.lit("2020-01-01").cast("timestamp")).withColumn("evidence_refs", F.array())


def test_ambiguity_and_cues(spark):
    aliases = names(spark, [("1", "entity://p/atlas", "Atlas"), ("2", "entity://d/atlas", "ATLAS"), ("3", "entity://d/atlas", "Atlas Works"), ("4", "entity://d/x", "!!")])
    entities = spark.createDataFrame([("entity://p/atlas", "Project"), ("entity://d/atlas", "Device"), ("entity://d/x", "Device")], "entity_id string, entity_type string")
    types = spark.createDataFrame([("Project", ["project"]), ("Device", ["device", "gerät"])], "type_id string, aliases array<string>")
    queries = spark.createDataFrame([("plain", "about atlas"), ("cue", "the project Atlas"), ("german", "Gerät atlas"), ("long", "atlas works now"), ("none", "atlasworks")], "query_id string, text string")
    got = {r.query_id: (r.status, r.entity_id) for r in idn.resolve_entities(queries, idn.alias_index(aliases), entities, types).collect()}
    assert got == {"plain": ("ambiguous", None), "cue": ("resolved", "entity://p/atlas"), "german": ("resolved", "entity://d/atlas"),
                   "long": ("resolved", "entity://d/atlas"), "none": ("none", None)}


def test_hidden_entities_change_nothing(spark):
    """A name shared with a hidden entity is not ambiguous for who cannot see it."""
    aliases = names(spark, [("1", "entity://a/1", "Atlas"), ("2", "entity://a/2", "Atlas")])
    entities = spark.createDataFrame([("entity://a/1", "A"), ("entity://a/2", "A")], "entity_id string, entity_type string")
    types = spark.createDataFrame([("A", ["thing"])], "type_id string, aliases array<string>")
    grants = spark.createDataFrame([("one", "entity://a/1", "allow"), ("both", "entity://a/1", "allow"), ("both", "entity://a/2", "allow"),
                                    ("torn", "entity://a/1", "allow"), ("torn", "entity://a/1", "deny")], "subject string, entity_id string, effect string")
    queries = spark.createDataFrame([("q", "what is atlas", 100)], "query_id string, text string, budget_tokens int")
    records = spark.createDataFrame([("r1", "entity://a/1", "atlas is tall", "1"), ("r2", "entity://a/1", "atlas knows it", '["entity://a/2"]')],
                                    "record_id string, entity_id string, text string, value_json string")
    found, picks = po.secure_compile(queries, grants, idn.alias_index(aliases), entities, types, records, aliases.select("entity_id", "value"))
    assert {r.subject: r.status for r in found.collect()} == {"one": "resolved", "both": "ambiguous"}
    assert [r.record_id for r in picks.collect()] == ["r1"]


def test_exploded_tables_are_not_taken_for_small_ones(spark):
    seen = Lake(spark, "/root/testdata/sf0.1").order_observations().select("entity_id", "observation_id", "recorded_at")
    estimate = int(str(seen._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate > 16 * seen.count()


def test_prior_ranking_pairs_named_queries_with_their_records_only(spark, monkeypatch):
    n, sizes = 40, []
    records = spark.createDataFrame(
        [(f"r{i}", f"e{i}", f"order status of name{i}", "state", True, 1.0) for i in range(n)],
        "record_id string, entity_id string, text string, kind string, current boolean, importance double")
    names = spark.createDataFrame([(f"e{i}", f"name{i}") for i in range(n)], "entity_id string, value string")
    index = idn.alias_index(names.withColumn("recorded_at", F.lit("1990-01-01").cast("timestamp")))
    queries = spark.createDataFrame([(f"q{i}", f"what was the order status of name{i}", 200) for i in range(n)], "query_id string, text string, budget_tokens int")
    pinned = rt.pinned
    monkeypatch.setattr(rt, "pinned", lambda df: sizes.append((out := pinned(df)).count()) or out)
    got = rt.prior_rank(queries, records, index).collect()
    assert {(r.query_id, r.record_id, r.score) for r in got} == {(f"q{i}", f"r{i}", 30 + 8 * 4 + 8 + 10 + 18) for i in range(n)}
    assert sum(sizes) <= 2 * n


def test_prior_ranking_of_open_queries_keeps_what_a_budget_has_room_for(spark, monkeypatch):
    """Every record has the common word, so every pair of a query and a record shares a term."""
    rng = random.Random(4)
    texts = [" ".join(["common", *rng.choices(["aa", "bb", "cc", "dd"], k=rng.choice([1, 1, 1, 4]))]) for _ in range(300)]
    records = spark.createDataFrame(
        [(f"r{i % 290:03d}", f"e{i % 290}", t, "state", bool(i % 290 % 2), None) for i, t in enumerate(texts[:290] + texts[:10])],
        "record_id string, entity_id string, text string, kind string, current boolean, importance double")
    index = idn.alias_index(spark.createDataFrame([("e0", "nobody asks for")], "entity_id string, value string").withColumn("recorded_at", F.lit("1990-01-01").cast("timestamp")))
    asked = {"q0": ("common aa", 60), "q1": ("common bb cc", 25), "q2": ("zz", 40), "q3": ("dd", 11)}
    queries = spark.createDataFrame([(q, t, b) for q, (t, b) in asked.items()], "query_id string, text string, budget_tokens int")
    monkeypatch.setattr(rt, "CELL_DOCS", 20)
    monkeypatch.setattr(rt, "CELL_QUERIES", 2)
    monkeypatch.setattr(rt, "CELL_HITS", 7)
    ranked = rt.prior_rank(queries, records, index).cache()
    assert ranked.count() < 300
    want = {}
    for q, (text, budget) in asked.items():
        rows = []
        for i, t in enumerate(texts[:290]):
            shared = len(set(text.split()) & set(t.split())) * (2 if i < 10 else 1)
            rows += [(-(8 * shared + 8 * (i % 2) + 5 + 18), f"r{i:03d}", math.ceil(len(t) / 4) + 8)] * (2 if i < 10 and not shared else 1)
        left, want[q] = budget, []
        for _, r, cost in sorted(rows):
            if cost <= left:
                left -= cost
                want[q].append(r)
    got = {q: [] for q in asked}
    for r in rt.fill_budget(ranked, queries).orderBy("query_id", "position").collect():
        got[r.query_id].append(r.record_id)
    assert got == want


def test_scan_tests_few_pairs_and_finds_all(spark):
    n = 30
    names = spark.createDataFrame([(f"e{i}", f"kind{i} ring") for i in range(n)] + [("e", "old ring")], "entity_id string, value string")
    index = idn.alias_index(names.withColumn("recorded_at", F.lit("1990-01-01").cast("timestamp")))
    queries = spark.createDataFrame([(f"q{i}", f"the ring of kind{i} Ring or so") for i in range(n)], "query_id string, text string")
    assert idn.scan_pairs(queries, index).count() <= 2 * n
    pairs = {(r.query_id, r.entity_id) for r in idn.scanned(queries, index).collect()}
    assert pairs == {(f"q{i}", f"e{i}") for i in range(n)} == {(r.query_id, r.entity_id) for r in idn.untyped(queries, index).collect()}


def test_pairs_are_scored_once_whatever_the_cells(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "and", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(60)]
    docs = spark.createDataFrame([(f"r{i:02d}", f"e{i % 3}", 9 + i, t.split()) for i, t in enumerate(texts)], "record_id string, entity_id string, cost int, terms array<string>")
    asked = {f"q{i}": " ".join(rng.choices(words, k=6)) for i in range(9)}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    n, avg = len(texts), sum(len(t.split()) for t in texts) / len(texts)
    df = {w: sum(w in t.split() for t in texts) for w in words}
    want, held = {}, {}
    for q, text in asked.items():
        for i, t in enumerate(t.split() for t in texts):
            shared = set(text.split()) & set(t)
            if shared:
                held[q, f"r{i:02d}"] = float(len(shared))
                want[q, f"r{i:02d}"] = sum(
                    math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in shared
                )
    for most in ({}, {"CELL_DOCS": 7, "CELL_QUERIES": 2, "CELL_HITS": 3}):
        for name, value in most.items():
            monkeypatch.setattr(rt, name, value)
        got = {(r.query_id, r.record_id): r.score for r in rt.bm25(queries, docs).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
        assert {(r.query_id, r.record_id): r.score for r in rt.lexical(queries, docs).collect()} == held
        both = rt.fuse_lexical(queries, docs)
        plain = {(r.query_id, r.record_id): r.score for r in rt.fuse([rt.bm25(queries, docs), rt.lexical(queries, docs)]).collect()}
        assert {(r.query_id, r.record_id): r.score for r in both.collect()} == plain
        assert both._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    twice = docs.unionByName(docs.filter("record_id = 'r03'"))
    assert rt.lexical(queries, twice).groupBy("query_id", "record_id").count().filter("count > 1").isEmpty()
    assert rt.bm25(queries, docs.limit(0)).isEmpty() and rt.bm25(queries.limit(0), docs).isEmpty()


def test_terms_are_no_rows_before_a_candidate_meets_its_query(spark):
    terms = {"r0": ["a", "b", "a"], "r1": ["b", "c"], "r2": [], "r3": ["x"] * 4}
    docs = spark.createDataFrame([(r, "e", 9, t) for r, t in terms.items()], "record_id string, entity_id string, cost int, terms array<string>")
    queries = spark.createDataFrame([("q0", "aa bb"), ("q1", "cc")], "query_id string, text string")
    docs = docs.withColumn("terms", F.transform("terms", lambda t: F.concat(t, t)))
    cands = spark.createDataFrame([("q0", "r0"), ("q0", "r1"), ("q0", "r2"), ("q1", "r1"), ("q1", "r3")], "query_id string, record_id string")
    got = {(r.query_id, r.record_id): r.score for r in rt.bm25_among(queries, docs, cands).collect()}
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, avg: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    want = {("q0", "r0"): idf(3, 1) * part(2, 3, 5 / 3) + idf(3, 2) * part(1, 3, 5 / 3), ("q0", "r1"): idf(3, 2) * part(1, 2, 5 / 3), ("q1", "r1"): idf(2, 1) * part(1, 2, 3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    plan = rt.bm25_among(queries, docs, cands)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("explode(") == 1  # the document frequencies
