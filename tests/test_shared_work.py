"""Work that several steps share is done once."""

import hashlib
import os
from datetime import UTC, datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from lakestate.functions import values as vl
from lakestate.operators import capsule as cp
from lakestate.operators import retrieve as rt
from lakestate.operators import temporal as tp
from lakestate.plans.catalog import QUERIES
from lakestate.session import run_dir, shared_dir
from lakestate.sources.adapters import SCHEMAS
from lakestate.streaming import keyed
from test_state import OBS, RET, RULES, day, text, world

REL = (
    "relation_id string, from_id string, to_id string, relation_type string, valid_from timestamp, valid_to timestamp, "
    "recorded_at timestamp, evidence_refs array<string>"
)


def tables(spark):
    obs, ret, rules = world(5)
    rel = [(o[0].replace("o", "e"), o[1], "entity://e/1", "A", o[7], o[8], o[9], [o[0]]) for o in obs]
    ret += [(f"{r[0]}/e", "relation", r[2].replace("o", "e"), r[3], r[4]) for r in ret[::2]] + [("lost", "relation", "none", day(1), day(1))]
    names = [(f"a{i}", f"entity://e/{i}", f"e {i}", day(i * 9), ["x"]) for i in range(8)]
    out = {
        "entities": spark.createDataFrame([(n[1], "E") for n in names], "entity_id string, entity_type string"),
        "aliases": spark.createDataFrame(names, "alias_id string, entity_id string, value string, recorded_at timestamp, evidence_refs array<string>"),
        "observations": spark.createDataFrame(obs, OBS), "relations": spark.createDataFrame(rel, REL),
        "retractions": spark.createDataFrame(ret, RET), "authority_rules": spark.createDataFrame(rules, RULES),
    }
    return out, obs, rel, ret, names


def test_retractions_that_met_their_targets_answer_as_before(spark):
    t, obs, rel, ret, names = tables(spark)
    ended = tp.retracted(t["observations"], t["relations"], t["retractions"]).cache()
    probes = [tp.Probe("p", text(12), text(30)), tp.Probe("q", text(40), text(50))]
    for kind, table in (("observation", "observations"), ("relation", "relations")):
        want = tp.applied_retractions(t[table], t["retractions"], probes, kind).select("probe_id", "retraction_id")
        got = tp.applied(ended, probes).filter(F.col("target_kind") == kind).select("probe_id", "retraction_id")
        assert sorted(got.collect()) == sorted(want.collect()) != []
        ident = tp.RECORD_IDS[kind]
        assert sorted(tp.active(t[table], ended, probes, kind).select("probe_id", ident).collect()) == sorted(
            tp.active(t[table], t["retractions"], probes, kind).select("probe_id", ident).collect()
        )
    at, want = day(20), {}
    owners = {o[0]: (o[1], o[7], o[8], o[9]) for o in obs} | {r[0]: (r[1], r[4], r[5], r[6]) for r in rel}
    times = [(n[1], n[3]) for n in names]
    for who, start, end, known in owners.values():
        if end is None or max(start, known) < end:
            times += [(who, b) for b in (max(start, known), end) if b]
    for _, _, target, since, known in ret:
        if target in owners and (owners[target][2] is None or since < owners[target][2]):
            times.append((owners[target][0], max(since, known)))
    for who, b in times:
        if b > at:
            want[who] = min(want.get(who, b), b)
    rows = tp.next_boundary(t["aliases"], t["observations"], t["relations"], t["retractions"], F.lit(text(20)).cast("timestamp"), ended)
    assert {r.entity_id: r.next_boundary.replace(tzinfo=UTC) for r in rows.collect()} == want


def test_a_head_reads_the_relations_twice(spark):
    """Once for live edges, once for boundaries; the retractions met them before."""
    t = tables(spark)[0]
    path = run_dir(spark, "t-relations")
    t["relations"].write.parquet(path)
    t["relations"] = spark.read.schema(REL).parquet(path)
    rows, head = cp.materialize(t, text(20))
    plan = head._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "relation_type" in line for line in plan.splitlines()) == 2
    counts = {(r.entity_id, r.section): r["count"] for r in rows.groupBy("entity_id", "section").count().collect()}
    for r in head.collect():
        assert [r[f"n_{s}"] for s in ("state", "conflict", "relation", "retraction")] == [
            counts.get((r.entity_id, s), 0) for s in ("state", "conflict", "relation", "retraction")
        ]


def test_a_boundary_costs_two_calls_to_the_state():
    calls, timers = [], []

    def said(name, do):
        return lambda *a: (calls.append(name), do(*a))[1]

    handle = SimpleNamespace(
        listTimers=said("list", lambda: iter(list(timers))), registerTimer=said("register", timers.append), deleteTimer=said("delete", timers.remove)
    )
    watch = keyed.Boundaries()
    watch.init(handle)
    row = lambda boundary, at: {"boundary": boundary, "at": at}
    one, two = datetime(2024, 1, 3, tzinfo=UTC), datetime(2024, 1, 5, tzinfo=UTC)
    list(watch.handleInputRows(("a",), iter([row(one, one)]), None))
    assert calls == ["list", "register"] and timers == [1704240000000]
    list(watch.handleInputRows(("a",), iter([row(one, two)]), None))
    assert timers == [1704240000000]
    list(watch.handleInputRows(("a",), iter([row(two, two), row(one, one)]), None))
    assert timers == [1704412800000]
    list(watch.handleInputRows(("a",), iter([row(None, two)]), None))
    assert timers == []
    calls.clear()
    list(watch.handleInputRows((keyed.TICK,), iter([row(None, two)]), None))
    due = SimpleNamespace(getExpiryTimeInMs=lambda: 7)
    assert [tuple(r) for r in watch.handleExpiredTimer(("a",), None, due)] == [("a", 7)] and calls == []


def test_terms_are_counted_in_their_row(spark):
    texts = {"r1": "b a b, c-b", "r2": "", "r3": "a", "r4": "zz zz YY zz"}
    records = spark.createDataFrame([(r, "e", t) for r, t in texts.items()], "record_id string, entity_id string, text string")
    names = spark.createDataFrame([("e", "ee"), ("e", "aa")], "entity_id string, value string")
    post = rt.postings(rt.searchable(records, names))
    assert "Aggregate" not in post._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.record_id, r.term, r.tf, r.dl) for r in post.collect())
    own = {"r1": [], "r2": [], "r3": [], "r4": [("yy", 1), ("zz", 3)]}
    want = sorted((r, t, n, 2 + sum(c for _, c in own[r])) for r in own for t, n in [("aa", 1), ("ee", 1), *own[r]])
    assert got == want


def test_hashes_of_material_travel_as_bytes_and_applied_retractions_are_written(spark, monkeypatch):
    labels, write = [], cp.written
    monkeypatch.setattr(cp, "written", lambda df, label: labels.append(label) or write(df, label))
    rows, head = cp.materialize(tables(spark)[0], text(20))
    assert "applied" in labels and "unhex(sha2(" in head._jdf.queryExecution().optimizedPlan().toString()
    # Digests are those of the rows' hashes in digits, sorted by strand.
    sha, of = lambda t: hashlib.sha256(t.encode()).hexdigest(), {}
    for r in rows.select("entity_id", vl.json_list("section", "text").alias("t")).collect():
        of.setdefault(r.entity_id, []).append(sha(r.t))
    for r in head.collect():
        strands = {}
        for h in sorted(of[r.entity_id]):
            strands.setdefault(h[:4], []).append(h)
        assert r.material_digest == sha("".join(sha("".join(strands[k])) for k in sorted(strands)))


def test_retractions_that_are_at_hand_are_not_joined_again(spark, monkeypatch):
    t = tables(spark)[0]
    only = spark.createDataFrame([("entity://e/0",), ("entity://e/3",), ("entity://e/9",)], "entity_id string")
    want = sorted(cp.materialize(t, text(20), only=only)[1].collect())
    ended = tp.retracted(t["observations"], t["relations"], t["retractions"])
    monkeypatch.setattr(tp, "retracted", None)
    assert sorted(cp.materialize(t, text(20), only=only, ended=ended)[1].collect()) == want and len(want) == 2


def test_a_refresh_leaves_the_tables_of_its_last_build_alone(spark, tmp_path):
    """Of three builds, only the last one's retractions are on disk at the end."""
    own = {
        "region": [(0, "R")], "nation": [(0, "N", 0)], "customer": [(1, "C", 0, 1.0, "BUILDING")], "supplier": [(1, "S", 0, 1.0)],
        "part": [(1, "P", "B", "T", 1, 1.0)], "orders": [(1, 1, "F", 5.0, datetime(1999, 1, 1), "1-URGENT")],
        "lineitem": [(1, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "F", datetime(2000, 6, 1))], "events": [(1, datetime(1999, 2, 1), 1, "view", 1.0, "{}")],
    }
    for name, rows in own.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = lambda: [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("ended-")]
    before = len(kept())
    got = QUERIES["capsule_refresh"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(0, 6)] and len(kept()) - before == 2
