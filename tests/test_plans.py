"""Write-back drift, group digests, rules and texts with awkward characters."""

import hashlib
import json

from pyspark.sql import functions as F

from lakestate.functions import values as vl
from lakestate.operators import append as ap
from lakestate.operators import capsule as cp
from lakestate.operators import plan as pl
from lakestate.operators import resolve as rs


def test_group_digest_is_a_sorted_two_level_hash(spark):
    rows = [("a", f"row {i}") for i in range(40)] + [("b", "only"), ("b", "only")]
    got = {r.k: r.digest for r in vl.group_digest(spark.createDataFrame(rows, "k string, t string").repartition(5), ["k"], F.col("t")).collect()}

    def want(texts):
        strands = {}
        for h in sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts):
            strands.setdefault(h[:4], []).append(h)
        return hashlib.sha256("".join(hashlib.sha256("".join(strands[s]).encode()).hexdigest() for s in sorted(strands)).encode()).hexdigest()

    assert got == {k: want([t for o, t in rows if o == k]) for k in ("a", "b")}


def test_json_lists_keep_parts_apart(spark):
    rows = [("q|x", "y"), ("q", "x|y"), (None, "q"), ("q", None)]
    got = [r.t for r in spark.createDataFrame(rows, "a string, b string").select(vl.json_list("a", "b").alias("t")).collect()]
    assert [json.loads(t) for t in got] == [list(r) for r in rows] and len(set(got)) == 4


PLACE = "entity_id string, provider string, external_id string, external string"
MOVES = PLACE + ", property string, next_json string, previous_json string, base_revision string"
DOUBTS = "entity_id string, property string, reason string, provider string, external_id string, value_json string"


def plans(spark, moves, doubts, entities=("e1", "e2")):
    frame = spark.createDataFrame([(e,) for e in entities], "entity_id string")
    resolved = spark.createDataFrame([(d[0], d[1], "conflict") for d in {(d[0], d[1]) for d in doubts}], "entity_id string, property string, status string")
    return pl.proposals(frame, spark.createDataFrame(moves, MOVES), resolved, spark.createDataFrame(doubts, DOUBTS))


def drifted(before, after):
    return {r.entity_id for r in pl.plan_drift(before, after).collect()}


def test_drift_by_revision_candidate_and_vanished_entity(spark):
    move = ("e1", "crm", "1", "f", "p", '"n"', '"o"', "r1")
    doubt = [("e2", "q", "ambiguous-freshest", "a", "1", '"x"'), ("e2", "q", "ambiguous-freshest", "b", "1", '"y"')]
    before = plans(spark, [move], doubt).cache()
    assert drifted(before, plans(spark, [move], doubt[::-1])) == set()
    assert drifted(before, plans(spark, [(*move[:-1], "r2")], doubt)) == {"e1"}
    assert drifted(before, plans(spark, [(*move[:-1], None)], doubt)) == {"e1"}
    assert drifted(before, plans(spark, [move], [doubt[0], (*doubt[1][:-1], '"z"')])) == {"e2"}
    assert drifted(before, plans(spark, [move], [doubt[0], ("e2", "q", "ambiguous-freshest", "b|1", "", '"y"')])) == {"e2"}
    assert drifted(before, plans(spark, [move], [], ("e1",))) == {"e2"}
    assert {r.entity_id: r.status for r in before.collect()} == {"e1": "ready", "e2": "blocked"}


def test_outcomes(spark):
    before = spark.createDataFrame([("a", "ready"), ("b", "ready"), ("c", "ready"), ("d", "noop"), ("e", "blocked")], "entity_id string, status string")
    left = spark.createDataFrame([("b",)], "entity_id string")
    moved = spark.createDataFrame([("c",), ("d",)], "entity_id string")
    real = {r.entity_id: r.outcome for r in pl.outcomes(before, left, moved).collect()}
    assert real == {"a": "converged", "b": "not-converged", "c": "drifted", "d": "noop", "e": "blocked"}
    dry = {r.entity_id: r.outcome for r in pl.outcomes(before, left, moved, dry_run=True).collect()}
    assert dry == {"a": "dry-run", "b": "dry-run", "c": "drifted", "d": "noop", "e": "blocked"}


def test_the_last_rule_counts(spark):
    cands = spark.createDataFrame(
        [("e", "p", "o1", '"x"', "a", "1", "r"), ("e", "p", "o2", '"y"', "b", "1", "r")],
        "entity_id string, property string, observation_id string, value_json string, provider string, external_id string, revision string",
    ).withColumn("observed_at", F.lit("2024-01-01").cast("timestamp"))
    rules = spark.createDataFrame([("e", "p", "provider", ["a"], 1), ("e", "p", "provider", ["b"], 2)], "entity_id string, property string, kind string, providers array<string>, position int")
    (row,) = rs.resolve(cands, rules, ["entity_id", "property"]).collect()
    assert (row.status, row.provider, row.n_candidates) == ("resolved", "b", 1)


def test_related_entities_whatever_the_relation_type(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    edges = spark.createDataFrame([("a", "owns|leases", "b|c", "r1")], "from_id string, relation_type string, to_id string, relation_id string")
    rows = cp.material_rows(
        spark.createDataFrame([("a", "T", None, 0)], "entity_id string, entity_type string, name string, n_aliases int"),
        empty("entity_id string, property string, value_json string, provider string, external_id string"),
        empty("entity_id string, property string, reason string, observation_id string, value_json string"),
        edges, empty("entity_id string, retraction_id string"),
    )
    assert [tuple(r) for r in cp.related(rows).collect()] == [("a", "b|c")]


def test_a_relations_retraction_touches_both_ends(spark):
    retractions = spark.createDataFrame([("r1", "relation", "x"), ("r2", "observation", "x"), ("r3", "relation", "y"), ("r4", "relation", "gone")], "retraction_id string, target_kind string, target_id string")
    observations = spark.createDataFrame([("x", "e")], "observation_id string, entity_id string")
    relations = spark.createDataFrame([("x", "a", "b"), ("y", "c", "c")], "relation_id string, from_id string, to_id string")
    got = sorted((r.record_id, r.primary_entity_id) for r in ap.retraction_changes(retractions, observations, relations).collect())
    assert got == [("r1", "a"), ("r1", "b"), ("r2", "e"), ("r3", "c")]


def test_published_batches_with_awkward_ids(spark):
    from lakestate.session import run_dir

    root = run_dir(spark, "append-test")
    batch = spark.createDataFrame([("alias", "1", "x")], "kind string, record_id string, payload string")
    other = spark.createDataFrame([("alias", "2", "y")], "kind string, record_id string, payload string")
    ap.append_batch(spark, root, "b:1/a b", batch)
    ap.append_batch(spark, root, "2024-01-01", other)
    assert sorted(r.record_id for r in ap.read_published(spark, root, batch.schema).collect()) == ["1", "2"]


def test_a_page_numbers_no_more_rows_than_it_needs(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"{k}{i:03d}", f"e{i % 7}") for k in ap.KIND_ORDER for i in range(100)], "kind string, record_id string, primary_entity_id string").repartition(5)
    whole = ap.emit_changes(rows, 1000).collect()
    want = {after: sorted((r.seq, r.kind, r.record_id) for r in whole if after < r.seq <= max(after, 1000) + 30) for after in (900, 1000, 1120, 1490, 2000)}
    numbered, emit = [], ap.emit_changes
    monkeypatch.setattr(ap, "emit_changes", lambda df, last: numbered.append(df.count()) or emit(df, last))
    for near in (ap.NEAR, 0):
        monkeypatch.setattr(ap, "NEAR", near)
        assert {after: [(r.seq, r.kind, r.record_id) for r in ap.emit_page(rows, 1000, after, 30).collect()] for after in want} == want
    assert numbered == [30, 30, 150, 500, 500] + [500] * 5


def test_a_plan_reads_its_mutations_once_and_a_dry_run_plans_nothing_anew(spark):
    from lakestate.session import run_dir

    path = run_dir(spark, "t-moves")
    move = ("e1", "crm", "1", "f", "p", '"n"', '"o"', "r1")
    spark.createDataFrame([move, ("e1", "crm", "1", "g", *move[4:]), ("e3", *move[1:])], MOVES).write.parquet(path)
    frame = spark.createDataFrame([(e,) for e in ("e1", "e2", "e3", "e3")], "entity_id string")
    resolved = spark.createDataFrame([("e3", "q", "conflict"), ("e2", "q", "resolved")], "entity_id string, property string, status string")
    doubts = spark.createDataFrame([("e3", "q", "ambiguous-freshest", "a", "1", '"x"'), ("e3", "q", "ambiguous-freshest", "b", "1", '"y"')], DOUBTS)
    told = pl.proposals(frame, spark.read.schema(MOVES).parquet(path), resolved, doubts)
    assert told.columns == ["entity_id", "n_mutations", "n_conflicts", "digest", "status"]
    got = {r.entity_id: (r.n_mutations, r.n_conflicts, r.status) for r in told.collect()}
    assert got == {"e1": (2, 0, "ready"), "e2": (0, 0, "noop"), "e3": (1, 1, "blocked")}
    assert told._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    dry = {r.entity_id: r.outcome for r in pl.outcomes(told, None, frame.limit(0), dry_run=True).collect()}
    assert dry == {"e1": "dry-run", "e2": "noop", "e3": "blocked"}


def test_a_feed_sorts_one_kind_at_a_time(spark, monkeypatch):
    kinds = ["retraction", None, "alias", "other", "entity", "alias"]
    rows = spark.createDataFrame([(k, f"r{i % 3}", f"e{i}") for i, k in enumerate(kinds)], "kind string, record_id string, primary_entity_id string")
    sorted_at_once, number = [], ap.with_sequence
    monkeypatch.setattr(ap, "with_sequence", lambda df, *a: sorted_at_once.append({r.kind for r in df.collect()} - {None, "other"}) or number(df, *a))
    got = sorted((r.seq, r.kind, r.record_id, r.primary_entity_id) for r in ap.emit_changes(rows, 7).collect())
    # Kinds without a place in the order come first.
    assert got == [(8, "other", "r0", "e3"), (9, None, "r1", "e1"), (10, "entity", "r1", "e4"), (11, "alias", "r2", "e2"), (12, "alias", "r2", "e5"), (13, "retraction", "r0", "e0")]
    assert all(len(kinds) <= 1 for kinds in sorted_at_once)
