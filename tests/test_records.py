"""Laws of record sets and trees; append, files and streams."""

import random
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from lakestate.operators import append as ap
from lakestate.operators import ingest as ig
from lakestate.operators import merkle as mk
from lakestate.operators import policy as po
from lakestate.operators import recordset as xs
from lakestate.session import run_dir
from lakestate.sources import feeds as fd
from lakestate.sources import files as fl
from lakestate.streaming import jobs, keyed

ROWS = "kind string, record_id string, payload string"


def some(spark, n, change=(), drop=()):
    rows = [("entity", f"id{i}", f'{{"n":{i + (1000 if i in change else 0)}}}') for i in range(n) if i not in drop]
    random.Random(4).shuffle(rows)
    return xs.records(spark.createDataFrame(rows, ROWS))


def root_of(recs, bits=8):
    return mk.root(mk.tree(recs, bits), bits).first().hash


def test_root_is_order_independent_and_sensitive(spark):
    assert root_of(some(spark, 300)) == root_of(some(spark, 300).repartition(9).orderBy(F.desc("key")))
    assert root_of(some(spark, 300)) != root_of(some(spark, 300, change={7}))


def test_tree_diff_equals_flat_diff(spark):
    left, right = some(spark, 800, change={1, 5}, drop={9}), some(spark, 800, drop={30, 31})
    flat = sorted(map(tuple, xs.diff(left, right).collect()))
    tree = sorted(map(tuple, mk.tree_diff(left, right, 8, mk.leaves(left, 8), mk.leaves(right, 8)).collect()))
    assert flat == tree and len(flat) == 5


def test_incremental_add_equals_rebuild(spark):
    old, extra = some(spark, 200), some(spark, 230, drop=set(range(200)))
    stored = mk.tree(old, 8).withColumn("version", F.lit(1))
    grown = mk.nodes_as_of(stored.unionByName(mk.add(stored, xs.descriptors(old), xs.descriptors(extra), 8, 2).select(*stored.columns)), 2)
    assert sorted(map(tuple, grown.select("level", "node_index", "hash").collect())) == sorted(
        map(tuple, mk.tree(some(spark, 230), 8).select("level", "node_index", "hash").collect()))


def test_merge_laws(spark):
    a, b, c = some(spark, 20), some(spark, 30, drop={1}), some(spark, 10)
    flat = lambda d: sorted(map(tuple, d.select("key", "fingerprint").collect()))
    assert flat(xs.merge([a, b])) == flat(xs.merge([b, a])) == flat(xs.merge([xs.merge([a, b]), c, a]))
    bad = xs.merge([a, some(spark, 20, change={3})]).filter("problem IS NOT NULL").collect()
    assert [(r.key, r.problem) for r in bad] == [("entity:id3", "collision")]


def test_append_refuses_a_batch_with_a_collision(spark):
    out = run_dir(spark, "t-append")
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    schema = make([("e", "a", "1")]).schema
    ids = lambda: sorted(r.record_id for r in ap.read_published(spark, out, schema).collect())
    ap.append_batch(spark, out, "b1", make([("e", "a", "1"), ("e", "b", "1"), ("e", "b", "1")]))
    assert ids() == ["a", "b"]
    ap.append_batch(spark, out, "b2", make([("e", "c", "1"), ("e", "a", "2")]))
    assert ids() == ["a", "b"]
    ap.append_batch(spark, out, "b3", make([("e", "c", "1"), ("e", "a", "1")]))
    ap.append_batch(spark, out, "b4", make([("e", "c", "1")]))
    assert ids() == ["a", "b", "c"]


def test_unpublished_rows_are_invisible(spark):
    out = run_dir(spark, "t-torn")
    batch = spark.createDataFrame([("e", "a", "1")], ROWS)
    ap.append_batch(spark, out, "b1", batch)
    spark.createDataFrame([("e", "torn", "1")], ROWS).write.parquet(f"{out}/data/batch=b2")
    assert [r.record_id for r in ap.read_published(spark, out, batch.schema).collect()] == ["a"]


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nname: Ada Lovelace\nage: 36\n---\nBody\n")
    (tmp_path / "sub" / "b.md").write_text("---\ntags: [x, y]\nnested:\n  k: 1\n---\n")
    (tmp_path / "c.md").write_text("no front matter")
    (tmp_path / "d.txt").write_text("---\nname: x\n---\n")
    (tmp_path / "e.md").write_text("---\nbad: [\n---\n")
    got = {r.path.rsplit("/", 1)[1]: (r.fields, r.body) for r in fl.scan_markdown(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ('{"age":36,"name":"Ada Lovelace"}', "Body\n")
    assert got["b.md"][0] == '{"nested":{"k":1},"tags":["x","y"]}'
    assert got["c.md"] == (None, "no front matter") and got["e.md"][0] is None and set(got) == {"a.md", "b.md", "c.md", "e.md"}


CHANGES = [
    # change, user, kind, k, delivery
    ("c1", "u1", "upsert", "1", 1), ("c2", "u1", "upsert", "2", 2), ("c3", "u2", "upsert", "1", 3),
    ("c1", "u1", "upsert", "1", 4), ("c4", "u1", "delete", None, 5), ("c5", "u1", "upsert", "2", 6), ("c6", "u2", "upsert", "1", 7),
]


def change_rows(spark, rows):
    base = spark.createDataFrame(rows, "change_id string, external_id string, kind string, k string, ord long")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("ord").cast("int"))
    return base.select(
        F.lit("s").alias("source_key"), "change_id", F.lit("user").alias("external_type"), "external_id", "kind",
        at.alias("effective_at"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit(None).cast("string").alias("revision"),
        F.when(F.col("k").isNotNull(), F.format_string('{"k": %s}', "k")).alias("props"), F.lit("x").alias("event_type"),
        F.lit(1.0).alias("amount"), at.alias("first_observed_at"), "ord",
    )


def test_stream_equals_batch_over_restarts_and_replays(spark):
    fields = {"k": "get_json_object(props, '$.k')"}
    placed = ig.in_order(ig.receipts(change_rows(spark, CHANGES)))
    want = sorted((r.change_id, r.slot_key, r.target_id) for r in ig.slot_retractions(placed, ig.project_slots(placed, fields)).collect())
    assert [(c, s) for c, s, _ in want] == [("c2", "k"), ("c4", "k")]
    landed, out = run_dir(spark, "t-landed"), run_dir(spark, "t-ingest")
    for n, part in enumerate((CHANGES[:1], CHANGES[1:4], CHANGES[4:5], CHANGES[5:])):
        change_rows(spark, part).coalesce(1).write.json(f"{landed}/{n}")
        keyed.slot_stream(spark, fd.read_source(spark, f"{landed}/*", "incremental"), fields, out).awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    got = sorted((r.change_id, r.slot_key, r.target_id) for r in keyed.retractions(events).collect())
    assert got == want
    state = Counter((r.external_id, r.slot_key, r.record_id) for r in keyed.open_slots(spark, out).collect())
    moves = events.select("external_id", "slot_key", "record_id", F.when(F.col("event") == "opened", 1).otherwise(-1).alias("n"))
    left = moves.groupBy("external_id", "slot_key", "record_id").agg(F.sum("n").alias("n")).filter("n <> 0").collect()
    assert state == Counter({(r.external_id, r.slot_key, r.record_id): r.n for r in left})


def test_boundaries_fire_without_new_data(spark):
    from datetime import datetime

    feed, out = run_dir(spark, "t-heads"), run_dir(spark, "t-due")
    day = lambda d, ms=0: datetime(2024, 1, d, 0, 0, 0, ms * 1000)
    schema = "entity_id string, boundary timestamp, at timestamp"
    heads = spark.readStream.schema(schema).parquet(f"{feed}/*")
    ticks = spark.readStream.schema("at timestamp").parquet(f"{out}/ticks/*")
    spark.createDataFrame([("a", day(3), day(1)), ("b", day(5), day(1)), ("c", None, day(1)), ("d", day(3), day(1))], schema).write.parquet(f"{feed}/0")
    seen = []

    def refresh(due, batch_id):
        seen.extend((r.entity_id, r.due) for r in due.collect())

    def at(d):
        spark.createDataFrame([(day(d),)], "at timestamp").write.parquet(f"{out}/ticks/{d}")
        seen.clear()
        keyed.boundary_stream(spark, heads, ticks, refresh, out).awaitTermination()
        return sorted(seen)

    assert at(2) == []
    assert at(3) == [("a", day(3)), ("d", day(3))]
    spark.createDataFrame([("a", day(6), day(3, 1)), ("b", day(9), day(3, 1))], schema).write.parquet(f"{feed}/1")  # b is postponed
    assert at(7) == [("a", day(6))]
    assert at(10) == [("b", day(9))]
    assert at(11) == []


def test_a_private_record_leaves_other_readers_roots(spark):
    grants = spark.createDataFrame(
        [(s, f"e{i}", "allow") for s, some in (("ann", (1, 2, 3)), ("bob", (1, 2)), ("cy", (4,))) for i in some] + [("bob", "e3", "deny"), ("cy", "e1", "allow"), ("cy", "e1", "deny")],
        "subject string, entity_id string, effect string",
    )
    rows = [(f"k{i}", f"f{i}", f"e{1 + i % 3}") for i in range(30)]
    roots = lambda some: {r.subject: (r.n, r.root) for r in po.reader_roots(spark.createDataFrame(some, "key string, fingerprint string, entity_id string"), grants).collect()}
    before, after = roots(rows), roots([*rows, ("private", "x", "e3")])
    assert before["bob"] == after["bob"] and before["ann"] != after["ann"] and before["ann"][0] == 30 and before["bob"][0] == 20
    assert roots(rows[::-1]) == before and "cy" not in before
    assert len({c["class"] for c in po.visibility_classes(grants)[0].collect()}) == 3
    assert roots([("k0", "other", "e1"), *rows[1:]])["bob"] != before["bob"]


def test_unfinished_requests_appear_after_patience(spark):
    from datetime import datetime

    rows = [("m1", "mutation.requested", datetime(2024, 1, 1, 10)), ("m1", "mutation.applied", datetime(2024, 1, 1, 10, 5)),
            ("m2", "mutation.requested", datetime(2024, 1, 1, 10, 1)), ("m9", "mutation.requested", datetime(2024, 1, 1, 18)),
            ("m8", "mutation.applied", datetime(2024, 1, 1, 18))]
    landed, out = run_dir(spark, "t-journal"), run_dir(spark, "t-late")
    schema = "mutation_id string, type string, occurred_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(landed)
    jobs.unfinished_stream(spark.readStream.schema(schema).parquet(landed), "1 HOUR", out).awaitTermination()
    assert [r.mutation_id for r in spark.read.parquet(f"{out}/rows").collect()] == ["m2"]


def slow_pages(rows, max_rows, max_bytes):
    """A plain walk in key order: {key: page}."""
    out, page, n, used = {}, 0, 0, 0
    for key, size in sorted(rows):
        size = size or 0
        if page and n < max_rows and used + size <= max_bytes:
            n, used = n + 1, used + size
        else:
            page, n, used = page + 1, 1, size
        out[key] = page
    return out


def test_pages_of_one_scope_equal_a_plain_walk(spark):
    rng = random.Random(12)
    rows = [(f"k{i:05d}", rng.choice([0, 0, 1, 7, 30, 99, 100, 101, 5_000, None])) for i in range(3_000)]
    rng.shuffle(rows)
    scoped = spark.createDataFrame([("all", k, b) for k, b in rows] + [("one", "x", 500), ("two", "x", 0), ("two", "y", None)], "scope string, k string, b bigint")
    for max_rows, max_bytes in ((1, 10), (4, 100), (50, 1_000), (10_000, 1 << 40)):
        found = fd.byte_bounded_pages(scoped.repartition(9), ["scope"], "k", "b", max_rows, max_bytes).collect()
        assert len(found) == len(rows) + 3
        assert {r.k: r.page for r in found if r.scope == "all"} == slow_pages(rows, max_rows, max_bytes)
        assert [(r.k, r.page) for r in found if r.scope == "one"] == [("x", 1)]
    assert fd.byte_bounded_pages(scoped.limit(0), ["scope"], "k", "b", 4, 100).count() == 0


def test_transfer_batches_refuse_keys_that_disagree(spark):
    recs = some(spark, 40).unionByName(some(spark, 40, change={3, 4}))
    found = xs.transfer_batches(recs.withColumn("peer", F.lit("p")), ["peer"], 7, 1 << 30).collect()
    sent = sorted((r.batch, r.n, r.first_key) for r in found if r.rule is None)
    assert [n for _, n, _ in sent] == [7, 7, 7, 7, 7, 3] and [k for _, _, k in sent] == sorted(k for _, _, k in sent)
    assert sorted(r.first_key for r in found if r.rule == "collision") == ["entity:id3", "entity:id4"]


class HeldMap(dict):
    """A map state that counts how often it is asked."""

    calls = 0

    def _asked(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self._asked(bool(self))

    def containsKey(self, key):  # noqa: N802
        return self._asked(key in self)

    def updateValue(self, key, value):  # noqa: N802
        self._asked()
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self._asked()
        del self[key]

    def keys(self):
        return self._asked(iter(list(super().keys())))

    def iterator(self):
        return self._asked(iter(list(super().items())))


def test_slots_ask_their_state_once_a_change():
    states = {"seen": HeldMap(), "open": HeldMap()}
    slots = keyed.Slots()
    slots.init(SimpleNamespace(getMapState=lambda name, *_: states[name]))
    values = [i // 2 % 3 for i in range(200)]

    def change(i):
        now = [Row(slot_key="s", record_id=f"v{values[i]}", value=str(values[i]))] if i % 50 != 49 else []
        return Row(change_id=f"c{i}", ord=i, slots=now, effective_at=None, recorded_at=None)

    batches = [[change(i) for i in range(99, -1, -1)] + [change(3)], [change(i) for i in range(200)]]
    got = [r for b in batches for r in slots.handleInputRows(("a", "b", "c"), iter(b), None)]
    held, want = None, []
    for i, value in enumerate(values):
        now = None if i % 50 == 49 else f"v{value}"
        if now != held:
            want += [("closed", held, f"c{i}")] * (held is not None) + [("opened", now, f"c{i}")] * (now is not None)
        held = now
    assert [(r.event, r.record_id, r.change_id) for r in got] == want
    assert set(states["seen"]) == {(f"c{i}",) for i in range(200)} and not states["open"]
    assert sum(s.calls for s in states.values()) <= 100 + 200 + 100 + 10


def test_rows_meet_unknown_names_of_their_family_only(spark):
    def check(entities, names, whole=None):
        rows = [(f"r{i}", n) for i, n in enumerate(names)]
        obs = spark.createDataFrame(rows, "observation_id string, entity_id string")
        ali = spark.createDataFrame(rows[::2], "alias_id string, entity_id string")
        path = run_dir(spark, "t-refs")
        spark.createDataFrame([(r, n, entities[0]) for r, n in rows], "relation_id string, from_id string, to_id string").write.parquet(path)
        rel = spark.read.schema("relation_id string, from_id string, to_id string").parquet(path)
        out = ap.unknown_refs(obs, ali, rel, spark.createDataFrame([(e,) for e in entities], "entity_id string"))
        lost = [(r, n) for r, n in rows if n not in entities]
        want = [(r, n, "observation-entity") for r, n in lost] + [(r, n, "relation-from") for r, n in lost]
        want += [(r, n, "alias-entity") for r, n in rows[::2] if n not in entities]
        key = lambda r: tuple(x or "" for x in r)
        assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
        return out._jdf.queryExecution().optimizedPlan().toString()

    plan = check(["e://a/1", "e://b/1", "plain"], ["e://a/1", "e://a/2", "e://a/2", "e://b/1", "plain", "other", None, "e://c/x/1", ""])
    # No row is read for ends that are all known.
    assert "relation-to" not in plan and "relation-from" in plan
    check(["e://a/1"], [f"e://{i}/1" for i in range(ap.FAMILIES + 9)] + ["e://a/1", None])
