"""Resolution against a plain resolver, and the laws it must keep."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakestate.operators import resolve as rs
from lakestate.operators import temporal as tp

OBS = (
    "observation_id string, entity_id string, property string, value_json string, provider string, external_id string, "
    "revision string, valid_from timestamp, valid_to timestamp, recorded_at timestamp"
)
RET = "retraction_id string, target_kind string, target_id string, effective_from timestamp, recorded_at timestamp"
RULES = "entity_id string, property string, kind string, providers array<string>"


def day(n):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=n)


def text(n):
    return day(n).strftime("%Y-%m-%d %H:%M:%S")


def world(seed, n=300):
    rng = random.Random(seed)
    obs, ret = [], []
    for i in range(n):
        start = rng.randrange(0, 40)
        end = start + rng.randrange(1, 20) if rng.random() < 0.4 else None
        entity = "entity://e/0" if rng.random() < 0.4 else f"entity://e/{rng.randrange(1, 8)}"
        obs.append((f"o{i:04d}", entity, f"P.{rng.randrange(2)}", str(rng.randrange(3)), f"s{rng.randrange(3)}", f"x{rng.randrange(4)}",
                    None if rng.random() < 0.5 else "r1", day(start), None if end is None else day(end), day(rng.randrange(0, 6) * 8)))
    for j in range(n // 4):
        ret.append((f"t{j:04d}", "observation", f"o{rng.randrange(n):04d}", day(rng.randrange(0, 60)), day(rng.randrange(0, 60))))
    rules = [("entity://e/1", "P.0", "provider", ["s1", "s2"]), ("entity://e/2", "P.1", "provider", ["s9"]), ("entity://e/0", "P.0", "freshest", None)]
    return obs, ret, rules


def plain_state(obs, ret, rules, valid, known):
    ruled = {(e, p): providers for e, p, kind, providers in rules if kind == "provider"}
    groups = {}
    for o in obs:
        ends = [r[3] for r in ret if r[2] == o[0] and r[4] <= known] + ([o[8]] if o[8] else [])
        end = min(ends, default=None)
        if o[7] <= valid and (end is None or valid < end) and o[9] <= known:
            groups.setdefault((o[1], o[2]), []).append(o)
    out = {}
    for key, rows in groups.items():
        if key in ruled:
            listed = [p for p in ruled[key] if any(o[4] == p for o in rows)]
            if not listed:
                continue
            rows = [o for o in rows if o[4] == listed[0]]
        top = max(o[9] for o in rows)
        rows = [o for o in rows if o[9] == top]
        if len({o[3] for o in rows}) > 1:
            out[key] = ("conflict", None, None, None, len(rows))
        else:
            first = min(rows, key=lambda o: (o[4], o[5]))
            out[key] = ("resolved", first[3], first[4], first[5], len(rows))
    return out


def frames(spark, obs, ret, rules):
    return spark.createDataFrame(obs, OBS), spark.createDataFrame(ret, RET), spark.createDataFrame(rules, RULES)


def answers(df):
    return {(r.entity_id, r.property): (r.status, r.value_json, r.provider, r.external_id, r.n_candidates) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_worlds(spark, seed):
    obs, ret, rules = world(seed)
    probes = [(10, 60), (25, 20), (39, 45)]
    o, t, r = frames(spark, obs, ret, rules)
    both = rs.resolve_state(o, t, r, [tp.Probe(f"{v}-{k}", text(v), text(k)) for v, k in probes])
    both = both.cache()
    for v, k in probes:
        assert answers(both.filter(F.col("probe_id") == f"{v}-{k}")) == plain_state(obs, ret, rules, day(v), day(k))


def test_input_order_does_not_matter(spark):
    obs, ret, rules = world(5, 120)
    probe = [tp.Probe("p", text(20), text(40))]
    first = answers(rs.resolve_state(*frames(spark, obs, ret, rules), probe))
    random.Random(9).shuffle(obs)
    random.Random(9).shuffle(ret)
    assert answers(rs.resolve_state(*frames(spark, obs, ret, rules), probe)) == first


def test_timeline_equals_probes(spark):
    obs, ret, rules = world(7, 150)
    o, t, r = frames(spark, obs, ret, rules)
    line = rs.state_timeline(o, t, r, text(45)).cache()
    for v in (0, 9, 17, 33, 50):
        at = F.lit(text(v)).cast("timestamp")
        seen = line.filter((F.col("start") <= at) & (F.col("until").isNull() | (at < F.col("until"))))
        assert answers(seen) == plain_state(obs, ret, rules, day(v), day(45))


def test_timeline_summaries_carry_no_names(spark, monkeypatch):
    """Blocks of all keys are numbered, so that neither names nor a key's hot rows are shuffled with them."""
    obs, ret, rules = world(3, 60)
    seen, per_provider = [], rs._per_provider
    monkeypatch.setattr(rs, "_per_provider", lambda df, keys: seen.append(set(df.columns)) or per_provider(df, keys))
    rs.state_timeline(*frames(spark, obs, ret, rules), text(45))
    assert seen and not seen[0] & {"entity_id", "property"}


def test_a_property_with_two_rules_counts_under_both(spark):
    base = ("entity://e/1", "P.0")
    obs = [("a", *base, "1", "s", "x", None, day(0), None, day(0)), ("b", *base, "2", "t", "x", None, day(3), None, day(1)), ("c", *base, "3", "u", "x", None, day(5), None, day(2))]
    twice = [(*base, "provider", ["s", "t"]), (*base, "provider", ["t", "s"])]
    o, t, r = frames(spark, obs, [("z", "observation", "zz", day(0), day(0))], twice)
    got = sorted((row.start.day, row.status, row.value_json, row.n_candidates) for row in rs.state_timeline(o, t, r, text(9)).collect())
    assert got == [(1, "resolved", "1", 1), (4, "resolved", "2", 1), (6, "resolved", "2", 1)]


def test_late_record_is_seen_only_by_later_knowledge(spark):
    base = ("entity://e/1", "P.0")
    obs = [("a", *base, "1", "s", "x", None, day(0), None, day(0)), ("b", *base, "2", "s", "x", None, day(0), None, day(30))]
    o, t, _ = frames(spark, obs, [("z", "observation", "zz", day(0), day(0))], [("e", "p", "freshest", None)])
    probes = [tp.Probe("before", text(5), text(29)), tp.Probe("after", text(5), text(30))]
    got = {r.probe_id: r.value_json for r in rs.resolve_state(o, t, None, probes).collect()}
    assert got == {"before": "1", "after": "2"}


def test_retraction_boundaries(spark):
    base = ("entity://e/1", "P.0", "1", "s")
    obs = [("a", *base, "x", None, day(0), day(10), day(0)), ("b", *base, "y", None, day(5), None, day(0)), ("c", *base, "z", None, day(0), None, day(0))]
    ret = [("voids", "observation", "b", day(1), day(0)), ("beyond", "observation", "a", day(12), day(0)), ("late", "observation", "c", day(3), day(9))]
    o, t, _ = frames(spark, obs, ret, [("e", "p", "freshest", None)])
    at = lambda v, k: {r.observation_id for r in tp.active(o, t, [tp.Probe("p", text(v), text(k))]).collect()}
    assert at(6, 6) == {"a", "c"} and at(6, 9) == {"a"} and at(10, 8) == {"c"} and at(0, 20) == {"a", "c"}
    applied = {r.retraction_id for r in tp.applied_retractions(o, t, [tp.Probe("p", text(6), text(9))]).collect()}
    assert applied == {"voids", "late"}
