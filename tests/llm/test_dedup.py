"""SimHash, chunks and weighted sampling against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd_rows import LONG, ODD, frame

from lakestate.llm import chunking, near_copies, parity_join, simhash, weighted


def slow_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= distance:
            root[find(b)] = find(a)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def linked(spark, values, **options):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), **options).collect()
    mask = (1 << 64) - 1
    assert all(((r.u ^ r.v) & mask).bit_count() <= options.get("distance", 2) for r in found)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in found:
        root[find(r.u & mask)] = find(r.v & mask)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("limit", [64, 3])
def test_links_connect_whatever_is_close(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(25)}
    values |= {centres[0] ^ 1 << 40 ^ x for x in range(200)}  # one table entry for all of them
    values = sorted(values)
    assert linked(spark, values, bucket_limit=limit) == slow_components(values, 2)


def test_entries_and_asked_values(spark):
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    for distance, count in ((2, 2), (8, 4), (5, 3)):
        plan = simhash._segments(distance, count)
        mask = (1 << 64) - 1
        table = {(r.segment, r.value, r.fp & mask) for r in simhash._keys(fps, plan, False).collect()}
        assert table == {(n, (v >> bits.start) & ((1 << len(bits)) - 1), v) for n, bits, _ in plan for v in values}
        asked = {(r.segment, r.value, r.fp & mask) for r in simhash._keys(fps, plan, True).collect()}
        for n, bits, radius in plan:
            width = (1 << len(bits)) - 1
            for v in values[:5] + values[-2:]:
                own = (v >> bits.start) & width
                near = [own ^ sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(range(len(bits)), r)]
                assert {x for s, x, f in asked if (s, f) == (n, v)} == {x for x in near if x >= own}


def test_links_of_other_distances(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(8)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centres for _ in range(12)})
    assert linked(spark, values, distance=8, segments=4, dense=False) == slow_components(values, 8)
    assert linked(spark, values, distance=4, segments=3, bucket_limit=2) == slow_components(values, 4)
    assert linked(spark, values, distance=0, segments=2) == slow_components(values, 0)


def test_near_duplicates_of_odd_rows(odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    texts = {}
    for d, t in ODD:
        texts.setdefault(d, set()).add(f"{slow_fingerprint(t, 3):016x}")
    assert all(r.fingerprint in texts[r.doc_id] for r in found)
    component = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    zero = "0" * 16
    assert {component[1, zero], component[2, zero], component[3, zero], component[None, zero]} == {1}
    assert {c for (d, _), c in component.items() if d in (6, 7)} == {6} and {c for (d, _), c in component.items() if d in (10, 11)} == {10}


def test_a_long_text_is_read_in_blocks():
    assert simhash.fingerprint(LONG.encode()) == slow_fingerprint(LONG, 3)
    blocks = [w for b in simhash.word_blocks(b"aa bb  cc\tdddd e", 3) for w in b]
    assert blocks == [b"aa", b"bb", b"cc", b"dddd", b"e"]


def test_one_of_each(spark, odd, none):
    kept = near_copies.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and ids[7] == 0 and ids[10] == 1 and ids[11] == 0 and ids[1] == 1 and ids[2] == 0
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    rows = [(20, " ".join(words)), (21, " ".join(near)), (22, " ".join(reversed(words)))]
    assert sorted(r.doc_id for r in near_copies.one_of_each(frame(spark, rows)).collect()) == [20, 22]
    assert near_copies.one_of_each(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def similarity(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_each_by_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(100_000)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (2, 4, 5, 6, 8):  # similarities on both sides of 0.8
            near = list(words)
            for i in rng.sample(range(200), edits):
                near[i] = f"x{rng.randrange(100_000)}"
            rows.append((len(rows), " ".join(near)))
    copied = [f"v{i}" for i in range(150)]  # a group of near copies
    for i in range(60):
        rows.append((len(rows), " ".join([*copied[:i], f"y{i}", *copied[i + 1 :]])))
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    near = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if s[:1] + t[:1] != "wv" and similarity(s, t) >= 0.8]
    for a, b in near:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {d for d, _ in rows if find(d) != d}
    gone = {d for d, _ in rows} - {r.doc_id for r in near_copies.one_of_each(frame(spark, rows)).collect()}
    assert gone <= want and len(gone) >= 0.95 * len(want)


def test_fingerprints_meet_at_four_fifths():
    rng = np.random.default_rng(3)
    met = near = 0
    for _ in range(500):
        shared, a, b = np.split(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), [800, 900])
        sides = [near_copies.fingerprint(np.concatenate([shared, own])) for own in (a, b)]
        near += (int.from_bytes(sides[0]) ^ int.from_bytes(sides[1])).bit_count() <= near_copies.DISTANCE
        one, two = (near_copies.balls(np.frombuffer(x, np.uint8).reshape(1, -1))[0] for x in sides)
        met += bool(set(one.tolist()) & set(two.tolist()))
    assert met >= 420 and near >= 485  # by calculation 441 and 495


def test_balls_meet_within_two_bits_of_a_segment():
    rng = random.Random(6)
    for _ in range(200):
        own = bytearray(rng.randbytes(near_copies.BITS // 8))
        other = bytearray(x ^ 0xFF for x in own)
        bits = list(range(near_copies.WIDTH))
        apart = rng.randrange(4)
        for bit in bits:
            other[bit >> 3] ^= 1 << (bit & 7)
        for bit in rng.sample(bits, apart):
            other[bit >> 3] ^= 1 << (bit & 7)
        one, two = (near_copies.balls(np.frombuffer(bytes(x), np.uint8).reshape(1, -1))[0] for x in (own, other))
        assert bool(set(one.tolist()) & set(two.tolist())) == (apart <= 2)


def slow_join(rows):
    """n_shingles and component of every row, by all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def joined(docs):
    found = parity_join.similarity_join(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(tuple(r) for r in found.collect())


def test_parity_join_of_odd_rows(odd, none):
    assert joined(odd) == slow_join(ODD)
    assert not joined(none)


def test_parity_join_by_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for size in (5, 7, 8, 9, 10, 14, 20, 33, 60, 150, 400):
        base = [f"w{rng.randrange(50_000)}" for _ in range(size)]
        rows.append((rng.randrange(10_000), " ".join(base)))
        for _ in range(14):  # at, above and below the similarity
            near = list(base)
            for i in rng.sample(range(size), rng.randrange(1 + size // 30 + 1)):
                near[i] = f"x{rng.randrange(50_000)}"
            rows.append((rng.randrange(10_000) if rng.random() < 0.9 else None, " ".join(near[rng.randrange(2) : size - rng.randrange(1 + size // 12)])))
    passage = " ".join(f"p{i}" for i in range(30))  # in texts that are not alike
    rows += [(20_000 + i, passage + " " + " ".join(f"q{rng.randrange(99_999)}" for _ in range(10 + i))) for i in range(40)]
    assert joined(frame(spark, rows)) == slow_join(rows)


def test_parity_bounds():
    for a in range(1, 300):
        for b in range(a, a * 100 // 85 + 1):
            assert parity_join.band_of(b) - parity_join.band_of(a) in (0, 1)
            shared = -(-85 * (a + b) // 185)
            assert a + b - 2 * shared <= parity_join.most_differing(a, b) < parity_join.segments_of(parity_join.band_of(a))[0]
    rng = np.random.default_rng(5)
    for n in (6, 7, 12, 40, 300):
        for _ in range(30):
            one = np.unique(rng.integers(0, 1 << 62, n).astype("<u8"))
            two = np.unique(np.concatenate([one[: n - int(n * 0.08)], rng.integers(0, 1 << 62, int(n * 0.08)).astype("<u8")]))
            both = len(np.intersect1d(one, two))
            if 100 * both >= 85 * (len(one) + len(two) - both):
                assert set(parity_join.listed(one).tolist()) & set(parity_join.listed(two).tolist())
                apart = int.from_bytes(parity_join.sketch(one)) ^ int.from_bytes(parity_join.sketch(two))
                assert len(parity_join.sketch(one)) != len(parity_join.sketch(two)) or apart.bit_count() <= len(one) + len(two) - 2 * both


def test_rows_without_an_id_of_their_own_stay(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(2)), (3, text(4)), (None, None), (None, "")]
    kept = Counter((r.doc_id, r.text or "") for r in near_copies.one_of_each(frame(spark, rows)).collect())
    assert kept == Counter([(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (3, text(4)), (None, "")])


def test_a_passage_is_removed_wherever_it_moved(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(20, 90))] + passage * (i < 8) + [word() for _ in range(50)])) for i in range(12)]
    found = {r.doc_id: r for r in chunking.dedup(frame(spark, rows)).collect()}
    assert found[0].n_runs == 0 and all(found[i].n_runs >= 1 and 0 in found[i].first_doc_ids for i in range(1, 8))
    assert all(" ".join(passage) not in found[i].text and found[i].n_removed_words >= 30 for i in range(1, 8))
    assert all(found[i].text == dict(rows)[i] and not found[i].removed for i in range(8, 12))
    staged = {r.doc_id: r.text for r in chunking.without_repeats(frame(spark, rows)).collect()}
    assert staged == {i: r.text for i, r in found.items()}


def slow_dedup(rows):
    """Duplicate chunks by a dictionary over all texts; documents in the order of id (null last) and text hash."""
    place = lambda d, t: ((1 << 63) - 1 if d is None else d, xxhash.xxh64_intdigest((t or "").encode(), 42) & ((1 << 61) - 1))
    first = {}
    for d, t in rows:
        for c in chunking.chunks_of((t or "").encode()):
            first[c[0]] = min(first.get(c[0], place(d, t)), place(d, t))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        seen, spans = set(), []
        for c in chunking.chunks_of(raw):
            if c[0] in seen or first[c[0]] < place(d, t):
                spans.append({"first_word": c[1], "words": c[2], "first_owner": first[c[0]]})
            seen.add(c[0])
        out.append((d, chunking.cut_out(raw, chunking.runs(spans, chunking.MIN_RUN))[0].decode()))
    return Counter(out)


def test_texts_that_share_an_id_or_have_none_lose_what_they_share(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(80)
    texts = [passage] + [f"{passage} {words(30)}" for _ in range(40)]
    for ids in ([None] * len(texts), [5] * len(texts), [None if i % 2 else i // 4 for i in range(len(texts))], [-(1 << 62)] * len(texts)):
        rows = list(zip(ids, texts, strict=True))
        found = chunking.dedup(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.text) for r in found) == slow_dedup(rows)
        assert sum(r.n_removed_words >= 60 for r in found) == len(texts) - 1
        assert all(set(r.first_doc_ids) <= set(ids) - {None} for r in found)
    same = chunking.dedup(frame(spark, [(None, passage), (None, passage), (4, passage)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed_words > 60) for r in same) == [(0, True), (0, True), (4, False)]


def test_chunks_by_brute_force(odd, sample, none):
    assert Counter((r.doc_id, r.text) for r in chunking.dedup(odd).collect()) == slow_dedup(ODD)
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert Counter((r.doc_id, r.text) for r in chunking.dedup(sample).collect()) == slow_dedup(rows)
    assert chunking.dedup(none).count() == 0 and chunking.without_repeats(none).columns == none.columns
    assert chunking.without_repeats(odd).columns == odd.columns and chunking.without_repeats(odd).count() == len(ODD)


def test_chunk_ends_follow_the_content():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    whole = {c[0] for c in chunking.chunks_of(" ".join(words).encode())}
    moved = {c[0] for c in chunking.chunks_of(" ".join(["new"] + words).encode())}
    assert len(whole & moved) >= len(whole) - 3
    assert all(chunking.MIN_WORDS <= c[2] <= chunking.MAX_WORDS for c in chunking.chunks_of(" ".join(words).encode())[:-1])


def slow_rolling(raw):
    out, h = [], 0
    for b in raw:
        h = ((h << 1) + int(chunking.gears()[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_by_doubling():
    raw = np.frombuffer(bytes(range(256)) + b"some text" * 9, np.uint8)
    assert chunking.rolling(raw).tolist() == slow_rolling(raw.tolist())


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def test_weighted_sampling_estimates_jaccard():
    rng = random.Random(1)
    pairs = []
    for _ in range(60):
        a = [f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(150)]
        b = a[: rng.randrange(150)]
        pairs.append((" ".join(a), " ".join(b + [f"v{rng.randrange(40)}" for _ in range(150 - len(b))])))
    a = weighted.signatures([x.encode() for x, _ in pairs], 512)
    b = weighted.signatures([y.encode() for _, y in pairs], 512)
    wrong = weighted.likeness(a, b) - np.array([jaccard(x, y) for x, y in pairs])
    assert abs(wrong.mean()) < 0.02 and np.abs(wrong).max() < 0.12


def slow_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        out[d] = hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_edited_texts_cross_ranges(sample, partitions):
    rows = [(r.doc_id, r.text or "") for r in sample.collect()]
    found = weighted.fingerprints(sample, partitions=partitions).collect()
    assert {r.doc_id: r.edited_sha256 for r in found} == slow_edited(rows) and len(found) == len(rows)


def test_fingerprints_of_odd_rows(spark, odd, none):
    found = weighted.fingerprints(odd, partitions=4).collect()
    assert len(found) == len(ODD)
    same = {}
    for r in found:
        same.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert same[10] == same[11] and same[1] == same[2] == same[3] and same[6] == same[7]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 4 * weighted.SAMPLES for r in found)
    assert weighted.fingerprints(none).count() == 0
    (alone,) = weighted.fingerprints(frame(spark, [(3, "abc def ghi")])).collect()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()
