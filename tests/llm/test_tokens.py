"""Automaton, grammar files and packing against the tokenizers library and exact round trips."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_rows import LONG, ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakestate.llm import automaton, grammar, packing, units
from lakestate.session import run_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


@pytest.mark.parametrize("encoder", [lambda: units.library_encoder(PATH), lambda: automaton.codec(PATH)])
def test_encoders_agree_with_the_library(encoder, sample):
    texts = [t for _, t in ODD] + [r.text for r in sample.collect()]
    ids, counts = encoder().encode(pa.array(texts, pa.string()))
    assert split(ids, counts) == [expected(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab e\t\n 　's'9!<|é日\x01\x1c\u0085"), max_size=30), min_size=1, max_size=5))
def test_cuts_are_safe(texts):
    for encoder in (units.library_encoder(PATH), automaton.codec(PATH)):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        assert split(ids, counts) == [expected(t) for t in texts]


def test_gadgets_on_a_small_vocabulary():
    """All words over two letters, against merging step by step."""
    merges = [(0, 0, 2), (2, 1, 3), (1, 0, 4), (2, 2, 5), (4, 1, 6), (3, 3, 7), (0, 1, 8)]
    labels = {0: b"a", 1: b"b"}
    for u, v, w in merges:
        labels[w] = labels[u] + labels[v]
    own = automaton.Automaton([0, 1], merges, labels)

    def merged(word):
        tokens = [0 if c == "a" else 1 for c in word]
        for u, v, w in merges:
            out, i = [], 0
            while i < len(tokens):
                if tokens[i : i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    words = ["".join("ab"[n >> i & 1] for i in range(size)) for size in range(1, 11) for n in range(1 << size)]
    tokens, counts = own.encode_words([w.encode() for w in words])
    assert split(tokens, counts) == [merged(w) for w in words]
    assert all(own.walk(w.encode()) == merged(w) for w in words[::7])


def test_forgetting_changes_nothing():
    small = units.UnitEncoder(units.library_units(PATH), remembered=10)
    for text in ("a first text of some words", "a second text of other words", LONG[:3000]):
        ids, _ = small.encode(pa.array([text]))
        assert ids.tolist() == expected(text)


def test_encode_and_decode(odd, none):
    found = automaton.encode_and_decode(odd, PATH).collect()
    want = Counter((d, len(expected(t)), hashlib.sha256(",".join(map(str, expected(t))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ODD)
    assert Counter(map(tuple, found)) == want
    assert automaton.encode_and_decode(none, PATH).count() == 0


@pytest.mark.parametrize("ids", [
    [], [5], [7] * 1000, list(range(3000)) * 2, [1, 2, 1, 2, 3] * 400 + [9, 9, 9] * 301, np.random.default_rng(0).integers(0, 40, 20_000).tolist(),
])
def test_grammars_round_trip(ids):
    own = grammar.compress(np.array(ids, dtype=np.uint32))
    again = grammar.unpacked(grammar._packed(own, len(ids)))
    assert again.expand(again.symbols).tolist() == ids and int(again.symbol_lengths().sum()) == len(ids)
    rng = random.Random(len(ids))
    for _ in range(20):
        a, b = sorted((rng.randrange(len(ids) + 1), rng.randrange(len(ids) + 1)))
        assert grammar.decode_range(again, a, b).tolist() == ids[a:b]


def test_grammars_get_smaller():
    own = grammar.compress(np.array([1, 2, 3, 4] * 5000, dtype=np.uint32))
    assert len(own.symbols) < 2000 and own.lengths.max() >= 16
    with pytest.raises(ValueError):
        grammar.compress(np.array([grammar.FIRST_RULE], dtype=np.uint32))


@pytest.mark.parametrize("block", [1 << 18, 500])
def test_files_hold_all_ids_in_order(spark, sample, block):
    path = run_dir(spark, "tokens-test")
    grammar.write_tokens(sample, PATH, path, end_id=2, partitions=3, block_ids=block)
    found = sorted(grammar.read_tokens(spark, path).collect())
    start = 0
    for r, row in zip(found, sorted(sample.collect()), strict=True):
        ids = np.array(expected(row.text) + [2], dtype="<u4")
        assert tuple(r) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_odd_rows(spark, odd, none):
    path = run_dir(spark, "tokens-odd")
    grammar.write_tokens(odd, PATH, path, partitions=3, block_ids=1000)
    found = grammar.read_tokens(spark, path).collect()
    want = Counter((d, len(expected(t)) + 1) for d, t in ODD)
    assert Counter((r.doc_id, r.n_tokens) for r in found) == want
    spans = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id) for r in found)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert [s[2:] for s in spans] == sorted((s[2:] for s in spans), key=lambda s: (s[0], s[1] or 0))
    empty = run_dir(spark, "tokens-none")
    grammar.write_tokens(none, PATH, empty)
    assert grammar.read_tokens(spark, empty).count() == 0


def slow_pack(lengths, capacity, limit):
    """The same rule with a list of bins: tightest fit, and the fullest closes first."""
    bins, number, out = [], 0, []
    for n in lengths:
        fits = [b for b in bins if capacity - b[1] >= n]
        if fits:
            chosen = max(fits, key=lambda b: b[1])
        else:
            if len(bins) == limit:
                bins.remove(max(bins, key=lambda b: b[1]))
            chosen = [number, 0]
            number += 1
            bins.append(chosen)
        out.append(capacity - chosen[1])
        chosen[1] += n
        if chosen[1] == capacity:
            bins.remove(chosen)
    return out, number


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_best_fit_rule(limit):
    rng = random.Random(limit)
    lengths = [rng.choice([rng.randrange(1, 101), 100, 50, 1]) for _ in range(800)]
    own = packing.OpenBins(100, limit)
    found = [own.place(n) for n in lengths]
    free, bins = slow_pack(lengths, 100, limit)
    assert [100 - o for _, o in found] == free and own.bins == bins


@given(st.integers(1, 50_000))
def test_only_the_first_piece_is_short(total):
    parts = packing.piece_lengths(total, 2048)
    assert sum(parts) == total and len(parts) == max(1, math.ceil(total / 2048)) and set(parts[1:]) <= {2048} and 0 < parts[0] <= 2048


@pytest.mark.parametrize("task", [250_000, 20])
def test_packing_of_odd_rows(odd, none, task):
    found = packing.pack(odd, PATH, capacity=64, end_id=0, open_bins=4, task_pieces=task).collect()
    want = Counter()
    for d, t in ODD:
        ids, start = np.array(expected(t) + [0], dtype="<u4"), 0
        for piece, n in enumerate(packing.piece_lengths(len(ids), 64)):
            want[d, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    assert Counter(tuple(r)[:5] for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ezÉß.,;!?#%*<|\n\t '’s9日\x01"), max_size=30), min_size=1, max_size=5))
def test_words_beside_signs_are_cut_safely(texts):
    ids, counts = units.library_encoder(PATH).encode(pa.array(texts, pa.string()))
    assert split(ids, counts) == [expected(t) for t in texts]


def test_a_word_is_encoded_once_whatever_follows(monkeypatch):
    seen = []
    plain = units.library_units(PATH)
    monkeypatch.setattr(units, "library_units", lambda path: lambda words: seen.extend(words) or plain(words))
    text = "One wordly, wordly. wordly wordly;\nwordly: wordly$$$ wordly!\nAnd wordly"
    ids, _ = units.UnitEncoder(units.word_units(PATH)).encode(pa.array([text]))
    assert ids.tolist() == expected(text)
    assert sum("wordly" in word for word in seen) == 2  # with and without the space
