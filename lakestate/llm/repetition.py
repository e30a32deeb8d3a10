"""Quality rules with a suffix array over each text's words.

The words of a batch of texts are numbered so that no two texts share a number;
one suffix array of the batch then holds those of all its texts, and no common
prefix crosses a text. It is built by prefix doubling, where each round sorts
only the suffixes that are still tied. The ranks of all rounds give the longest
common prefix (LCP) of neighbouring suffixes by halving.

A suffix's larger LCP with its two neighbours is the length of its longest
prefix that occurs elsewhere in the text. All maximal repeated substrings are
among these prefixes, and the others lie within them, so the union of their
spans is the union of the LCP intervals' spans. A text is rejected if repeats of
``min_repeat`` words or more cover too large a part of it, or if one is too long.

Null and empty texts have no words: all counts are zero and the base rule fails
them. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakestate.llm.common import per_batch, texts, utf8

# Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50

# The verdict's defaults: repeats count from so many words on; the share of words
# that they may cover, and the longest repeat as a share of the words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 0.3, 0.2
#: Words that are sorted together; a longer text is sorted alone.
TOGETHER = 300_000


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ.

    A rank is the place of the first suffix that is tied with it.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    place = np.arange(n)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    rounds = [rank]
    alone = new & np.concatenate([new[1:], [True]])
    tied = order[~alone]  # in order of rank
    step = 1
    while len(tied):
        rank = rounds[-1]
        behind = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0).astype(np.int64)
        key = rank[tied].astype(np.int64) << 32 | behind
        sort = np.argsort(key, kind="stable")
        tied, key = tied[sort], key[sort]
        group = key >> 32
        first_of_group = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(tied))
        inside = place - np.maximum.accumulate(np.where(first_of_group, place, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, place, 0))
        updated = rank.copy()
        updated[tied] = (group + inside[head]).astype(np.int32)
        rounds.append(updated)
        alone = new & np.concatenate([new[1:], [True]])
        tied = tied[~alone]
        step *= 2
    return rounds


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that occurs again."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    rounds = suffix_ranks(symbols)
    order = np.empty(n, dtype=np.int64)
    order[rounds[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        rank = rounds[level]
        same = np.flatnonzero((a < n) & (b < n))
        same = same[rank[a[same]] == rank[b[same]]]
        common[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    longest = np.zeros(n, dtype=np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered(lengths: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Which positions lie in the union of the spans of lengths ``least`` and more (all cut to ``span``)."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + (lengths[at] if span is None else span), -1)
    return np.cumsum(change[:n]) > 0


def _per_text(flags: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    until = np.concatenate([[0], np.cumsum(flags)])
    return until[ends] - until[ends - counts]


def _plain(text: bytes) -> tuple[int, int, int]:
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    blank = int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return points - blank, sum(text.count(bytes([c])) for c in SYMBOLS), again


def measure(batch: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text of a batch."""
    words = [text.split() for text in batch]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    repeated, spanned, longest = (np.zeros(len(batch), dtype=np.int64) for _ in range(3))
    begin = 0
    while begin < len(batch):
        end, size = begin + 1, counts[begin]
        while end < len(batch) and size + counts[end] <= TOGETHER:
            size += counts[end]
            end += 1
        if size:
            some = counts[begin:end]
            coded = pa.array([w for ws in words[begin:end] for w in ws], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            symbols = np.repeat(np.arange(end - begin, dtype=np.int64), some) << 32 | coded
            lengths = longest_repeats(symbols)
            ends = np.cumsum(some)
            repeated[begin:end] = _per_text(covered(lengths, WINDOW, WINDOW), ends, some)
            spanned[begin:end] = _per_text(covered(lengths, min_repeat), ends, some)
            full = np.flatnonzero(some)
            longest[begin + full] = np.maximum.reduceat(lengths, (ends - some)[full])
        begin = end
    plain = np.array([_plain(text) for text in batch], dtype=np.int64).reshape(-1, 3)
    return {
        "n_words": counts, "word_chars": plain[:, 0], "n_symbols": plain[:, 1], "n_dup_lines": plain[:, 2],
        "n_repeat_words": repeated, "n_covered_words": spanned, "longest_repeat": longest,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        found = measure(utf8(batch), min_repeat)
        n = found["n_words"]
        failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
        kept = ~failed & (found["n_covered_words"] <= max_covered * n) & (found["longest_repeat"] <= max_longest * n)
        return {"doc_id": batch.column(0)} | {c: pa.array(found[c]) for c in COUNTS} | {"base_failed": pa.array(failed), "kept": pa.array(kept)}

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return texts(docs).mapInArrow(per_batch(step), schema)
