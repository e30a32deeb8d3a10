"""Secrets by fixed patterns and by token efficiency.

Ordinary words, also foreign and rare ones, take few tokens of a byte-pair
vocabulary for their characters; a random string takes about one token for each
one or two. Long runs of the characters that keys are written in, with letters
in them, are secrets if they have few characters per token under a tiktoken
vocabulary. Left out are what is known to look random and is none: hex
digests of the usual lengths, UUIDs, dates and times, alphabets, and identifiers, which are
runs whose parts between separators are mostly words, by the same ratio. Where
the run as a whole is none, neighbouring parts that are no words, numbers or
known forms are weighed by themselves, so a path or a name before a key does not
hide it.

A batch is searched by Arrow's linear-time patterns first; only texts that can
hold a span are read in Python. Null texts count as empty; a text without spans
has empty ``spans`` and the digest of the empty string. Repeated rows repeat; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import per_batch, settle, texts

# The base patterns and the least lengths, kinds in their listed order.
KINDS = ("assign", "access", "hex", "random")
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(r"(" + _WORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

# What Arrow looks for first: whatever can hold a span of any kind.
_MAYBE = (r"(?i:" + "password|passwd|secret|token|api_?key" + r")", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}", r"[A-Za-z0-9+/_=-]{20}")

# The method's parameters: length of a run, and characters per token below which it is random.
MIN_RUN, MAX_RATIO = 20, 2.0
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
# Fixed value: the base-64 alphabet without case; a stretch of it is no key.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz0123456789+/"
_TIME = re.compile(r"\d{4}-?\d\d-?\d\d(?:[T_-]?\d\d-?\d\d-?\d\d)?(?:Z|[+-]\d+)?")
#: Between separators; UUIDs and times keep theirs.
_PART = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|{_TIME.pattern})(?![A-Za-z0-9])|[A-Za-z0-9]+")
MIN_WORD = 4


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests, UUIDs, times and alphabets."""
    if run.lower() in _ALPHABET:
        return True
    if _HEX_ONLY.fullmatch(run):
        return len(run) in DIGEST_LENGTHS
    return bool(_UUID.fullmatch(run) or _TIME.fullmatch(run))


def characters_per_token(run: str, path: str) -> float:
    """How many characters a token of the vocabulary holds on average."""
    return len(run) / len(vocabulary(path).encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds by their place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _is_random(run: str, path: str, max_ratio: float) -> bool:
    lettered = len(run) >= MIN_RUN and any(c.isalpha() for c in run)
    return lettered and not is_known(run) and characters_per_token(run, path) < max_ratio


def _random_parts(run: str, path: str, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or neighbouring parts that are nothing else."""
    words, stretches, opened = 0, [], False
    for m in _PART.finditer(run):
        part = m.group()
        word = len(part) >= MIN_WORD and not part.isdigit() and not is_known(part) and characters_per_token(part, path) >= max_ratio
        words += len(part) * word
        if word or part.isdigit() or is_known(part):
            opened = False
            continue
        stretches.append((stretches.pop()[0] if opened else m.start(), m.end()))
        opened = True
    if 3 * words < 2 * len(run) and _is_random(run, path, max_ratio):
        return [(0, len(run))]
    return [(a, b) for a, b in stretches if _is_random(run[a:b], path, max_ratio)]


def random_spans(text: str, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs, or parts of runs, with few characters per token."""
    found = []
    for m in _RUN.finditer(text):
        run = m.group().strip("=-_/+")
        if len(run) < MIN_RUN or not any(c.isalpha() for c in run) or is_known(run):
            continue
        start = m.start() + m.group().index(run)
        found += [(start + a, 3, start + b) for a, b in _random_parts(run, path, max_ratio)]
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def possible(column: pa.Array) -> np.ndarray:
    """Which texts can hold a span at all."""
    return np.logical_or.reduce([pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False).astype(bool) for p in _MAYBE])


def scan(docs: DataFrame, ranks: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row."""

    def step(batch: pa.RecordBatch) -> dict:
        column = batch.column(1)
        counts = np.zeros((batch.num_rows, len(KINDS)), dtype=np.int64)
        base, spans = [""] * batch.num_rows, [""] * batch.num_rows
        at = np.flatnonzero(possible(column))
        for i, text in zip(at.tolist(), column.take(pa.array(at)).to_pylist(), strict=True):
            found = base_spans(text)
            more = sorted(found + random_spans(text, ranks, max_ratio))
            for _, kind, _ in more:
                counts[i, kind] += 1
            base[i], spans[i] = spelled(found), spelled(more)
        return {"doc_id": batch.column(0)} | {f"n_{k}": pa.array(counts[:, j]) for j, k in enumerate(KINDS)} | {
            "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), "spans": pa.array(spans),
        }

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return texts(docs).mapInArrow(per_batch(step), schema)


MASK = "[secret]"


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by MASK."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, ranks: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with the secrets of their texts masked; null texts stay null, other columns as they are."""

    def hide(text: pa.Array) -> pa.Array:
        column = pc.fill_null(text, "")
        at = np.flatnonzero(possible(column))
        if not len(at):
            return text
        out = text.to_pylist()
        for i in at.tolist():
            if spans := sorted(base_spans(out[i]) + random_spans(out[i], ranks, max_ratio)):
                out[i] = masked(out[i], spans)
        return pa.array(out, pa.string())

    settle(docs.sparkSession)
    return docs.withColumn("text", F.arrow_udf(hide, "string")(F.col("text")))
