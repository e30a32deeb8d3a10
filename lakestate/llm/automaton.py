"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens as arc labels and accepts exactly the sequences that
the merges produce. It starts as one state with an arc for each byte back to
itself. The merges are compiled in one after the other, each by a gadget: for
(u, v) -> w, the state q that u's arcs lead to is copied without its arc v, u's
arcs are led to the copy, and every state that has an arc u gets an arc w to
where v led from q. So u is no longer followed by v, and w takes their place.

All arcs with one label lead to one state, so a state is told by a token, and a
gadget adds one state. States are kept as histories (which state was copied,
which label was taken away, at which merge) instead of rows of 50,000 arcs.
``Arcs`` answers whether a state has an arc from the histories, and fills a
transition table with the answers, so that frequent arcs cost one look-up.

Encoding walks a word from left to right through the trie of the tokens, also a
table: as every prefix of a word has one tokenization, every position of the
word has one state, and exactly one of the arcs that end at a position leaves
the state of its start. The arcs are then read backwards from the word's end.
All distinct words of a batch take their steps together. Decoding emits the
labels' bytes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakestate.llm.common import per_batch, spread, texts
from lakestate.llm.units import UnitEncoder, byte_alphabet, read_model

#: Words longer than this are walked alone, so that they do not hold up the others.
LONG_WORD = 128
LATEST = np.int64(1 << 40)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Table:
    """A fixed map from 32-bit keys to small numbers; keys that collide go to a further table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, salt: int = 0x9E3779B1):
        bits = max(4, int(len(keys) * 8).bit_length())
        self.salt, self.shift = np.uint32(salt), np.uint32(32 - bits)
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        self.more = np.zeros(1 << bits, dtype=bool)
        slots = self._slots(keys.astype(np.uint32))
        _, first = np.unique(slots, return_index=True)
        self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.more[slots[rest]] = True
        self.next = Table(keys[rest], values[rest], (salt * 2654435761 + 2) % (1 << 32) | 1) if len(rest) else None

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.salt) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none; keys are uint32."""
        slots = self._slots(keys)
        hit = self.keys[slots] == keys
        out = np.where(hit, self.values[slots], np.int32(-1))
        if self.next is not None:
            rest = np.flatnonzero(~hit & self.more[slots])
            if len(rest):
                out[rest] = self.next.get(keys[rest])
        return out


def _pair(a, b):
    return (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)


class Automaton:
    """States and arcs of a byte-level BPE, compiled from its merges in order."""

    def __init__(self, byte_tokens: list[int], merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        """``byte_tokens`` by byte; ``merges`` as (u, v, w), first the earliest; ``labels`` by token."""
        size = max([*byte_tokens, *(w for _, _, w in merges)]) + 1
        if size > 1 << 16:
            raise ValueError("tokens have to fit in 16 bits")
        self.labels = [labels.get(t, b"") for t in range(size)]
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.made = np.zeros(size, dtype=np.int64)  # the merge that made the token's arcs; bytes: 0
        self.state_of = np.zeros(size, dtype=np.int64)  # where the token's arcs lead
        self.copied, self.removed, self.born = [-1], [-1], [0]  # of each state
        self.gadget: dict[tuple[int, int], int] = {}  # merges that took effect
        for step, (u, v, w) in enumerate(merges, 1):
            if not self.has_arc(u, v):
                continue  # v never follows u by now
            self.copied.append(int(self.state_of[u]))
            self.removed.append(v)
            self.born.append(step)
            target = self.state_of[v]
            self.state_of[u] = len(self.born) - 1
            self.state_of[w] = target
            self.left[w], self.right[w], self.made[w] = u, v, step
            self.gadget[u, v] = step
        self.longest = max(len(self.labels[t]) for t in [*byte_tokens, *(w for (_, _, w) in merges)])
        used = np.array([*byte_tokens, *[w for _, _, w in merges if self.made[w]]], dtype=np.int64)
        self._compile_tables(used)

    def has_arc(self, a: int, t: int) -> bool:
        """Whether the state behind token a has an arc t: no gadget that it inherits has taken
        away t, or a label from which t's arc was made later on."""
        until = LATEST
        while a >= 0:
            label, before = t, LATEST
            while label >= 0:
                step = self.gadget.get((a, label))
                if step is not None and step < until and step <= before:
                    return False
                before, label = self.made[label], self.left[label]
            until, a = self.made[a], self.right[a]
        return True

    def _compile_tables(self, used: np.ndarray) -> None:
        nodes: dict[int, int] = {}
        tokens = [-1]
        for t in used.tolist():
            node = 0
            for byte in self.labels[t]:
                key = node << 8 | byte
                found = nodes.get(key)
                if found is None:
                    found = nodes[key] = len(tokens)
                    tokens.append(-1)
                node = found
            tokens[node] = t
        self.trie = nodes
        self.token_at = np.array(tokens, dtype=np.int64)
        self.child = Table(np.fromiter(nodes.keys(), np.uint32, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        pairs = np.array(list(self.gadget), dtype=np.int64).reshape(-1, 2)
        self.merge_step = Table(_pair(pairs[:, 0], pairs[:, 1]), np.fromiter(self.gadget.values(), np.int32, len(pairs)))
        self.width = np.array([len(x) for x in self.labels], dtype=np.int64)
        self.transitions = np.full(1 << 20, _EMPTY, dtype=np.uint64)  # arc, its answer in the lowest bit
        self.known_arcs: dict[tuple[int, int], bool] = {}

    def arcs(self, a: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``has_arc`` of many, from the transition table where it has the answer."""
        key = _pair(a, t)
        slot = (key * np.uint32(2654435769)) >> np.uint32(12)
        entry = self.transitions[slot]
        answer = (entry & np.uint64(1)).astype(bool)
        new = np.flatnonzero((entry >> np.uint64(1)) != key)
        if len(new):
            found = self._histories(a[new], t[new])
            answer[new] = found
            self.transitions[slot[new]] = key[new].astype(np.uint64) << np.uint64(1) | found
        return answer

    def _histories(self, a: np.ndarray, t: np.ndarray) -> np.ndarray:
        has = np.ones(len(a), dtype=bool)
        rows, until = np.arange(len(a)), np.full(len(a), LATEST)
        state = a.astype(np.int64)
        while len(rows):
            at, label, before = np.arange(len(rows)), t[rows].astype(np.int64), np.full(len(rows), LATEST)
            while len(at):
                step = self.merge_step.get(_pair(state[at], label)).astype(np.int64)
                has[rows[at[(step >= 0) & (step < until[at]) & (step <= before)]]] = False
                before, label = self.made[label], self.left[label]
                go = (label >= 0) & has[rows[at]]
                at, label, before = at[go], label[go], before[go]
            until, state = self.made[state], self.right[state]
            go = (state >= 0) & has[rows]
            rows, state, until = rows[go], state[go], until[go]
        return has

    def walk(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        last = [-1] * (len(word) + 1)
        for start in range(len(word)):
            node, a = 0, last[start]
            for end in range(start + 1, min(len(word), start + self.longest) + 1):
                node = self.trie.get(node << 8 | word[end - 1], 0)
                if not node:
                    break
                t = int(self.token_at[node])
                if t >= 0:
                    if a < 0:
                        last[end] = t
                        continue
                    known = self.known_arcs.get((a, t))
                    if known is None:
                        if len(self.known_arcs) > 1_000_000:
                            self.known_arcs.clear()
                        known = self.known_arcs[a, t] = self.has_arc(a, t)
                    if known:
                        last[end] = t
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and the number of each word's."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        counts = np.zeros(len(words), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (8, 16, 32, 64, LONG_WORD):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for begin in range(0, len(chosen), 65_536):
                some = chosen[begin : begin + 65_536]
                tokens, number = self._together([words[i] for i in some], sizes[some])
                counts[some] = number
                parts.append((some, tokens))
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            tokens = np.array(self.walk(words[i]), dtype=np.uint32)
            counts[i] = len(tokens)
            parts.append((np.array([i]), tokens))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        for some, tokens in parts:
            out[spread(counts[some], starts[some])] = tokens
        return out, counts

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-sizes, kind="stable")
        size, longest = sizes[order], int(sizes.max())
        letters = np.zeros((len(words), longest), dtype=np.uint32)
        letters[np.repeat(np.arange(len(words)), size), spread(size, np.zeros(len(words), np.int64))] = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        reach = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # words of at least so many bytes
        last = np.full((len(words), longest + 1), -1, dtype=np.int32)
        for start in range(longest):
            rows = np.arange(reach[start + 1])
            node = np.zeros(len(rows), dtype=np.uint32)
            for end in range(start + 1, min(longest, start + self.longest) + 1):
                inside = int(np.searchsorted(rows, reach[end]))
                rows, node = rows[:inside], node[:inside]
                step = self.child.get(node << np.uint32(8) | letters[rows, end - 1])
                alive = step >= 0
                rows, node = rows[alive], step[alive].astype(np.uint32)
                if not len(rows):
                    break
                token = self.token_at[node]
                ends = token >= 0
                r, t = rows[ends], token[ends]
                if start:
                    ok = self.arcs(last[r, start], t)
                    r, t = r[ok], t[ok]
                last[r, end] = t
        found = np.full((len(words), longest), -1, dtype=np.int32)
        rows, at, column = np.arange(len(words)), size.copy(), longest - 1
        while len(rows):
            token = last[rows, at]
            found[rows, column] = token
            at = at - self.width[token]
            rows, at, column = rows[at > 0], at[at > 0], column - 1
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        found = found[back]
        filled = found >= 0
        return found[filled].astype(np.uint32), filled.sum(axis=1)


class Codec:
    """Encodes texts with a byte-level BPE file by its automaton, and decodes ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        model = read_model(path)
        vocabulary: dict[str, int] = model["model"]["vocab"]
        alphabet = byte_alphabet()
        spelled = {at: bytes(alphabet[c] for c in token) for token, at in vocabulary.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
        self.automaton = Automaton([vocabulary[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], merges, spelled)
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*spelled, *self.added.values()]) + 1
        names = {at: token.encode() for token, at in self.added.items()}
        self.labels = [names.get(i, spelled.get(i, b"")) for i in range(size)]
        self.label_bytes, self.label_starts, self.label_sizes = _arena(self.labels)
        self.decimal_bytes, self.decimal_starts, self.decimal_sizes = _arena([b"%d," % i for i in range(size)])
        self.units = UnitEncoder(self._encode_units)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Splits units into words, encodes the distinct words, and joins their tokens by unit."""
        number: dict[str, int] = {}
        words: list[int] = []
        per_unit = np.empty(len(units), dtype=np.int64)
        for i, unit in enumerate(units):
            pieces = self.special.split(unit) if self.special and "<" in unit else (unit,)
            before = len(words)
            for k, piece in enumerate(pieces):
                if k % 2:
                    words.append(-1 - self.added[piece])
                else:
                    words.extend([number.setdefault(w, len(number)) for w in self.split.findall(piece)])
            per_unit[i] = len(words) - before
        tokens, counts = self.automaton.encode_words([w.encode() for w in number])
        extra = np.array(sorted(self.added.values()), dtype=np.int64)
        starts = np.concatenate([np.cumsum(counts) - counts, len(tokens) + np.arange(len(extra))])
        tokens, counts = np.concatenate([tokens, extra.astype(np.uint32)]), np.concatenate([counts, np.ones(len(extra), np.int64)])
        at = np.array(words, dtype=np.int64)
        if len(extra):
            at = np.where(at < 0, len(number) + np.searchsorted(extra, -1 - at), at)
        ids = tokens[spread(counts[at], starts[at])]
        until = np.concatenate([[0], np.cumsum(counts[at])])
        ends = np.cumsum(per_unit)
        return ids, until[ends] - until[ends - per_unit]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their numbers."""
        return self.units.encode(column)

    def spell(self, ids: np.ndarray, counts: np.ndarray, decimal: bool = False) -> list[bytes]:
        """The labels of each text's ids joined, or the ids themselves, comma-separated."""
        raw, starts, sizes = (self.decimal_bytes, self.decimal_starts, self.decimal_sizes) if decimal else (self.label_bytes, self.label_starts, self.label_sizes)
        width = sizes[ids]
        flat = raw[spread(width, starts[ids])].tobytes()
        until = np.concatenate([[0], np.cumsum(width)])
        stops = until[np.cumsum(counts)]
        begins = until[np.cumsum(counts) - counts]
        return [flat[b : e - 1] if decimal and e > b else flat[b:e] for b, e in zip(begins.tolist(), stops.tolist(), strict=True)]


def _arena(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec for a tokenizer file."""
    return Codec(path)


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null texts count as empty: no ids, and the digests of nothing. Repeated
    rows repeat. Words of any length are walked; an empty table gives no rows.
    """

    def step(batch: pa.RecordBatch) -> dict:
        own = codec(tokenizer)
        ids, counts = own.encode(batch.column(1))
        decoded = [raw.decode("utf-8", "replace").encode() for raw in own.spell(ids, counts)]
        sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts])
        return {"doc_id": batch.column(0), "n_tokens": pa.array(counts), "ids_sha256": sha(own.spell(ids, counts, decimal=True)), "decoded_sha256": sha(decoded)}

    return texts(docs).mapInArrow(per_batch(step), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
