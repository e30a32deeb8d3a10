"""Encoding whole texts through the distinct units they are made of.

A byte-level BPE pre-tokenizer whose pattern lets a blank only lead a word
never joins a non-blank with the blank after it. A text may hence be cut before
any space that follows a non-blank, and the ids of the parts, one after the
other, are those of the whole. Natural text has far fewer distinct parts than
parts, so each distinct one is encoded once per worker.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakestate.llm.common import spread

#: Distinct units a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Bytes of joined units, about, that go to the tokenizer as one text. Its cost a byte grows with longer ones.
JOINED = 2_000
_MARK = "\x01"
# White space as Unicode has it, and the four separators Python counts besides, before a space.
_BLANK_THEN_SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S)(?= )")
# Letters every version of Unicode has, and signs that no token shares with them; a line break alone after one of either.
_LETTER, _SIGN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r".,;:!?&#$%*"
_WORD_THEN_SIGN, _LINE_THEN_WORD = rf"([{_LETTER}])([{_SIGN}\n])", rf"([{_LETTER}{_SIGN}])\n([{_LETTER}])"


class UnitEncoder:
    """Ids of texts, by a function that encodes a list of distinct units."""

    def __init__(self, encode_units: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode_units = encode_units
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.arena = np.empty(1 << 16, dtype=np.uint32)
        self.filled = 0
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)

    def _learn(self, units: list[str]) -> None:
        ids, lengths = self.encode_units(units)
        while self.filled + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.empty_like(self.arena)])
        self.arena[self.filled : self.filled + len(ids)] = ids
        self.known.update(zip(units, range(len(self.starts), len(self.starts) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, self.filled + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.filled += len(ids)

    def _flat(self, units: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many of them each text has."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        if missing := [unit for unit, at in zip(distinct, found, strict=True) if at is None]:
            self._learn(missing)
            found = list(map(self.known.get, distinct))
        at = np.array(found, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if distinct else np.empty(0, np.int64)
        lengths = self.lengths[at]
        ids = self.arena[spread(lengths, self.starts[at])]
        until = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(per_text)
        return ids, until[ends] - until[ends - per_text]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        self.tidy()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        hard = pc.or_(pc.match_substring_regex(texts, _BLANK_THEN_SPACE), pc.match_substring(texts, _MARK))
        hard = hard.to_numpy(zero_copy_only=False).astype(bool)
        if hard.any():
            # Texts that Arrow's patterns cannot cut take their places among the others, unit by unit.
            easy, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
            cut = pa.array([_CUT.split(text) for text in texts.take(pa.array(rest)).to_pylist()], pa.list_(pa.string()))
            parts = pa.concat_arrays([self._cut(texts.take(pa.array(easy))), cut]).take(pa.array(np.argsort(np.concatenate([easy, rest]))))
        else:
            parts = self._cut(texts)
        return self.of_parts(parts)

    def tidy(self) -> None:
        """Start anew where too much is remembered."""
        if len(self.known) > self.remembered:
            self._forget()

    def of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts that are lists of units."""
        return self._flat(parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        """Units of texts without a space after white space."""
        return pc.split_pattern(pc.replace_substring(texts, " ", _MARK + " "), _MARK)


def library_units(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes distinct units with the tokenizers library.

    Units that begin with a space and end with a non-blank are joined into
    longer texts, as their seams are cuts too; the byte lengths of the tokens
    tell where each unit ends. The others are encoded one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for token, at in vocabulary.items():
        width[at] = len(token)  # a byte-level token spells each byte with one character

    def ids_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *coded]), np.array([len(ids) for ids in coded], dtype=np.int64)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joint = np.array([u[:1] == " " and not u[-1].isspace() for u in units], dtype=bool)
        joined, single = np.flatnonzero(joint), np.flatnonzero(~joint)
        chosen = [units[i] for i in joined.tolist()]
        ends = np.cumsum(pc.binary_length(pa.array(chosen, pa.string())).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = (ends - 1) // JOINED
        starts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(chosen)).tolist()
        together, _ = ids_of(["".join(chosen[a:b]) for a, b in zip(starts, starts[1:], strict=False)])
        alone, alone_lengths = ids_of([units[i] for i in single.tolist()])
        stops = np.searchsorted(np.cumsum(width[together]), ends) + 1
        lengths = np.empty(len(units), dtype=np.int64)
        lengths[joined], lengths[single] = np.diff(stops, prepend=0), alone_lengths
        found = np.empty(len(units), dtype=np.int64)
        found[joined], found[single] = stops - lengths[joined], len(together) + np.cumsum(alone_lengths) - alone_lengths
        return np.concatenate([together, alone])[spread(lengths, found)], lengths

    return encode


def word_units(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """``library_units`` of the words and signs that units are made of: a word is encoded once, whatever follows it."""
    words = UnitEncoder(library_units(path))

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words.tidy()
        marked = pa.array(units, pa.string())
        if not pc.any(pc.match_substring(marked, _MARK)).as_py():
            for pattern, cut in ((_WORD_THEN_SIGN, f"\\1{_MARK}\\2"), (_LINE_THEN_WORD, f"\\1\n{_MARK}\\2")):
                marked = pc.replace_substring_regex(marked, pattern, cut)
            return words.of_parts(pc.split_pattern(marked, _MARK))
        return words.of_parts(pa.array([[u] for u in units], pa.list_(pa.string())))

    return encode


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file; a reused worker keeps what it has learnt."""
    return UnitEncoder(word_units(path))


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies spell each byte.

    Printable bytes stand for themselves, the others take the code points from
    256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_model(path: str) -> dict:
    """A tokenizer file's JSON."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)
