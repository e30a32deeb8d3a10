"""Token ids in Re-Pair grammar files.

Texts are encoded in ascending doc_id order into shards of whole documents. A
shard is a row of a Parquet table (so that Spark's writer commits, retries and
places files) and holds the ids and token counts of its documents and one or
more blocks. A block is a Re-Pair grammar: frequent neighbouring pairs are
replaced again and again by new symbols (nonterminals); kept are the rules
(left, right), the number of ids each rule expands to, and the remaining
symbols, 16 bits each. The expansion lengths give, without decoding, where any
id of the block is, so a range of ids is decoded alone (``decode_range``).

A round replaces all pairs whose counts are within a factor of the largest,
most frequent first; rounds end when no pair is frequent enough, at ``rounds``,
or when the 16-bit symbols are used up.

Null texts count as empty: one end id. Rows with equal ids keep each their own
range, in the order of their texts' hash; null ids come first. An empty table
gives files without rows. A text longer than a block spans blocks of its shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakestate.llm.common import texts
from lakestate.llm.units import library_encoder

#: Symbols from here on are nonterminals; ids have to be smaller. 16-bit symbols leave 15,000 rules.
FIRST_RULE = 50_536
LAST_SYMBOL = 65_535
BLOCK_IDS = 1 << 18
MIN_COUNT = 16
ROUNDS = 5
WITHIN = 16

FILE = (
    "part int, shard int, first_id bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "blocks array<struct<n_ids:int,rule_left:binary,rule_right:binary,rule_lengths:binary,symbols:binary>>"
)
_BLOCK = pa.struct([("n_ids", pa.int32()), ("rule_left", pa.binary()), ("rule_right", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary())])


class Grammar:
    """Rules and remaining symbols of one block."""

    def __init__(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.left, self.right, self.lengths, self.symbols = left, right, lengths, symbols

    def symbol_lengths(self) -> np.ndarray:
        """Ids each remaining symbol stands for."""
        out = np.ones(len(self.symbols), dtype=np.int64)
        rules = self.symbols >= FIRST_RULE
        out[rules] = self.lengths[self.symbols[rules].astype(np.int64) - FIRST_RULE]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols, one level of rules at a time."""
        symbols = symbols.astype(np.int64)
        while (rules := symbols >= FIRST_RULE).any():
            at = np.cumsum(1 + rules) - (1 + rules)
            out = np.empty(len(symbols) + int(rules.sum()), dtype=np.int64)
            out[at[~rules]] = symbols[~rules]
            number = symbols[rules] - FIRST_RULE
            out[at[rules]], out[at[rules] + 1] = self.left[number], self.right[number]
            symbols = out
        return symbols.astype(np.uint32)


def _frequent(codes: np.ndarray, room: int, min_count: int) -> np.ndarray:
    """Codes of the most frequent pairs, most frequent first."""
    ordered = np.sort(codes)
    edges = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
    counts = np.diff(edges)
    enough = counts >= max(min_count, int(counts.max()) // WITHIN)
    values, counts = ordered[edges[:-1][enough]], counts[enough]
    return values[np.argsort(-counts, kind="stable")][:room]


def compress(ids: np.ndarray, min_count: int = MIN_COUNT, rounds: int = ROUNDS) -> Grammar:
    """The grammar of a block of ids below ``FIRST_RULE``."""
    if len(ids) and int(ids.max()) >= FIRST_RULE:
        raise ValueError("an id is as large as a nonterminal")
    symbols = ids.astype(np.uint32)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    lengths = np.ones(LAST_SYMBOL + 1, dtype=np.int64)
    following = FIRST_RULE
    for _ in range(rounds):
        if len(symbols) < 2 * min_count or following > LAST_SYMBOL:
            break
        codes = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        chosen = _frequent(codes, LAST_SYMBOL + 1 - following, min_count)
        if not len(chosen):
            break
        # A small hash table from pairs to rules; of pairs that share a slot the most frequent stays for this round.
        slot_of = lambda c: (c * np.uint32(2654435761)) >> np.uint32(16)
        slots = slot_of(chosen)
        _, first = np.unique(slots, return_index=True)
        chosen = chosen[np.sort(first)]
        slots = slot_of(chosen)
        rule = np.full(1 << 16, -1, dtype=np.int32)
        rule[slots] = np.arange(len(chosen), dtype=np.int32)
        met = rule[slot_of(codes)]
        at = np.flatnonzero(met >= 0)
        at = at[chosen[met[at]] == codes[at]]
        # Of overlapping occurrences every second one is replaced, from the left.
        run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
        head = at[np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))]
        at = at[(at - head[run]) % 2 == 0]
        used, numbers = np.unique(met[at], return_inverse=True)
        pairs = chosen[used]
        a, b = (pairs >> np.uint32(16)).astype(np.int64), (pairs & np.uint32(0xFFFF)).astype(np.int64)
        lengths[following : following + len(used)] = lengths[a] + lengths[b]
        left.append(a)
        right.append(b)
        symbols = symbols.copy()
        symbols[at] = following + numbers
        stays = np.ones(len(symbols), dtype=bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        following += len(used)
    return Grammar(np.concatenate(left), np.concatenate(right), lengths[FIRST_RULE:following], symbols)


def _packed(grammar: Grammar, n_ids: int) -> dict:
    return {
        "n_ids": n_ids, "rule_left": grammar.left.astype("<u2").tobytes(), "rule_right": grammar.right.astype("<u2").tobytes(),
        "rule_lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": grammar.symbols.astype("<u2").tobytes(),
    }


def unpacked(block: dict) -> Grammar:
    """The grammar of a block as the file holds it."""
    return Grammar(
        np.frombuffer(block["rule_left"], "<u2").astype(np.int64), np.frombuffer(block["rule_right"], "<u2").astype(np.int64),
        np.frombuffer(block["rule_lengths"], "<u4").astype(np.int64), np.frombuffer(block["symbols"], "<u2"),
    )


def decode_range(grammar: Grammar, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block; only the symbols that cover them are expanded."""
    ends = np.cumsum(grammar.symbol_lengths())
    if stop <= start or not len(ends):
        return np.empty(0, np.uint32)
    first, last = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    before = int(ends[first - 1]) if first else 0
    return grammar.expand(grammar.symbols[first:last])[start - before : stop - before]


def _shards(tokenizer: str, end_id: int, block_ids: int):
    """Encodes a sorted partition and closes a shard with the document that fills a block."""

    def row(part: int, shard: int, first: int, docs: list, lengths: list, ids: np.ndarray) -> dict:
        blocks = [ids[i : i + block_ids] for i in range(0, len(ids), block_ids)]
        return {"part": part, "shard": shard, "first_id": first, "n_ids": len(ids), "doc_ids": docs, "doc_lengths": lengths, "blocks": [_packed(compress(b), len(b)) for b in blocks]}

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("blocks", pa.list_(_BLOCK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, counts = library_encoder(tokenizer).encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
            at = 0
            for doc, count in zip(batch.column(0).to_pylist(), (counts + 1).tolist(), strict=True):
                docs.append(doc)
                lengths.append(count)
                held.append(ids[at : at + count])
                at += count
                size += count
                if size >= block_ids:
                    yield pa.RecordBatch.from_pylist([row(part, shard, first, docs, lengths, np.concatenate(held))], schema)
                    shard, first = shard + 1, first + size
                    docs, lengths, held, size = [], [], [], 0
            held = [h.copy() for h in held]
        if docs:
            yield pa.RecordBatch.from_pylist([row(part, shard, first, docs, lengths, np.concatenate(held))], schema)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, partitions: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode all rows and write the grammar files to the folder ``path``.

    One shuffle of the texts puts them in order; partitions follow the
    session's shuffle partitions unless given.
    """
    rows = texts(docs)
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("__tie", F.xxhash64("text")).repartitionByRange(count, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    ordered.select("doc_id", "text").mapInArrow(_shards(tokenizer, end_id, block_ids), FILE).write.parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """``part`` and the number of ids in all parts before it: one row per written partition."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    The table of part starts has one row for each partition of the writing
    job, whatever the documents; it is the only thing broadcast.
    """
    files = spark.read.schema(FILE).parquet(path)
    placed = files.join(F.broadcast(part_starts(files)), "part").select(
        (F.col("part_start") + F.col("first_id")).alias("start"), "doc_ids", "doc_lengths", "blocks"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (shard,) = batch.slice(i, 1).to_pylist()
                ids = [g.expand(g.symbols) for g in map(unpacked, shard["blocks"])]
                raw = memoryview(np.concatenate(ids).astype("<u4").tobytes())
                lengths = np.array(shard["doc_lengths"], dtype=np.int64)
                starts = np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard["doc_ids"], pa.int64()), "start": pa.array(shard["start"] + starts),
                    "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
