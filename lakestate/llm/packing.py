"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are cut into pieces of at most ``capacity`` tokens; pieces are dealt
to tasks of a fixed size by a hash, and each task packs its own in one pass. A
bitset with one bit for each free space says, in one shift, which open bin fits
best. When all bins are open and none fits, the fullest closes. What stays half
empty at the end of a task is at most its open bins, so the loss does not grow
with the number of tasks' rows.

Null texts count as empty and give one piece (the end id). Repeated rows are
packed each. An empty table gives no rows. Longer texts give more pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import per_batch, texts
from lakestate.llm.units import library_encoder
from lakestate.session import written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces packed by one task.
TASK_PIECES = 250_000
OPEN_BINS = 256


class OpenBins:
    """At most ``limit`` open bins, found by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free_spaces = 0  # bit f is set if an open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.bins = 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_spaces ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fitting = self.free_spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.free_spaces & -self.free_spaces).bit_length() - 1)
            free, number = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_spaces |= 1 << left
            self.open += 1
        return number, self.capacity - free


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Whole pieces at the end; only the first may be shorter."""
    count = max(1, math.ceil(total / capacity))
    return [total - (count - 1) * capacity] + [capacity] * (count - 1)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batch: pa.RecordBatch) -> dict:
        ids, counts = library_encoder(tokenizer).encode(batch.column(1))
        ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
        raw, at = memoryview(ids.tobytes()), 0
        rows: list[tuple] = []
        for doc, count in zip(batch.column(0).to_pylist(), (counts + 1).tolist(), strict=True):
            start = 0
            for piece, length in enumerate(piece_lengths(count, capacity)):
                begin = 4 * (at + start)
                rows.append((doc, piece, start, length, zlib.crc32(raw[begin : begin + 4 * length])))
                start += length
            at += count
        doc, piece, start, length, crc = zip(*rows, strict=True)
        return {
            "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
        }

    return texts(docs).mapInArrow(per_batch(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    The pieces (no ids) are written once to the shared folder, as their number
    decides how many tasks pack.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    tasks = max(1, math.ceil(cut.count() / task_pieces))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    dealt = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        cut.withColumn("__dealt", dealt)
        .repartition(tasks, "__dealt")
        .sortWithinPartitions("__dealt", "doc_id", "piece")
        .mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")
    )
