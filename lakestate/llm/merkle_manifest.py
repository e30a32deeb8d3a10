"""Merkle manifest of a dataset: roots, and for every row the witness that leads to them.

Each row is a leaf: the SHA-256 of its fields, each as ``-`` if null, else as
its UTF-8 byte count, ``:`` and its value. The leaves of one source ascend by
doc_id; every three neighbours (the last run may have fewer, even one) become
one node, until one is left, the source's subroot. The subroots, by source, make
the root in the same way.

Witnesses grow while the tree does. ``Appender`` takes leaves one by one: what
is appended joins the open run of its level; a run that is complete closes, each
member's siblings are attached to the partial witnesses of all leaves below it,
and the node that it makes is appended one level up. So a leaf's witness is
extended whenever a sibling subtree is complete, and nothing is visited twice.

Sources may hold any share of the rows. Positions come from range partitions;
each run of 3 ** ``levels`` positions of a source is an aligned block that one
task appends, with at most that many partial witnesses in memory. The blocks'
roots are further appends: rows of the same function, with a block's position
as theirs, until each source has one node. Texts are read once, for the leaves.

Null texts, ids and sources are fields of their own kind; a null source and a
null id come first. Equal ids of a source are in the order of their leaves'
digests; repeated rows are leaves each. An empty table gives no rows; a row
alone is its own subroot, and its witness is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.functions.ordering import with_ordinal
from lakestate.llm.common import settle
from lakestate.session import written

ARITY = 3
#: Blocks of 3 ** LEVELS leaves.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node_of(children: bytes) -> bytes:
    """The node above some digests, which are hashed as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


class Appender:
    """An append-only tree with the partial witness and path of every leaf so far.

    ``open`` has, by level, the members of the run that is not complete: a
    digest and the leaves below it, ``first`` to ``end``. A path has one byte
    for each level: four times the place in the run, and the run's size.
    """

    def __init__(self):
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.witnesses: list[bytearray] = []
        self.paths: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        leaf = len(self.witnesses)
        self.witnesses.append(bytearray())
        self.paths.append(bytearray())
        level, member = 0, (digest, leaf, leaf + 1)
        while True:
            self.open[level].append(member)
            if len(self.open[level]) < ARITY:
                return
            member = self._close(level)
            level += 1

    def _close(self, level: int) -> tuple[bytes, int, int]:
        """The node of a level's open run; its members' siblings go to the witnesses below them."""
        run = self.open[level]
        self.open[level] = []
        if level + 1 == len(self.open):
            self.open.append([])
        for place, (_, first, end) in enumerate(run):
            siblings = b"".join(d for i, (d, _, _) in enumerate(run) if i != place)
            step = 4 * place + len(run)
            for leaf in range(first, end):
                self.witnesses[leaf] += siblings
                self.paths[leaf].append(step)
        return node_of(b"".join(d for d, _, _ in run)), run[0][1], run[-1][2]

    def finish(self, levels: int = 0) -> bytes:
        """Close what is open, up to one node on at least ``levels`` levels; that node."""
        level = 0
        while True:
            run = self.open[level]
            above = any(self.open[level + 1 :])
            if len(run) == 1 and not above and level >= levels:
                return run[0][0]
            if run:
                made = self._close(level)
                self.open[level + 1].append(made)
            level += 1


def fold(digest: bytes, witness: bytes, path: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    at = 0
    for step in path:
        place, siblings = step >> 2, (step & 3) - 1
        others = witness[at : at + 32 * siblings]
        digest = node_of(others[: 32 * place] + digest + others[32 * place :])
        at += 32 * siblings
    return digest


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields, as 32 bytes."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(v) for v in fields.values()]).cast("binary"), 256))


def _blocks(levels: int):
    """Appends sorted rows (group, block, ordinal, digest, payload); a block ends where the next begins."""
    size_of = ARITY**levels

    def closed(group, block: int, rows: list[dict], tree: Appender) -> pa.RecordBatch:
        top = tree.finish(levels if block else 0)
        return pa.RecordBatch.from_pydict({
            "group": pa.array([group] * len(rows), pa.string()), "block": pa.array([block] * len(rows), pa.int64()),
            "payload": pa.array([r["payload"] for r in rows], pa.binary()), "ordinal": pa.array([r["ordinal"] for r in rows], pa.int64()),
            "witness": pa.array([bytes(w) for w in tree.witnesses], pa.binary()), "path": pa.array([bytes(p) for p in tree.paths], pa.binary()),
            "top": pa.array([top] * len(rows), pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, tree = None, [], Appender()
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["group"], row["block"])
                if rows and key != held:
                    yield closed(*held, rows, tree)
                    rows, tree = [], Appender()
                held = key
                assert len(rows) < size_of
                tree.append(row["digest"])
                rows.append(row)
        if rows:
            yield closed(*held, rows, tree)

    return run


_APPENDED = "group string, block bigint, payload binary, ordinal bigint, witness binary, path binary, top binary"


def _appended(rows: DataFrame, levels: int) -> DataFrame:
    """Rows (group, ordinal from 1, digest, payload) with their block, its root ``top``, and the witness up to it."""
    placed = rows.withColumn("block", F.floor((F.col("ordinal") - 1) / F.lit(ARITY**levels)).cast("bigint"))
    sorted_ = placed.repartition("group", "block").sortWithinPartitions("group", "block", "ordinal")
    return sorted_.select("group", "block", "ordinal", "digest", "payload").mapInArrow(_blocks(levels), _APPENDED)


def tree(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``group``, ``payload``, ``witness``, ``path`` and ``top``, the group's root, of rows (group, ordinal, digest, payload)."""
    found = written(_appended(rows, levels), "leaf-blocks")
    whole = found
    while (found.agg(F.max("block")).first()[0] or 0) > 0:
        tops = found.groupBy("group", "block").agg(F.first("top").alias("digest"))
        further = tops.select("group", (F.col("block") + 1).alias("ordinal"), "digest", F.lit(b"").alias("payload"))
        found = written(_appended(further, levels), "blocks")
        above = found.select(
            F.col("group").alias("a_group"), (F.col("ordinal") - 1).alias("a_place"), F.col("block").alias("a_block"),
            F.col("witness").alias("a_witness"), F.col("path").alias("a_path"), F.col("top").alias("a_top"),
        )
        whole = whole.join(above, (F.col("group") == F.col("a_group")) & (F.col("block") == F.col("a_place"))).select(
            "group", F.col("a_block").alias("block"), "payload", F.concat("witness", "a_witness").alias("witness"),
            F.concat("path", "a_path").alias("path"), F.col("a_top").alias("top"),
        )
    return whole.select("group", "payload", "witness", "path", "top")


def manifest(docs: DataFrame, claimed_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, claimed, subroot, root, witness, path (all but the id binary) of every row.

    ``claimed`` is the leaf that a reader would compute from ``claimed_text``;
    without one it is the leaf itself.
    """
    settle(docs.sparkSession)
    own = {c: F.col(c) for c in FIELDS}
    other = own if claimed_text is None else own | {"text": claimed_text}
    leaves = docs.select(
        # A null source before all others: "-" is less than "=".
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("group"),
        F.col("doc_id").cast("bigint").alias("doc_id"), leaf(own).alias("digest"), leaf(other).alias("claimed"),
    )
    placed = with_ordinal(leaves, ["group"], ["doc_id", "digest"])
    # The payload: both digests, then the id's eight bytes unless it is null.
    payload = F.concat("digest", "claimed", F.coalesce(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), F.lit(b"")))
    rows = tree(placed.select("group", "ordinal", "digest", payload.alias("payload")), levels)
    subroots = rows.groupBy("group").agg(F.first("top").alias("digest"))
    ordered = with_ordinal(subroots.withColumn("all", F.lit("")), ["all"], ["group"])
    sources = tree(ordered.select(F.col("all").alias("group"), "ordinal", "digest", F.col("group").cast("binary").alias("payload")), levels)
    roots = sources.select(
        F.col("payload").cast("string").alias("group"), F.col("witness").alias("s_witness"), F.col("path").alias("s_path"), F.col("top").alias("root")
    )
    ids = F.conv(F.hex(F.substring("payload", 65, 8)), 16, -10).cast("bigint")
    return rows.join(written(roots, "roots"), "group").select(
        F.when(F.length("payload") > 64, ids).alias("doc_id"), F.substring("payload", 1, 32).alias("leaf"), F.substring("payload", 33, 32).alias("claimed"),
        F.col("top").alias("subroot"), "root", F.concat("witness", "s_witness").alias("witness"), F.concat("path", "s_path").alias("path"),
    )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("claimed").to_pylist(), batch.column("witness").to_pylist(), batch.column("path").to_pylist(), strict=True)
        folded = pa.array([fold(*r) for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], folded], names=[*batch.schema.names[:-1], "folded_root"])


def verify(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (lowercase hex) and verified, of a manifest's rows.

    The folded root comes from the claimed leaf and the stored witness alone.
    """
    proof = F.sha2(F.lower(F.hex("witness")).cast("binary"), 256)
    asked = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "claimed", "witness", "path")
    found = asked.mapInArrow(_folded, "doc_id bigint, leaf binary, subroot binary, root binary, proof_sha256 string, claimed binary, witness binary, folded_root binary")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        "doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified")
    )


def tampered_text() -> Column:
    """The text without its newlines where two divides the id's CRC-32, else the text."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
