"""Linking sets that meet in entries of a table, without pairs of an entry's members.

A method lists each set (a node) in entries of a table, such that linked sets
share one. What meets there is first held against a bound of the sets' sketches,
then compared shingle by shingle, and links make components.

An entry may hold any share of the nodes (copies with small edits, or a common
passage). So entries are laid out by range, with a table of two rows for each
partition for those that span partitions; and no pairs are made of them. First
every member meets one hub of its entry, which is then done with. So are entries
whose other members are of one component. Those whose members are of one family, near each other or
by way of others, are looked at as one, the family. Of the rest, cells of at most about ``2 * CELL`` members, each member in one, list for each
component the nearest member of another one, until that joins little more; then
cells list what is left: members of different components whose sketches are within
the bound. An entry's largest component, mostly nearly all of it, is not compared with itself there.
So all that is linked is connected, however entries look.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.llm.common import per_batch, text_digest, texts, utf8
from lakestate.llm.components import roots
from lakestate.llm.simhash import shingle_set
from lakestate.session import written

#: Members of a cell's block; a cell compares two blocks.
CELL = 2048
#: Sets are kin up to so many times the distance that allows a link.
KIN = 1.5
#: Blocks of members outside the common component up to which a family is compared as one.
FAMILY_BLOCKS = 8


class Measure:
    """Sets of ``words``-word shingles are linked from a Jaccard similarity of numerator / denominator on.

    ``allowed`` gives, for sizes a and b (arrays too), the largest Hamming
    distance of sketches at which a link is looked at.
    """

    def __init__(self, words: int, numerator: int, denominator: int, allowed: Callable):
        self.words, self.numerator, self.denominator, self.allowed = words, numerator, denominator, allowed


def folded(parity: bytes, size: int) -> bytes:
    """A sketch of ``size`` bytes from a longer one: places that fall together are XORed."""
    rows = np.frombuffer(parity, np.uint8).reshape(-1, size)
    return np.bitwise_xor.reduce(rows, axis=0).tobytes()


def meet(rows: DataFrame) -> DataFrame:
    """``entry``, ``node``, ``hub`` of all entries that more than one node is in, of distinct rows (entry, node)."""
    ranged = rows.select("entry", "node").repartitionByRange("entry", "node").sortWithinPartitions("entry", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of entries with two members here, and whatever an earlier or later partition may share: the first and last entry."""
        first, tail = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if tail is not None:
                entry, node = np.concatenate([tail[0], entry]), np.concatenate([tail[1], node])
                hub_before = tail[2]
            else:
                first, hub_before = entry[0], node[0]
            new = np.concatenate([[True], entry[1:] != entry[:-1]])
            starts = np.flatnonzero(new)
            hubs = node[starts]
            hubs[0] = hub_before
            group = np.cumsum(new) - 1
            lengths = np.diff(np.append(starts, len(entry)))
            # The last entry may go on: its last row is held back, the others are sure to have company.
            together = (lengths[group] > 1) | (entry == first) | (hubs[group] != node)
            together[-1] = False
            tail = (entry[-1:], node[-1:], hubs[group[-1]])
            if together.any():
                yield _entry_rows(entry[together], node[together], hubs[group][together], first)
        if tail is not None:
            yield _entry_rows(tail[0], tail[1], np.array([tail[2]]), None)

    found = written(ranged.mapInArrow(run, "entry bigint, node bigint, hub bigint, edge boolean"), "entries")
    # Only an entry at a partition's edge may go on in others: two for each partition.
    edges = found.filter("edge").groupBy("entry").agg(F.min("hub").alias("least"), F.max("node").alias("most"))
    whole = found.join(edges, "entry", "left").withColumn("hub", F.coalesce("least", "hub"))
    kept = whole.filter("least IS NULL OR least < most")
    return kept.select("entry", "node", "hub")


def _entry_rows(entry: np.ndarray, node: np.ndarray, hub: np.ndarray, first) -> pa.RecordBatch:
    edge = np.ones(len(entry), dtype=bool) if first is None else entry == first
    return pa.RecordBatch.from_pydict({"entry": pa.array(entry), "node": pa.array(node), "hub": pa.array(hub), "edge": pa.array(edge)})


def _within(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Distinct pairs (u, v) that are kin by sizes and sketches; ``near`` if these allow a link."""
    a = nodes.select(F.col("node").alias("u"), F.col("size").alias("a"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("v"), F.col("size").alias("b"), F.col("sketch").alias("sb"))
    sizes = measure.denominator * F.least("a", "b") >= measure.numerator * F.greatest("a", "b")
    met = pairs.distinct().join(a, "u").join(b, "v").filter(sizes)

    allowed = measure.allowed

    def step(batch: pa.RecordBatch) -> dict | None:
        columns = [c.to_pylist() for c in batch.columns]
        held = [(u, v, _apart(sa, sb), allowed(a, b)) for u, v, a, b, sa, sb in zip(*columns, strict=True)]
        kept = [(u, v, apart <= most) for u, v, apart, most in held if apart <= KIN * most]
        u, v, near = zip(*kept, strict=True) if kept else ((), (), ())
        return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "near": pa.array(near, pa.bool_())}

    return met.select("u", "v", "a", "b", "sa", "sb").mapInArrow(per_batch(step), "u bigint, v bigint, near boolean")


def _apart(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    a, b = (x if len(x) == size else folded(x, size) for x in (a, b))
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, measure: Measure) -> DataFrame:
    """Those of the written pairs that are linked, by their texts' shingles; written."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    where = nodes.join(wanted, "node").select("node", F.col("least.doc_id").alias("w_id"), F.col("least.digest").alias("w_digest"))

    words = measure.words

    def step(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "shingles": pa.array([shingle_set(text, words).view(np.int64) for text in utf8(batch)], pa.list_(pa.int64()))}

    rows = texts(docs).withColumn("digest", text_digest())
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))
    # A repeated row gives its node twice; which of the two stays is all the same.
    found = rows.join(where, same).select("node", "text").mapInArrow(per_batch(step), "node bigint, shingles array<bigint>")
    shingles = written(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    a = shingles.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = shingles.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    linked = (measure.denominator + measure.numerator) * both >= measure.numerator * (F.size("a") + F.size("b"))
    return written(pairs.join(a, "u").join(b, "v").filter(linked).select("u", "v"), "links")


def _open(met: DataFrame, rooted: DataFrame) -> DataFrame:
    """``entry``, ``node``, ``root`` of entries whose members are not of one component.

    ``common`` is the component with the most members there, ``n_common`` of ``members``.
    """
    state = met.join(rooted, "node", "left").select("entry", "node", F.coalesce("root", "node").alias("root"))
    state = written(state, "state")
    held = state.groupBy("entry", "root").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("entry").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("most")).filter("most.n < members")
    some = most.select("entry", "members", F.col("most.n").alias("n_common"), F.col("most.root").alias("common"))
    return written(state.join(some, "entry"), "open")


def _cells(opened: DataFrame, nodes: DataFrame, measure: Measure, turn: int | None) -> DataFrame:
    """Pairs (u, v) of different components of an entry whose sketches are within the distance.

    A numbered ``turn`` deals each member to one cell of its entry, in another way
    each time, and gives only each component's nearest there.
    Without one all is compared: members of the common component and the others
    are dealt to blocks, and every two blocks but two common ones (and each other one alone) are
    a cell, so the common component is copied once for each block of the others.
    """
    blocks = lambda n: F.ceil(n / F.lit(CELL)).cast("bigint")
    if turn is not None:
        dealt = opened.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("members") / F.lit(2 * CELL)).cast("bigint")))
        copies = dealt.withColumn("other", F.col("block"))
    else:
        # Blocks of the common component have negative numbers.
        whole, common = F.col("members") <= 2 * CELL, F.col("root") == F.col("common")
        n_own, n_rest = blocks(F.col("n_common")), blocks(F.col("members") - F.col("n_common"))
        block = F.when(whole, F.lit(0).cast("bigint")).when(common, -1 - F.pmod(F.xxhash64("node"), n_own)).otherwise(F.pmod(F.xxhash64("node"), n_rest))
        first = F.when(whole | common, F.lit(0).cast("bigint")).otherwise(-n_own)
        last = F.when(whole, F.lit(0).cast("bigint")).otherwise(n_rest - 1)
        copies = opened.withColumn("block", block).withColumn("other", F.explode(F.sequence(first, last)))
    member = F.struct("node", "root", "size", "sketch", "block")
    cell = ["entry", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    cells = copies.join(nodes.select("node", "size", "sketch"), "node").groupBy(*cell).agg(F.collect_list(member).alias("members"))

    allowed = measure.allowed

    def step(batch: pa.RecordBatch) -> dict | None:
        found: set[tuple[int, int]] = set()
        for one, two, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found |= _near_in(members.values.field, allowed, one != two, turn is not None)
        u, v = zip(*found, strict=True) if found else ((), ())
        return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}

    return cells.select("i", "j", "members").mapInArrow(per_batch(step), "u bigint, v bigint").distinct()


def _near_in(field, allowed: Callable, across: bool, nearest: bool) -> set[tuple[int, int]]:
    """Pairs within the distance in one cell; ``across`` leaves out those of one block."""
    node, root, size, block = (field(c).to_numpy() for c in ("node", "root", "size", "block"))
    raw = field("sketch").to_pylist()
    width = min(map(len, raw))
    rows = np.frombuffer(b"".join(r if len(r) == width else folded(r, width) for r in raw), "<u8").reshape(len(raw), -1)
    out: set[tuple[int, int]] = set()
    best: dict[int, tuple[int, int, int]] = {}
    # The members of the largest component are met by the others.
    _, number, counts = np.unique(root, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(number != counts.argmax()).tolist():
        apart = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64)
        near = (root != root[i]) & (apart <= allowed(size, size[i]))
        if across:
            near &= block != block[i]
        at = np.flatnonzero(near)
        pairs = [(max(x, int(node[i])), min(x, int(node[i]))) for x in node[at].tolist()]
        if nearest and pairs:
            one = min((d, *p) for d, p in zip(apart[at].tolist(), pairs, strict=True))
            best[int(root[i])] = min(one, best.get(int(root[i]), one))
        elif pairs:
            out.update(pairs)
    return {p[1:] for p in best.values()} if nearest else out


def _gathered(met: DataFrame, rooted: DataFrame, kin: DataFrame) -> DataFrame:
    """``entry`` and ``node`` of what is still to be compared; written.

    Members of one family (connected by kin) meet again and again, in each entry
    that some of them share. So an open entry whose members are all of one family gives way to the family,
    which is then one entry of each of its members once. Families with many members outside their
    common component keep their entries, which may be smaller.
    """
    of = lambda name: F.coalesce(name, "node").alias(name)
    known = written(kin.withColumnRenamed("root", "family").join(rooted, "node", "full").select("node", of("root"), of("family")), "families")
    # A hub stands for its entry: the entry is open if a member is apart from it.
    members, hubs = known.toDF("member", "root", "family"), known.toDF("hub", "hub_root", "hub_family")
    pairs = met.select(F.col("node").alias("member"), "hub").distinct().join(members, "member", "left").join(hubs, "hub", "left")
    ends = [F.coalesce(c, n) for c, n in (("root", "member"), ("hub_root", "hub"), ("family", "member"), ("hub_family", "hub"))]
    apart = pairs.filter(ends[0] != ends[1]).select(F.col("member").alias("node"), "hub", ends[3].alias("of_family"), (ends[2] != ends[3]).alias("strange"))
    touched = met.join(written(apart, "apart"), ["node", "hub"])
    entries = written(touched.groupBy("entry").agg(F.max("strange").alias("strange"), F.first("of_family").alias("of_family")), "entries")
    sizes = known.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg((F.sum("n") - F.max("n")).alias("rest"))
    asked = entries.filter("NOT strange").select(F.col("of_family").alias("family")).distinct()
    chosen = written(sizes.join(asked, "family").filter(F.col("rest") <= FAMILY_BLOCKS * CELL).select("family"), "chosen")
    own = entries.join(chosen, ~F.col("strange") & (F.col("of_family") == F.col("family")), "left_anti").select("entry")
    whole = known.join(chosen, "family").select(F.xxhash64("family").alias("entry"), "node")
    return written(met.join(own, "entry", "left_semi").select("entry", "node").unionByName(whole), "gathered")


def links(met: DataFrame, nodes: DataFrame, docs: DataFrame, measure: Measure) -> DataFrame:
    """``node`` and ``root`` of all nodes (node, size, sketch, least) that are linked to another one that they meet (entry, node, hub).

    ``least`` (doc_id, digest) names a row of ``docs`` that has the node's set.
    """
    stars = met.filter("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
    kin = written(_within(stars, nodes, measure), "pairs")
    linked = _verified(kin.filter("near").select("u", "v"), nodes, docs, measure)
    rooted = written(roots(linked), "roots")
    # The hubs have met all members of their entries.
    # For families it is enough that each node hangs on its least kin, and all of a component together.
    hung = kin.groupBy("u").agg(F.min("v").alias("v")).unionByName(rooted.toDF("u", "v"))
    met = _gathered(met.filter("node <> hub"), rooted, roots(hung))
    for turn in itertools.count():
        opened = _open(met, rooted)
        if opened.isEmpty():
            return rooted
        pairs = written(_cells(opened, nodes, measure, turn), "pairs")
        more = _verified(pairs, nodes, docs, measure)
        found = more.count()
        if found:
            rooted = written(roots(rooted.toDF("u", "v").unionByName(more)), "roots")
        met = opened.select("entry", "node")
        # Again, while one in ten of the nearest is linked.
        if 10 * found <= pairs.count():
            break
    opened = _open(met, rooted)
    if opened.isEmpty():
        return rooted
    more = _verified(written(_cells(opened, nodes, measure, None), "pairs"), nodes, docs, measure)
    return written(roots(rooted.toDF("u", "v").unionByName(more)), "roots")
