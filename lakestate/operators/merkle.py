"""Prefix trees over record sets: leaves, levels, roots, tree diff, versions."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestate.operators import recordset
from lakestate.session import pinned


def leaf_id(key: Column, bits: int) -> Column:
    """The first ``bits`` of the key's SHA-256, at most 16."""
    return F.shiftright(F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("int"), 16 - bits)


def _strand(key: Column) -> Column:
    """Two further hex digits of the key's hash: 256 even parts of a leaf."""
    return F.substring(F.sha2(key, 256), 5, 2)


def empty_hashes(bits: int) -> list[str]:
    """Hash of an empty subtree, by level (0 = leaf)."""
    hashes = [hashlib.sha256(b"leaf:").hexdigest()]
    for _ in range(bits):
        hashes.append(hashlib.sha256(f"node:{hashes[-1]}{hashes[-1]}".encode()).hexdigest())
    return hashes


def leaves(descs: DataFrame, bits: int, scope: list[str] | None = None) -> DataFrame:
    """Hash and size of every non-empty leaf.

    A leaf is hashed in two steps: its keys are split into 256 strands by
    further digits of the key hash, each strand is hashed in key order, and
    the leaf hashes its strands. So a list gathered in one place holds a
    256th of a leaf, also when one leaf is much fuller than others.
    """
    scope = scope or []
    strands = (
        descs.select(*scope, leaf_id(F.col("key"), bits).alias("leaf"), _strand(F.col("key")).alias("strand"), "key", "fingerprint")
        .groupBy(*scope, "leaf", "strand")
        .agg(F.array_sort(F.collect_list(F.struct("key", "fingerprint"))).alias("rows"), F.count(F.lit(1)).alias("n"))
        .select(
            *scope, "leaf", "strand", "n",
            F.sha2(F.array_join(F.transform("rows", lambda r: r["fingerprint"]), ""), 256).alias("strand_hash"),
        )
    )
    return (
        strands.groupBy(*scope, "leaf")
        .agg(F.array_sort(F.collect_list(F.struct("strand", "strand_hash"))).alias("parts"), F.sum("n").alias("n"))
        .select(
            *scope, "leaf",
            F.sha2(F.concat(F.lit("leaf:"), F.array_join(F.transform("parts", lambda p: p["strand_hash"]), "")), 256).alias("hash"),
            "n",
        )
    )


def _parents(nodes: DataFrame, level: int, empty: str, scope: list[str]) -> DataFrame:
    """Nodes of the next level: each hashes its two children, absent ones as empty."""
    left = F.max(F.when(F.col("node_index") % 2 == 0, F.col("hash")))
    right = F.max(F.when(F.col("node_index") % 2 == 1, F.col("hash")))
    return (
        nodes.groupBy(*scope, F.shiftright("node_index", 1).alias("parent"))
        .agg(left.alias("l"), right.alias("r"), F.sum("n").alias("n"))
        .select(
            *scope, F.lit(level).alias("level"), F.col("parent").alias("node_index"),
            F.sha2(F.concat(F.lit("node:"), F.coalesce("l", F.lit(empty)), F.coalesce("r", F.lit(empty))), 256).alias("hash"),
            "n",
        )
    )


def levels(leaf_rows: DataFrame, bits: int, scope: list[str] | None = None, top: int | None = None) -> list[DataFrame]:
    """The non-empty nodes of each level, leaves first, root last.

    At most 17 levels, each half the one below; a level has at most 2^16 rows
    per scope whatever the record count.
    """
    scope = scope or []
    empties = empty_hashes(bits)
    out = [leaf_rows.select(*scope, F.lit(0).alias("level"), F.col("leaf").cast("bigint").alias("node_index"), "hash", "n")]
    for level in range(1, (bits if top is None else top) + 1):
        out.append(_parents(out[-1], level, empties[level - 1], scope))
    return out


def tree(descs: DataFrame, bits: int, scope: list[str] | None = None) -> DataFrame:
    """Every non-empty node of every level.

    The leaf level and the middle level (at most 2^16 and 2^8 rows per scope)
    are written once, so that no level's work is repeated for the ones above.
    """
    scope = scope or []
    half = bits // 2
    lower = levels(pinned(leaves(descs, bits, scope)), bits, scope, half)
    lower[half] = pinned(lower[half])
    upper = [lower[half]]
    for level in range(half + 1, bits + 1):
        upper.append(_parents(upper[-1], level, empty_hashes(bits)[level - 1], scope))
    return reduce(DataFrame.unionByName, lower[:half] + upper)


def root(nodes: DataFrame, bits: int) -> DataFrame:
    """One digest for the whole set, independent of row order."""
    return nodes.filter(F.col("level") == bits).drop("level", "node_index")


def mismatched_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """X11, first step: leaves whose hashes differ."""
    a = left.select("leaf", F.col("hash").alias("left_hash"), F.col("n").alias("left_n"))
    b = right.select("leaf", F.col("hash").alias("right_hash"), F.col("n").alias("right_n"))
    return a.join(b, "leaf", "full_outer").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def tree_diff(left: DataFrame, right: DataFrame, bits: int, left_leaves: DataFrame, right_leaves: DataFrame) -> DataFrame:
    """X11: compare leaves, then only the descriptors under leaves that differ.

    The list of differing leaves has at most 2^16 numbers, so sending it to
    all tasks is bounded whatever the data.
    """
    wrong = F.broadcast(mismatched_leaves(left_leaves, right_leaves).select("leaf"))
    slice_of = lambda d: d.withColumn("leaf", leaf_id(F.col("key"), bits)).join(wrong, "leaf", "left_semi").drop("leaf")
    return recordset.diff(slice_of(left), slice_of(right))


def diff_work(left: DataFrame, right: DataFrame, bits: int, left_leaves: DataFrame, right_leaves: DataFrame) -> DataFrame:
    """X11 counters: leaves that differ, descriptors and bytes looked at."""
    wrong = mismatched_leaves(left_leaves, right_leaves)
    both = left.select("key", "payload_digest", "fingerprint", "payload_bytes").unionByName(
        right.select("key", "payload_digest", "fingerprint", "payload_bytes")
    )
    looked = both.withColumn("leaf", leaf_id(F.col("key"), bits)).join(
        F.broadcast(wrong.select("leaf")), "leaf", "left_semi"
    )
    size = F.octet_length(F.to_json(F.struct("key", "payload_digest", "fingerprint", "payload_bytes")))
    return looked.agg(
        F.countDistinct("leaf").alias("n_leaves"), F.count(F.lit(1)).alias("n_descriptors"), F.sum(size).alias("n_bytes")
    )


def add(nodes: DataFrame, old: DataFrame, new: DataFrame, bits: int, version: int) -> DataFrame:
    """Nodes that a batch of new descriptors changes, with the given version.

    Old descriptors are cut to the leaves that the batch touches before anything
    else is done with them. The paths above are walked in one task: they have
    at most ``bits`` times 2^16 rows (2^16 leaves), whatever the record set.
    """
    touched = pinned(new.select(leaf_id(F.col("key"), bits).alias("leaf")).distinct())
    near = old.withColumn("leaf", leaf_id(F.col("key"), bits)).join(F.broadcast(touched), "leaf", "left_semi").drop("leaf")
    near = pinned(near)
    together = recordset.subtract(new, near).unionByName(near)
    changed = leaves(together, bits).select(F.lit(0).alias("level"), F.col("leaf").cast("bigint").alias("node_index"), "hash", F.col("n").cast("bigint").alias("n"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level") if bits else F.lit(0).alias("level")
    on_path = touched.select(steps, "leaf").select(
        "level", F.expr("shiftright(cast(leaf AS bigint), level) ^ 1").alias("node_index")
    ).distinct()
    beside = nodes.select(F.col("level").cast("int").alias("level"), F.col("node_index").cast("bigint").alias("node_index"), "hash", F.col("n").cast("bigint").alias("n")).join(
        F.broadcast(on_path), ["level", "node_index"], "left_semi"
    )
    rows = changed.withColumn("fresh", F.lit(True)).unionByName(beside.withColumn("fresh", F.lit(False)))
    walked = rows.repartition(1).mapInPandas(_walker(bits, empty_hashes(bits)), "level int, node_index bigint, hash string, n bigint")
    return walked.withColumn("version", F.lit(version))


def _walker(bits: int, empties: list[str]):
    """Hashes upwards from changed leaves; the other nodes given are siblings on their paths."""

    def walk(batches):
        import hashlib

        import pandas as pd

        own: dict[tuple[int, int], tuple[str, int]] = {}
        beside: dict[tuple[int, int], tuple[str, int]] = {}
        for batch in batches:
            for level, index, digest, n, fresh in batch[["level", "node_index", "hash", "n", "fresh"]].itertuples(index=False):
                (own if fresh else beside)[int(level), int(index)] = (digest, int(n))
        for level in range(1, bits + 1):
            for parent in {i >> 1 for at, i in own if at == level - 1}:
                pair = [own.get((level - 1, c)) or beside.get((level - 1, c)) or (empties[level - 1], 0) for c in (2 * parent, 2 * parent + 1)]
                digest = hashlib.sha256(f"node:{pair[0][0]}{pair[1][0]}".encode()).hexdigest()
                own[level, parent] = (digest, pair[0][1] + pair[1][1])
        out = [(level, i, digest, n) for (level, i), (digest, n) in own.items()]
        yield pd.DataFrame(out, columns=["level", "node_index", "hash", "n"])

    return walk


def nodes_as_of(versioned: DataFrame, version: int) -> DataFrame:
    """The newest stored hash of each node not after a version."""
    return (
        versioned.filter(F.col("version") <= version)
        .groupBy("level", "node_index")
        .agg(F.max_by(F.struct("hash", "n"), "version").alias("top"))
        .select("level", "node_index", "top.hash", "top.n")
    )


def check_snapshot(descs: DataFrame, claimed: DataFrame, bits: int) -> DataFrame:
    """Leaves and root recomputed against claimed nodes; differing nodes come out."""
    mine = tree(descs, bits).select("level", "node_index", F.col("hash").alias("actual"))
    return claimed.select("level", "node_index", F.col("hash").alias("claimed")).join(
        mine, ["level", "node_index"], "full_outer"
    ).filter(~F.col("claimed").eqNullSafe(F.col("actual")))


def node_hashes(nodes: DataFrame, refs: DataFrame, bits: int) -> DataFrame:
    """Hashes of asked (level, node_index); empty subtrees and bad references are told apart."""
    empties = F.array(*[F.lit(h) for h in empty_hashes(bits)])
    inside = F.col("level").between(0, bits) & (F.col("node_index") >= 0) & (
        F.col("node_index") < F.pow(F.lit(2), F.lit(bits) - F.col("level"))
    )
    return refs.join(nodes.select("level", "node_index", "hash"), ["level", "node_index"], "left").select(
        "level", "node_index",
        F.when(~inside, F.lit("out-of-range")).when(F.col("hash").isNull(), F.lit("empty")).otherwise(F.lit("found")).alias("status"),
        F.when(inside, F.coalesce("hash", F.get(empties, F.col("level")))).alias("hash"),
    )


def hot_leaves(leaf_rows: DataFrame, k: int) -> DataFrame:
    """The fullest leaves."""
    return leaf_rows.select("leaf", "n").orderBy(F.desc("n"), "leaf").limit(k)


def work_list(left_leaves: DataFrame, right_leaves: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The next differing leaves of a resumable reconciliation."""
    todo = mismatched_leaves(left_leaves, right_leaves).select("leaf").join(done.select("leaf"), "leaf", "left_anti")
    return todo.orderBy("leaf").limit(n)
