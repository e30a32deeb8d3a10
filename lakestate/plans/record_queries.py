"""Queries over keyed record sets and prefix trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestate.functions import values as vl
from lakestate.operators import merkle as mk
from lakestate.operators import opaque as op
from lakestate.operators import recordset as xs
from lakestate.plans.registry import query
from lakestate.sources.adapters import Lake
from lakestate.session import pinned

BITS = 12
SECRET = b"bench-secret"

DESC = """
    SELECT key, 'observation' AS kind, record_id, payload, sha256(payload) AS payload_digest, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
      sha256(CAST(to_json(['observation', record_id, sha256(payload), CAST(strlen(payload) AS VARCHAR)]) AS VARCHAR)) AS fingerprint,
      CAST('0x' || substr(sha256(key), 1, 4) AS INTEGER) >> (16 - {bits}) AS leaf, substr(sha256(key), 5, 2) AS strand
    FROM {source}"""


def _leaf_sql(source: str) -> str:
    return f"""
        SELECT leaf, sha256('leaf:' || string_agg(h, '' ORDER BY strand)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT leaf, strand, count(*) AS n, sha256(string_agg(fingerprint, '' ORDER BY key)) AS h FROM {source} GROUP BY 1, 2) GROUP BY 1"""


def _views(bits: int = BITS) -> dict[str, str]:
    return {
        "left_desc": DESC.format(bits=bits, source="left_records"),
        "right_desc": DESC.format(bits=bits, source="right_records"),
        "left_leaves": _leaf_sql("left_desc"),
        "right_leaves": _leaf_sql("right_desc"),
        "differences": """
            SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'local-only' WHEN a.key IS NULL THEN 'remote-only'
              ELSE 'collision' END AS status, coalesce(a.leaf, b.leaf) AS leaf
            FROM left_desc a FULL JOIN right_desc b ON a.key = b.key WHERE a.payload_digest IS DISTINCT FROM b.payload_digest""",
        "wrong_leaves": """
            SELECT coalesce(a.leaf, b.leaf) AS leaf FROM left_leaves a FULL JOIN right_leaves b ON a.leaf = b.leaf
            WHERE a.hash IS DISTINCT FROM b.hash""",
    }


def _tree_views(bits: int, source: str = "left_leaves", views: dict[str, str] | None = None) -> dict[str, str]:
    """Levels by repeated pairing, one statement per level."""
    out = dict(views or _views(bits))
    empties = mk.empty_hashes(bits)
    out["level_0"] = f"SELECT 0 AS level, CAST(leaf AS BIGINT) AS node_index, hash, n FROM {source}"
    for k in range(1, bits + 1):
        e = empties[k - 1]
        out[f"level_{k}"] = f"""
            SELECT {k} AS level, node_index >> 1 AS node_index,
              sha256('node:' || coalesce(max(hash) FILTER (node_index % 2 = 0), '{e}') || coalesce(max(hash) FILTER (node_index % 2 = 1), '{e}')) AS hash,
              CAST(sum(n) AS BIGINT) AS n FROM level_{k - 1} GROUP BY node_index >> 1"""
    out["nodes"] = " UNION ALL ".join(f"SELECT * FROM level_{k}" for k in range(bits + 1))
    return out


def _left(lake: Lake) -> DataFrame:
    return xs.records(lake.order_payloads("left"))


def _right(lake: Lake) -> DataFrame:
    return xs.records(lake.order_payloads("right"))


@query("record_build", "SELECT key, payload_digest, payload_bytes, fingerprint FROM left_desc", _views())
def record_build(lake: Lake) -> DataFrame:
    return _left(lake).select("key", "payload_digest", "payload_bytes", "fingerprint")


@query(
    "record_normalize",
    """SELECT key, min(payload_digest) AS payload_digest, count(*) AS copies,
         CASE WHEN count(DISTINCT payload_digest) > 1 THEN 'collision' END AS problem
       FROM (SELECT * FROM left_desc UNION ALL SELECT * FROM right_desc) GROUP BY 1""",
    _views(),
)
def record_normalize(lake: Lake) -> DataFrame:
    both = xs.descriptors(_left(lake)).unionByName(xs.descriptors(_right(lake)))
    return xs.normalize(both).select("key", "payload_digest", "copies", "problem")


@query(
    "record_verify",
    """SELECT key, unnest(['digest', 'size', 'fingerprint']) AS problem FROM left_desc WHERE payload LIKE '%"status":"P"}'
       AND strlen(payload) <> strlen(replace(payload, '"P"', '"PP"'))""",
    _views(),
)
def record_verify(lake: Lake) -> DataFrame:
    """Payloads of pending orders are altered after the fact and must be caught."""
    stale = xs.fingerprint(F.col("kind"), F.col("record_id"), F.col("payload_digest"), F.col("payload_bytes") + 1)
    pending = F.col("payload").contains('"status":"P"')
    tampered = _left(lake).withColumn("payload", F.replace("payload", F.lit('"P"'), F.lit('"PP"'))).withColumn(
        "fingerprint", F.when(pending | F.col("payload").contains('"PP"'), stale).otherwise(F.col("fingerprint"))
    )
    return xs.verify(tampered)


@query("record_diff", "SELECT key, status FROM differences", _views())
def record_diff(lake: Lake) -> DataFrame:
    return xs.diff(_left(lake), _right(lake))


@query("record_diff_summary", "SELECT status, count(*) AS n_keys FROM differences GROUP BY 1", _views())
def record_diff_summary(lake: Lake) -> DataFrame:
    return xs.diff_summary(xs.diff(_left(lake), _right(lake)))


@query(
    "record_merge",
    """SELECT key, min(fingerprint) AS fingerprint FROM (SELECT * FROM left_desc UNION ALL SELECT * FROM right_desc)
       GROUP BY 1 HAVING count(DISTINCT payload_digest) = 1""",
    _views(),
)
def record_merge(lake: Lake) -> DataFrame:
    return xs.merge([_left(lake), _right(lake)]).filter("problem IS NULL").select("key", "fingerprint")


@query(
    "records_by_keys",
    """SELECT r.key, CASE WHEN l.key IS NULL THEN 'missing' ELSE 'found' END AS status FROM right_desc r LEFT JOIN left_desc l USING (key)""",
    _views(),
)
def records_by_keys(lake: Lake) -> DataFrame:
    found, missing = xs.by_keys(_left(lake), _right(lake))
    return found.select("key", F.lit("found").alias("status")).unionByName(missing.withColumn("status", F.lit("missing")))


@query(
    "record_set_algebra",
    """SELECT 'both' AS part, count(*) AS n FROM left_desc WHERE key IN (SELECT key FROM right_desc)
       UNION ALL SELECT 'left', count(*) FROM left_desc WHERE key NOT IN (SELECT key FROM right_desc)
       UNION ALL SELECT 'right', count(*) FROM right_desc WHERE key NOT IN (SELECT key FROM left_desc)""",
    _views(),
)
def record_set_algebra(lake: Lake) -> DataFrame:
    left, right = _left(lake).select("key"), _right(lake).select("key")
    parts = {"both": xs.intersect(left, right), "left": xs.subtract(left, right), "right": xs.subtract(right, left)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "transfer_bytes",
    """SELECT CAST(sum(strlen('{"key":"' || key || '","kind":"observation","record_id":"' || record_id || '","payload_digest":"' || payload_digest
         || '","payload_bytes":' || payload_bytes || ',"fingerprint":"' || fingerprint || '","payload":"' || replace(payload, '"', '\\"') || '"}')) AS BIGINT) AS wire_bytes,
       count(*) AS n FROM left_desc""",
    _views(),
)
def transfer_bytes(lake: Lake) -> DataFrame:
    return xs.transfer_bytes(_left(lake)).agg(F.sum("wire_bytes").alias("wire_bytes"), F.count(F.lit(1)).alias("n"))


WIRE = """strlen('{"key":"' || key || '","kind":"observation","record_id":"' || record_id || '","payload_digest":"' || payload_digest
         || '","payload_bytes":' || payload_bytes || ',"fingerprint":"' || fingerprint || '","payload":"' || replace(payload, '"', '\\"') || '"}')"""


@query(
    "transfer_batches",
    """SELECT leaf, batch, n, wire_bytes, first_key, rule FROM (
         SELECT leaf, page AS batch, count(*) AS n, CAST(sum(b) AS BIGINT) AS wire_bytes, min(key) AS first_key, CAST(NULL AS VARCHAR) AS rule
         FROM folded WHERE key IS NOT NULL GROUP BY 1, 2
         UNION ALL SELECT leaf, NULL, 0, 0, key, 'collision' FROM both_desc GROUP BY leaf, key HAVING count(DISTINCT fingerprint) > 1)""",
    {
        **_views(8),
        "both_desc": "SELECT * FROM left_desc UNION ALL SELECT * FROM right_desc",
        "placed": f"""SELECT leaf, key, max(CAST({WIRE} AS BIGINT)) AS b, row_number() OVER (PARTITION BY leaf ORDER BY key) AS rn
            FROM both_desc GROUP BY leaf, key HAVING count(DISTINCT fingerprint) = 1""",
        "folded": """RECURSIVE
            SELECT DISTINCT leaf, CAST(0 AS BIGINT) AS rn, 0 AS page, 0 AS n, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS key FROM placed
            UNION ALL
            SELECT f.leaf, p.rn, CASE WHEN f.page > 0 AND f.n < 16 AND f.bytes + p.b <= 6000 THEN f.page ELSE f.page + 1 END,
              CASE WHEN f.page > 0 AND f.n < 16 AND f.bytes + p.b <= 6000 THEN f.n + 1 ELSE 1 END,
              CASE WHEN f.page > 0 AND f.n < 16 AND f.bytes + p.b <= 6000 THEN f.bytes + p.b ELSE p.b END, p.b, p.key
            FROM folded f JOIN placed p ON p.leaf = f.leaf AND p.rn = f.rn + 1""",
    },
)
def transfer_batches(lake: Lake) -> DataFrame:
    """Both replicas' records as batches per leaf; keys on which they disagree are refused."""
    both = _left(lake).unionByName(_right(lake)).withColumn("leaf", mk.leaf_id(F.col("key"), 8))
    return xs.transfer_batches(both, ["leaf"], 16, 6000).drop("last_key")


@query("merkle_leaves", "SELECT leaf, hash, n FROM left_leaves", _views())
def merkle_leaves(lake: Lake) -> DataFrame:
    return mk.leaves(_left(lake), BITS)


@query("merkle_tree", "SELECT level, node_index, hash, n FROM nodes", _tree_views(BITS))
def merkle_tree(lake: Lake) -> DataFrame:
    return mk.tree(_left(lake), BITS)


@query("inventory_root", f"SELECT hash, n FROM level_{16}", _tree_views(16))
def inventory_root(lake: Lake) -> DataFrame:
    return mk.root(mk.tree(_left(lake), 16), 16)


@query("merkle_levels", "SELECT level, node_index, hash, n FROM nodes", _tree_views(8))
def merkle_levels(lake: Lake) -> DataFrame:
    """Level by level, as an incremental add walks it."""
    out = None
    for part in mk.levels(pinned(mk.leaves(_left(lake), 8)), 8):
        out = part if out is None else out.unionByName(part)
    return out


@query("merkle_diff", "SELECT key, status FROM differences", _views())
def merkle_diff(lake: Lake) -> DataFrame:
    left, right = _left(lake), _right(lake)
    return mk.tree_diff(left, right, BITS, mk.leaves(left, BITS), mk.leaves(right, BITS))


@query(
    "merkle_diff_work",
    """SELECT count(DISTINCT leaf) AS n_leaves, count(*) AS n_descriptors,
         CAST(sum(strlen('{"key":"' || key || '","payload_digest":"' || payload_digest || '","fingerprint":"' || fingerprint
           || '","payload_bytes":' || payload_bytes || '}')) AS BIGINT) AS n_bytes
       FROM (SELECT * FROM left_desc UNION ALL SELECT * FROM right_desc) WHERE leaf IN (SELECT leaf FROM wrong_leaves)""",
    _views(),
)
def merkle_diff_work(lake: Lake) -> DataFrame:
    left, right = _left(lake), _right(lake)
    return mk.diff_work(left, right, BITS, mk.leaves(left, BITS), mk.leaves(right, BITS))


GROWN = {
    **_views(8),
    "grown": "SELECT * FROM left_desc UNION ALL SELECT * FROM right_desc WHERE key NOT IN (SELECT key FROM left_desc)",
    "left_leaves": _leaf_sql("grown"),
}


@query("merkle_incremental_add", "SELECT level, node_index, hash, n FROM nodes", _tree_views(8, views=GROWN))
def merkle_incremental_add(lake: Lake) -> DataFrame:
    """The stored tree of one replica, grown by the other's extra keys: newest versions."""
    old = _left(lake)
    extra = xs.subtract(_right(lake), old)
    stored = pinned(mk.tree(old, 8).withColumn("version", F.lit(1)))
    grown = mk.add(stored, xs.descriptors(old), xs.descriptors(extra), 8, 2)
    return mk.nodes_as_of(stored.unionByName(grown.select(*stored.columns)), 2)


@query("merkle_as_of_version", "SELECT level, node_index, hash, n FROM nodes", _tree_views(8))
def merkle_as_of_version(lake: Lake) -> DataFrame:
    """The grown tree read as of the version before it grew."""
    old = _left(lake)
    extra = xs.subtract(_right(lake), old)
    stored = pinned(mk.tree(old, 8).withColumn("version", F.lit(1)))
    grown = mk.add(stored, xs.descriptors(old), xs.descriptors(extra), 8, 2)
    return mk.nodes_as_of(stored.unionByName(grown.select(*stored.columns)), 1)


@query(
    "inventory_check",
    """SELECT a.level, a.node_index FROM nodes a WHERE a.level = 0 AND a.node_index IN (SELECT leaf FROM wrong_leaves)""",
    _tree_views(BITS),
)
def inventory_check(lake: Lake) -> DataFrame:
    """Claimed leaves of one replica that the other's records do not give."""
    claimed = pinned(mk.tree(_left(lake), BITS))
    wrong = mk.check_snapshot(_right(lake), claimed, BITS)
    return wrong.filter("level = 0 AND claimed IS NOT NULL").select("level", "node_index")


@query(
    "merkle_node_lookup",
    f"""SELECT r.level, r.node_index, CASE WHEN r.level > 8 THEN 'out-of-range' WHEN n.hash IS NULL THEN 'empty' ELSE 'found' END AS status
       FROM (SELECT DISTINCT CAST(c_custkey % 10 AS INTEGER) AS level, c_custkey % (1 << greatest(8 - CAST(c_custkey % 10 AS INTEGER), 0)) AS node_index FROM customer) r
       LEFT JOIN nodes n ON n.level = r.level AND n.node_index = r.node_index""",
    _tree_views(8),
)
def merkle_node_lookup(lake: Lake) -> DataFrame:
    """Many references at once; some name levels the tree does not have."""
    level = (F.col("c_custkey") % 10).cast("int")
    size = F.pow(F.lit(2), F.greatest(F.lit(8) - level, F.lit(0))).cast("bigint")
    refs = lake.table("customer").select(level.alias("level"), (F.col("c_custkey") % size).alias("node_index")).distinct()
    return mk.node_hashes(mk.tree(_left(lake), 8), refs, 8).select("level", "node_index", "status")


@query("hot_leaves", "SELECT leaf, n FROM left_leaves ORDER BY n DESC, leaf LIMIT 10", _views())
def hot_leaves(lake: Lake) -> DataFrame:
    return mk.hot_leaves(mk.leaves(_left(lake), BITS), 10)


@query(
    "reconciliation_work_list",
    """SELECT leaf FROM wrong_leaves WHERE leaf NOT IN (SELECT leaf FROM left_leaves WHERE n >= 4) ORDER BY leaf LIMIT 20""",
    _views(),
)
def reconciliation_work_list(lake: Lake) -> DataFrame:
    """Leaves left to do after those with four or more records are done: the next page."""
    left = pinned(mk.leaves(_left(lake), BITS))
    return mk.work_list(left, mk.leaves(_right(lake), BITS), left.filter("n >= 4"), 20)


@query(
    "record_export",
    """SELECT 'alias' AS kind, alias_id AS record_id, '{"alias_id":"' || alias_id || '","entity_id":"' || entity_id
         || '","evidence_refs":["name:' || entity_id || '"],"recorded_at":"' || CASE WHEN recorded_at = 631152000000 THEN '1990-01-01' ELSE '1999-06-01' END
         || 'T00:00:00.000Z","value":"' || value || '"}' AS payload FROM aliases
       UNION ALL SELECT 'entity', entity_id, '{"entity_id":"' || entity_id || '","entity_type":"' || entity_type || '"}' FROM entities""",
)
def record_export(lake: Lake) -> DataFrame:
    return xs.export({"entity": (lake.entities(), "entity_id"), "alias": (lake.aliases(), "alias_id")})


@query(
    "record_import",
    "SELECT alias_id, entity_id, value, recorded_at FROM aliases",
)
def record_import(lake: Lake) -> DataFrame:
    """Exported records, verified and read back as typed rows."""
    recs = xs.records(xs.export({"entity": (lake.entities(), "entity_id"), "alias": (lake.aliases(), "alias_id")}))
    rows = xs.imported(recs, "alias", "alias_id string, entity_id string, value string, recorded_at timestamp")
    return rows.filter("_corrupt IS NULL").select("alias_id", "entity_id", "value", F.unix_millis("recorded_at").alias("recorded_at"))


@query(
    "index_agreement",
    """SELECT 'order-' || o_orderkey AS record_id, 'status' AS "column" FROM orders WHERE day(o_orderdate) = 2 AND o_orderstatus <> 'X'""",
)
def index_agreement(lake: Lake) -> DataFrame:
    """Stored columns against the stored JSON, with one replica's edits as the fault."""
    rows = lake.order_payloads("left").join(
        lake.table("orders").select(
            F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("record_id"),
            F.when(F.dayofmonth("o_orderdate") == 2, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"),
            F.col("o_custkey").alias("customer"),
        ),
        "record_id",
    )
    return xs.disagreements(rows, "record_id", ["status", "customer"], "status string, customer bigint")


# -- opaque sets ------------------------------------------------------------------


def _hmac_sql(value: str, purpose: str) -> str:
    """HMAC-SHA256 written out: blob concatenation and two digests."""
    key = vl.epoch_key(SECRET, "e1").ljust(64, b"\x00")
    blob = lambda pad: "".join(f"\\x{b ^ pad:02X}" for b in key)
    message = f"""'["opaque","{purpose}","' || {value} || '"]'"""
    return f"sha256('{blob(0x5C)}'::BLOB || unhex(sha256('{blob(0x36)}'::BLOB || encode({message}))))"


OPAQUE = {
    **_views(),
    "left_tags": f"""
        SELECT {_hmac_sql('key', 'key')} AS opaque_key, {_hmac_sql('payload_digest', 'content')} AS content_tag,
          payload_bytes + 28 AS ciphertext_bytes, key FROM left_desc""",
}


@query("opaque_descriptors", "SELECT opaque_key, content_tag, ciphertext_bytes FROM left_tags", OPAQUE)
def opaque_descriptors(lake: Lake) -> DataFrame:
    return op.opaque(_left(lake), SECRET, "e1").select("opaque_key", "content_tag", "ciphertext_bytes")


@query("opaque_diff", "SELECT status, count(*) AS n_keys FROM differences GROUP BY 1", _views())
def opaque_diff(lake: Lake) -> DataFrame:
    """Tags alone give the same comparison as the plain records."""
    left, right = op.opaque(_left(lake), SECRET, "e1"), op.opaque(_right(lake), SECRET, "e1")
    return xs.diff_summary(op.diff(left, right))


@query("opaque_epoch_guard", "SELECT * FROM (VALUES ('e1', 'epoch-mismatch'), ('e2', 'epoch-mismatch')) t(key, status), (SELECT 1 FROM orders LIMIT 1)".replace("SELECT *", "SELECT key, status"))
def opaque_epoch_guard(lake: Lake) -> DataFrame:
    """Sets of different epochs are refused, not compared."""
    return op.diff(op.opaque(_left(lake), SECRET, "e1"), op.opaque(_right(lake), SECRET, "e2"))


@query("opaque_violations", "SELECT opaque_key, 'size' AS rule FROM left_tags WHERE ciphertext_bytes > 74", OPAQUE)
def opaque_violations(lake: Lake) -> DataFrame:
    return op.violations(op.opaque(_left(lake), SECRET, "e1"), 74)


@query(
    "opaque_order",
    """SELECT value, row_number() OVER (ORDER BY k) AS place FROM (
         SELECT DISTINCT p_brand AS value, translate(replace(p_brand, '#', '_'), '_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
           array_to_string(list_transform(range(64), lambda i: chr(CAST(48 + i AS INTEGER))), '')) AS k FROM part)""",
)
def opaque_order(lake: Lake) -> DataFrame:
    """The defined order of tags: signs, digits, lower case, upper case."""
    from pyspark.sql import Window

    tags = lake.table("part").select(F.col("p_brand").alias("value")).distinct()
    key = op.order_key(F.replace("value", F.lit("#"), F.lit("_")))
    return tags.select("value", F.row_number().over(Window.orderBy(key)).alias("place"))
