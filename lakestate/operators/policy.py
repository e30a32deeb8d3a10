"""Who may see what: default deny, applied to rows before anything else reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.functions.ordering import with_sequence
from lakestate.functions.values import entity_refs, json_list
from lakestate.operators import identity as idn
from lakestate.operators import retrieve as rt
from lakestate.session import pinned

# Fixed value: the code of a refusal without a rule.
NO_RULE = "no-matching-policy-rule"


def normalize_principals(principals: DataFrame) -> DataFrame:
    """Trimmed subject; trimmed, distinct, sorted scopes."""
    scopes = F.filter(F.transform("scopes", lambda s: F.trim(s)), lambda s: s != "")
    return principals.select(F.trim("subject").alias("subject"), F.array_sort(F.array_distinct(scopes)).alias("scopes"))


def effects(grants: DataFrame, keys: list[str]) -> DataFrame:
    """One effect per key; a refusal beats a permission."""
    return grants.groupBy(*keys).agg(F.max((F.col("effect") == "deny").cast("int")).alias("__no")).select(
        *keys, F.when(F.col("__no") == 1, F.lit("deny")).otherwise(F.lit("allow")).alias("effect")
    )


def decide(requests: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    """A1: a decision for every request, refused where no rule matches."""
    return requests.join(effects(grants, keys), keys, "left").select(
        *requests.columns,
        F.coalesce("effect", F.lit("deny")).alias("outcome"),
        F.when(F.col("effect").isNull(), F.lit(NO_RULE)).when(F.col("effect") == "deny", F.lit("denied-by-rule")).alias("code"),
    )


def allowed(grants: DataFrame, keys: list[str]) -> DataFrame:
    return effects(grants, keys).filter("effect = 'allow'").drop("effect")


def visible_rows(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """A2: each row once per subject that may see its entity."""
    return rows.join(allowed(grants, ["subject", "entity_id"]), "entity_id")


def visible_edges(edges: DataFrame, grants: DataFrame) -> DataFrame:
    """A2: edges whose both ends the subject may see."""
    may = allowed(grants, ["subject", "entity_id"])
    start = edges.join(may.withColumnRenamed("entity_id", "from_id"), "from_id")
    return start.join(may.withColumnRenamed("entity_id", "to_id"), ["subject", "to_id"], "left_semi")


def hide_references(rows: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    """A3, A4: drop what names, anywhere inside its value, an entity the subject may not see.

    ``rows`` carry subject and value_json; with the keys of a conflict instead
    of a row, one hidden candidate hides the conflict.
    """
    refs = rows.select("subject", *keys, F.explode(entity_refs(F.col("value_json"))).alias("entity_ref")).distinct()
    may = allowed(grants, ["subject", "entity_id"]).withColumnRenamed("entity_id", "entity_ref")
    hidden = refs.join(may, ["subject", "entity_ref"], "left_anti").select("subject", *keys).distinct()
    return rows.join(hidden, ["subject", *keys], "left_anti")


def filter_evidence(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """A5: evidence of each record, reference by reference; records stay without any.

    ``records`` has (subject, record_id, ref) in long form.
    """
    may = allowed(provenance, ["subject", "ref"])
    seen = records.join(may, ["subject", "ref"], "left_semi").groupBy("subject", "record_id").agg(F.countDistinct("ref").alias("n_refs"))
    return records.select("subject", "record_id").distinct().join(seen, ["subject", "record_id"], "left").na.fill(0, ["n_refs"])


def derive_grants(fields: DataFrame, rules: DataFrame, possible: DataFrame) -> DataFrame:
    """Field grants limited to providers hold only if the property's trusted
    provider is listed, or, without a rule, every provider it can come from.

    fields(subject, entity_id, property, read, providers), rules as authority
    rules, possible(entity_id, property, provider).
    """
    key = ["entity_id", "property"]
    trusted = rules.select(*key, F.element_at("providers", 1).alias("trusted"))
    sources = possible.groupBy(*key).agg(F.collect_set("provider").alias("sources"))
    by_rule = F.array_contains("providers", F.col("trusted"))
    by_all = F.coalesce((F.size("sources") > 0) & (F.size(F.array_except("sources", "providers")) == 0), F.lit(False))
    holds = F.col("read") & (
        F.col("providers").isNull() | F.when(F.col("trusted").isNotNull(), by_rule).otherwise(by_all)
    )
    return fields.join(trusted, key, "left").join(sources, key, "left").select(
        "subject", *key, F.when(holds, F.lit("allow")).otherwise(F.lit("deny")).alias("effect")
    )


def project_bindings(bindings: DataFrame, field_grants: DataFrame) -> DataFrame:
    """Declared access and granted access, both needed."""
    may = field_grants.select(
        "subject", "entity_id", F.col("property").alias("canonical"), F.col("read").alias("may_read"), F.col("write").alias("may_write")
    )
    return bindings.join(may, ["entity_id", "canonical"]).select(
        "subject", "entity_id", "provider", "canonical",
        (F.col("readable") & F.col("may_read")).alias("readable"), (F.col("writable") & F.col("may_write")).alias("writable"),
    )


def replication_projection(descs: DataFrame, grants: DataFrame) -> DataFrame:
    """Descriptors each subject may replicate. Roots per subject come from the
    tree operators with ``subject`` as scope."""
    return descs.join(allowed(grants, ["subject", "entity_id"]), "entity_id")


#: Lanes of a set hash, 16 to each SHA-256.
LANES = 32


def visibility_classes(grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities by who may see them: (entity_id, class) and (class, subject).

    A class is the set of its readers, as the digest of a bitmap over numbered
    subjects, so there are as many classes as different sets, not as entities.
    """
    may = allowed(grants, ["subject", "entity_id"])
    numbers = may.select("subject").distinct().select("subject", F.xxhash64("subject").alias("number"))
    # Numbers are spread over few buckets of the bitmap by their rank, which is stable for a set of subjects.
    placed = with_sequence(numbers, ["number", "subject"], start=-1, name="rank").select("subject", "rank")
    bits = may.join(placed, "subject").groupBy("entity_id", F.bitmap_bucket_number("rank").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("rank")).alias("readers")
    )
    parts = F.sort_array(F.collect_list(F.struct("bucket", F.sha2("readers", 256).alias("digest"))))
    classes = bits.groupBy("entity_id").agg(F.sha2(F.to_json(parts), 256).alias("class"))
    classes = pinned(classes)
    # All members of a class have the same readers, so those of one tell.
    one = classes.groupBy("class").agg(F.min("entity_id").alias("entity_id"))
    return classes, one.join(may, "entity_id").select("class", "subject")


def set_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` the lanes of a homomorphic set hash over (key, fingerprint), and the count.

    A record's lanes are 16-bit parts of SHA-256 digests, added modulo 2^16: the
    hash of a union of disjoint sets is the sum of theirs, whatever the order.
    It tells replicas apart that differ by accident; LANES is too small to
    withstand someone who looks for colliding sets.
    """
    blocks = [F.sha2(F.concat_ws(":", F.lit(str(i)), "key", "fingerprint"), 256).alias(f"b{i}") for i in range(LANES // 16)]
    lane = lambda i: F.conv(F.substring(F.col(f"b{i // 16}"), 4 * (i % 16) + 1, 4), 16, 10).cast("bigint")
    wide = rows.select(*keys, *blocks).select(*keys, *[lane(i).alias(f"l{i}") for i in range(LANES)])
    return wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.pmod(F.sum(f"l{i}"), F.lit(65536)).alias(f"l{i}") for i in range(LANES)])


def reader_roots(descs: DataFrame, grants: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``subject``, ``n``, ``root`` (per ``scope`` too) of what each reader may replicate.

    Records are summed once per visibility class, and a reader's root adds the
    classes that the reader is in, so records are never multiplied by readers.
    """
    scope = scope or []
    classes, readers = visibility_classes(grants)
    by_class = set_hash(descs.join(classes, "entity_id"), ["class", *scope])
    total = by_class.join(readers, "class").groupBy("subject", *scope).agg(
        F.sum("n").alias("n"), *[F.pmod(F.sum(f"l{i}"), F.lit(65536)).alias(f"l{i}") for i in range(LANES)]
    )
    spelled = F.concat(*[F.lower(F.lpad(F.hex(f"l{i}"), 4, "0")) for i in range(LANES)])
    return total.select("subject", *scope, "n", F.sha2(spelled, 256).alias("root"))


def projection_accounting(scanned: DataFrame, shown: DataFrame) -> DataFrame:
    total = scanned.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return shown.groupBy("subject").agg(F.count(F.lit(1)).alias("n_allowed"), F.sum("payload_bytes").alias("bytes")).withColumn("n_scanned", total)


def transfer(requests: DataFrame, shown: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Asked keys re-checked; absent and refused look the same; ceilings per request."""
    got = requests.join(shown.select("subject", "key", "payload_bytes"), ["subject", "key"], "left")
    return got.groupBy("request_id", "subject").agg(
        F.count("payload_bytes").alias("n_found"), F.sum(F.col("payload_bytes").isNull().cast("bigint")).alias("n_unavailable"),
        F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes"),
    ).withColumn(
        "status",
        F.when(F.col("n_found") > max_records, F.lit("too-many-records")).when(F.col("bytes") > max_bytes, F.lit("too-many-bytes")).otherwise(F.lit("ok")),
    )


def blob_reads(requests: DataFrame, references: DataFrame, grants: DataFrame) -> DataFrame:
    """A10: a blob may be read when one record that points to it allows both the
    record and the blob. requests(subject, digest), references(digest, entity_id,
    record_id), grants(subject, entity_id, record_read, blob_read)."""
    seen = requests.join(references, "digest").join(grants, ["subject", "entity_id"], "left")
    both = F.coalesce(F.col("record_read") & F.col("blob_read"), F.lit(False))
    verdict = seen.groupBy("subject", "digest").agg(
        F.max(both.cast("int")).alias("ok"), F.min(F.when(both, F.col("record_id"))).alias("by_record"), F.count(F.lit(1)).alias("n_references")
    )
    return requests.distinct().join(verdict, ["subject", "digest"], "left").select(
        "subject", "digest", F.when(F.col("ok") == 1, F.lit("allow")).otherwise(F.lit("deny")).alias("outcome"),
        "by_record", F.coalesce("n_references", F.lit(0)).alias("n_references"),
    )


def apply_batches(records: DataFrame, grants: DataFrame) -> DataFrame:
    """A batch is accepted only if every record in it is. records(batch_id, subject, entity_id)."""
    checked = decide(records, grants, ["subject", "entity_id"])
    return checked.groupBy("batch_id", "subject").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum((F.col("outcome") == "deny").cast("bigint")).alias("n_denied")
    ).withColumn("outcome", F.when(F.col("n_denied") == 0, F.lit("allow")).otherwise(F.lit("deny")))


def visible_artifacts(versions: DataFrame, grants: DataFrame, max_bytes: int) -> DataFrame:
    """Present versions a subject may list, and whether they may be read whole."""
    return versions.filter("status = 'present'").join(allowed(grants, ["subject", "external_id"]), "external_id").withColumn(
        "read", F.when(F.col("blob_size") <= max_bytes, F.lit("ok")).otherwise(F.lit("too-large"))
    )


def audit_rows(decisions: DataFrame, operation: str, at: str) -> DataFrame:
    """What is logged of a decision: who, what, outcome, code; no content."""
    return decisions.select(
        F.lit(at).cast("timestamp").alias("at"), "subject", F.lit(operation).alias("operation"), "outcome", "code"
    )


def audit_rollup(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Allowed and refused per window, operation and code; batch or stream."""
    return events.groupBy(F.window("at", width).alias("w"), "operation", "outcome", "code").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), "operation", "outcome", "code", "n")


def relation_picks(direct: DataFrame, edges: DataFrame, words: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Per query the k edges whose type words and target names share most terms.

    direct(query_id, entity_id, text), edges(from_id, ...), words(relation_type,
    words), targets(entity_id, value).
    """
    names = targets.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("names"))
    said = F.concat_ws(" ", F.coalesce("words", "relation_type"), "names")
    text = edges.join(names.withColumnRenamed("entity_id", "to_id"), "to_id").join(words, "relation_type", "left").select(
        *edges.columns, tx.terms(tx.normalize(said)).alias("terms")
    )
    asked = direct.select("query_id", F.col("entity_id").alias("from_id"), tx.terms(tx.normalize(F.col("text"))).alias("asked"))
    scored = text.join(asked, "from_id").withColumn("score", F.size(F.array_intersect("asked", "terms"))).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "relation_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("asked", "terms")


def scan_limits(scanned: DataFrame, limit: int) -> DataFrame:
    """Queries that would look at more rows than allowed."""
    return scanned.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def secure_compile(queries: DataFrame, grants: DataFrame, index: DataFrame, entities: DataFrame, types: DataFrame, records: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every (subject, query): visible names only, then resolve, then rank
    the visible records of the resolved entity and fill the budget.

    Visibility comes first, so what a subject may not see cannot make a name
    ambiguous for them. Returns resolutions (with sanitised status) and picks.
    """
    may = allowed(grants, ["subject", "entity_id"])
    subjects = may.select("subject").distinct()
    hits = idn.score_candidates(queries, index, entities, types).select("query_id", "entity_id", "score").join(may, "entity_id")
    by_score = hits.groupBy("subject", "query_id", "score").agg(F.count(F.lit(1)).alias("tied"), F.min("entity_id").alias("entity_id"))
    top = by_score.groupBy("subject", "query_id").agg(F.max(F.struct("score", "tied", "entity_id")).alias("t"))
    resolution = pinned(
        top.select(
            "subject", "query_id", json_list("subject", "query_id").alias("ask_id"),
            F.when(F.col("t.tied") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")).alias("status"),
            F.when(F.col("t.tied") == 1, F.col("t.entity_id")).alias("entity_id"),
        )
    )
    asks = resolution.filter("status = 'resolved'").join(queries, "query_id").select(
        F.col("ask_id").alias("query_id"), "text", "budget_tokens", "entity_id", "subject"
    )
    shown = hide_references(records.join(asks.select("subject", "entity_id").distinct(), "entity_id"), grants, ["record_id"])
    cands = shown.join(asks.select("query_id", "subject", "entity_id"), ["subject", "entity_id"]).select("query_id", "record_id")
    docs = rt.searchable(records.select("record_id", "entity_id", "text"), names)
    ranked = rt.bm25_among(asks.select("query_id", "text"), docs, cands)
    return resolution, rt.fill_budget(ranked, asks.select("query_id", "budget_tokens"))
