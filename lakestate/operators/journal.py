"""Runtime journal and key registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_events(journal: DataFrame, runs: DataFrame) -> DataFrame:
    """The events of the asked runs."""
    return journal.join(runs.select("run_id").distinct(), "run_id", "left_semi")


def indeterminate(journal: DataFrame) -> DataFrame:
    """Mutations requested without any later word on them."""
    asked = journal.filter("type = 'mutation.requested'").groupBy("mutation_id").agg(F.min("occurred_at").alias("requested_at"))
    done = journal.filter(F.col("type").isin("mutation.applied", "mutation.failed")).select("mutation_id")
    return asked.join(done, "mutation_id", "left_anti")


def run_outcomes(journal: DataFrame) -> DataFrame:
    """Per run what was applied, what failed, how long it took."""
    flag = lambda t: F.sum((F.col("type") == t).cast("bigint"))
    return journal.groupBy("run_id").agg(
        flag("mutation.applied").alias("applied"), flag("mutation.failed").alias("failed"),
        flag("mutation.requested").alias("requested"),
        (F.unix_millis(F.max("occurred_at")) - F.unix_millis(F.min("occurred_at"))).alias("duration_ms"),
    ).withColumn(
        "outcome",
        F.when(F.col("failed") > 0, F.when(F.col("applied") > 0, F.lit("partial")).otherwise(F.lit("failed")))
        .when(F.col("applied") > 0, F.lit("applied")).otherwise(F.lit("noop")),
    )


def epoch_heads(epochs: DataFrame) -> DataFrame:
    """Per principal the epochs nobody succeeds; other than one head is corrupt."""
    followed = epochs.select("principal", F.col("predecessor_epoch_id").alias("epoch_id")).filter("epoch_id IS NOT NULL")
    heads = epochs.join(followed, ["principal", "epoch_id"], "left_anti")
    found = heads.groupBy("principal").agg(F.count(F.lit(1)).alias("n_heads"), F.min("epoch_id").alias("epoch_id"))
    everyone = epochs.select("principal").distinct()
    return everyone.join(found, "principal", "left").select(
        "principal", F.coalesce("n_heads", F.lit(0)).alias("n_heads"),
        F.when(F.col("n_heads") == 1, F.col("epoch_id")).alias("epoch_id"),
        F.when(F.col("n_heads") == 1, F.lit("active")).otherwise(F.lit("corrupt")).alias("status"),
    )


def grant_inventory(expected: DataFrame, grants: DataFrame) -> DataFrame:
    """Recipients without a grant, with several, or with one nobody expects."""
    key = ["epoch_id", "recipient"]
    held = grants.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*key, F.lit(True).alias("wanted")).distinct().join(held, key, "full_outer")
    return both.select(
        *key,
        F.when(F.col("wanted").isNull(), F.lit("unexpected")).when(F.col("n").isNull(), F.lit("missing")).when(F.col("n") > 1, F.lit("duplicate")).alias("rule"),
    ).filter("rule IS NOT NULL")


def active_recipients(bindings: DataFrame, devices: DataFrame, keys: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Bindings whose device and key are active, or whose recovery credential
    is active in the same generation."""
    by_device = (
        bindings.filter("subject_kind = 'device'")
        .join(devices.filter("status = 'active'").select("device_id"), "device_id", "left_semi")
        .join(keys.filter("status = 'active'").select("subject_key_id"), "subject_key_id", "left_semi")
    )
    live = recoveries.filter("status = 'active'").select("subject_key_id", F.col("generation").alias("recovery_generation"))
    by_recovery = bindings.filter("subject_kind = 'recovery'").join(live, ["subject_key_id", "recovery_generation"], "left_semi")
    return by_device.select("encryption_key_id").unionByName(by_recovery.select("encryption_key_id"))


def expired(rows: DataFrame, clock: str, at: Column) -> DataFrame:
    """Rows whose time is over."""
    return rows.filter(F.col(clock) <= at)


def replays(messages: DataFrame, key: str, clock: str) -> DataFrame:
    """Every delivery of a nonce after its first."""
    first = messages.groupBy(key).agg(F.min(F.struct(clock, "event_id")).alias("first"))
    return messages.join(first, key).filter(F.struct(clock, "event_id") > F.col("first")).select("event_id", key)


def epoch_violations(epochs: DataFrame) -> DataFrame:
    """V9: ids, clocks, predecessors and recipient snapshots of epoch records."""
    known = epochs.select(
        "principal", F.col("epoch_id").alias("predecessor_epoch_id"), F.col("created_at").alias("before"), F.lit(True).alias("found")
    )
    joined = epochs.join(known, ["principal", "predecessor_epoch_id"], "left")
    n = F.size("recipients")
    checks = F.array_compact(
        F.array(
            F.when(~F.col("epoch_id").rlike("^[a-z0-9-]+$"), F.lit("epoch-id")),
            F.when(F.col("predecessor_epoch_id") == F.col("epoch_id"), F.lit("self-predecessor")),
            F.when(F.col("predecessor_epoch_id").isNotNull() & F.col("found").isNull(), F.lit("unknown-predecessor")),
            F.when(F.col("created_at") < F.col("before"), F.lit("older-than-predecessor")),
            F.when(n == 0, F.lit("no-recipients")),
            F.when(n != F.size(F.array_distinct("recipients")), F.lit("repeated-recipient")),
        )
    )
    return joined.select("principal", "epoch_id", F.explode(checks).alias("rule"))
