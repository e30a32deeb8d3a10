"""Streams whose memory is Spark's own state: keyed, versioned, read back as a table.

State lives in the RocksDB state store under the query's checkpoint, so the
work of a batch follows the keys that the batch touches, whatever came before,
and a batch that runs twice starts from the same version. What must happen
without new data hangs on event-time timers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakestate.functions.values import tuple_id
from lakestate.operators.ingest import RESOURCE
from lakestate.session import pinned

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> SparkSession:
    """State of streams started from here on goes to RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Slots(StatefulProcessor):
    """The open slots of one resource, and the changes it has had.

    Changes of a batch are taken in their order; one that came before is
    skipped. A slot's value that the next change does not keep is closed, a new
    one is opened; a delete closes all.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "change_id string", "ord bigint")
        self.open = handle.getMapState("open", "slot_key string, record_id string", "change_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # Every call to the state goes through a socket: the open slots are read once and only what a batch
        # leaves different is written. A resource without open slots and changes so far asks for neither.
        known = self.seen.exists()
        before = {tuple(slot): by[0] for slot, by in self.open.iterator()} if known else {}
        held, taken = dict(before), set()
        for change in sorted(rows, key=lambda r: r["ord"]):
            ident = change["change_id"]
            if ident in taken or (known and self.seen.containsKey((ident,))):
                continue
            taken.add(ident)
            self.seen.updateValue((ident,), (change["ord"],))
            now = {(s["slot_key"], s["record_id"]): s["value"] for s in change["slots"]}
            for slot in sorted(held.keys() - now.keys()):
                del held[slot]
                yield self._row(key, "closed", slot, None, change)
            for slot in sorted(now.keys() - held.keys()):
                held[slot] = ident
                yield self._row(key, "opened", slot, now[slot], change)
        for slot in before.keys() - held.keys():
            self.open.removeKey(slot)
        for slot, by in held.items():
            if before.get(slot) != by:
                self.open.updateValue(slot, (by,))

    @staticmethod
    def _row(key, event: str, slot: tuple, value, change: Row) -> Row:
        return Row(
            **dict(zip(RESOURCE, key, strict=True)), event=event, slot_key=slot[0], record_id=slot[1], value=value,
            change_id=change["change_id"], effective_at=change["effective_at"], recorded_at=change["recorded_at"],
        )

    def close(self) -> None:
        pass


EVENTS = (
    "source_key string, external_type string, external_id string, event string, slot_key string, record_id string, value string, "
    "change_id string, effective_at timestamp, recorded_at timestamp"
)


def slot_events(changes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """ST2, C1, C3, C4: slots ``opened`` and ``closed`` by the changes of a stream.

    Ids and values are made before the state is asked; a resource's changes of
    one batch (bounded by the source's files per batch) are sorted in its task.
    """
    options = F.array(*[F.struct(F.lit(slot).alias("slot_key"), F.expr(path).cast("string").alias("value")) for slot, path in fields.items()])
    present = F.when(F.col("kind") == "upsert", F.filter(options, lambda s: s["value"].isNotNull())).otherwise(F.filter(options, lambda s: F.lit(False)))

    def named(slot: Column) -> Column:
        ident = tuple_id("observation", *[F.col(c) for c in RESOURCE], slot["slot_key"], slot["value"])
        return F.struct(slot["slot_key"].alias("slot_key"), slot["value"].alias("value"), ident.alias("record_id"))

    rows = changes.select(
        *RESOURCE, "change_id", "ord", F.coalesce("effective_at", "recorded_at", "first_observed_at").alias("effective_at"),
        F.coalesce("recorded_at", "first_observed_at").alias("recorded_at"), F.transform(present, named).alias("slots"),
    )
    return rows.groupBy(*RESOURCE).transformWithState(Slots(), EVENTS, "Append", "None")


def slot_stream(spark: SparkSession, changes: DataFrame, fields: dict[str, str], out: str) -> StreamingQuery:
    """Slot events of all that has landed, as files under ``out``/events; a later run goes on from the state."""
    keep_state(spark)
    return (
        slot_events(changes, fields).writeStream.format("parquet").outputMode("append").option("path", f"{out}/events")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def retractions(events: DataFrame) -> DataFrame:
    """The retraction of each closed slot."""
    ident = tuple_id("retraction", *[F.col(c) for c in RESOURCE], F.col("slot_key"), F.col("record_id"), F.col("change_id"))
    return events.filter("event = 'closed'").select(
        ident.alias("retraction_id"), F.lit("observation").alias("target_kind"), F.col("record_id").alias("target_id"),
        F.col("effective_at").alias("effective_from"), "recorded_at", "change_id", *RESOURCE, "slot_key",
    )


def open_slots(spark: SparkSession, out: str) -> DataFrame:
    """The slots that are open now, read from the stream's state store."""
    state = keep_state(spark).read.format("statestore").option("stateVarName", "open").load(f"{out}/checkpoint")
    return state.select("key.*", "user_map_key.slot_key", "user_map_key.record_id", F.col("user_map_value.change_id").alias("opened_by"))


class Boundaries(StatefulProcessor):
    """The next boundary of one entity: its one timer is all that is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        latest = max(rows, key=lambda r: (r["at"], r["boundary"] is not None, r["boundary"] or datetime.min))
        due = None if latest["boundary"] is None else round(latest["boundary"].astimezone(UTC).timestamp() * 1000)
        # Every call to the state goes through a socket.
        held = [] if key[0] == TICK else list(self.handle.listTimers())
        for timer in held:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None and due not in held:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield Row(entity_id=key[0], due=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


#: Rows of ticks belong to no entity.
TICK = ""


def due_entities(heads: DataFrame, ticks: DataFrame) -> DataFrame:
    """ST3: ``entity_id`` and ``due`` (epoch ms) of entities whose boundary the clock has reached.

    ``heads`` (entity_id, boundary, at) say at which clock time a boundary was
    computed, a null one ends an older one; ``ticks`` (at) move the clock, with
    or without any row for an entity.
    """
    clock = ticks.select(F.lit(TICK).alias("entity_id"), F.lit(None).cast("timestamp").alias("boundary"), "at")
    rows = heads.select("entity_id", "boundary", "at").unionByName(clock).withWatermark("at", "0 seconds")
    return rows.groupBy("entity_id").transformWithState(Boundaries(), "entity_id string, due bigint", "Append", "EventTime")


def boundary_stream(
    spark: SparkSession, heads: DataFrame, ticks: DataFrame, refresh: Callable[[DataFrame, int], None], out: str
) -> StreamingQuery:
    """ST3, M6: calls ``refresh`` with the entities that have come due and the batch id.

    ``refresh`` may run twice with one id, so what it writes has to be named by it.
    """
    keep_state(spark)

    def each(batch: DataFrame, batch_id: int) -> None:
        # Written once: reading a batch twice would run its timers twice.
        refresh(pinned(batch.select("entity_id", F.timestamp_millis("due").alias("due"))), batch_id)

    return (
        due_entities(heads, ticks).writeStream.foreachBatch(each).outputMode("append")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
