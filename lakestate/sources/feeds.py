"""Landed feeds: change files, calendars, issue lists, manifests, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakestate.functions import text as tx
from lakestate.functions import values as vl
from lakestate.functions.ordering import as_of_lookup, with_ordinal
from lakestate.session import pinned

CHANGE_SCHEMA = (
    "source_key string, change_id string, external_type string, external_id string, kind string, effective_at timestamp, "
    "recorded_at timestamp, revision string, props string, event_type string, amount double, first_observed_at timestamp, ord bigint"
)
EVENT_SCHEMA = (
    "id string, status string, etag string, updated string, summary string, description string, location string, "
    "start struct<date:string,dateTime:string,timeZone:string>, `end` struct<date:string,dateTime:string,timeZone:string>, "
    "transparency string, visibility string, eventType string, recurrence array<string>, recurringEventId string, "
    "originalStartTime struct<date:string,dateTime:string,timeZone:string>, organizer struct<email:string,displayName:string,self:boolean>, "
    "attendees array<struct<email:string,displayName:string,responseStatus:string>>, iCalUID string, sequence int"
)


def read_source(spark: SparkSession, root: str, mode: str = "full"):
    """JSON-lines change files: all of them, or as a stream of new ones."""
    if mode == "incremental":
        return spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", "64").json(root)
    return spark.read.schema(CHANGE_SCHEMA).json(root)


def _bad_time(t: Column) -> Column:
    """A calendar time has exactly one of a day and an instant, and it parses."""
    return t.isNotNull() & (
        (t["date"].isNull() == t["dateTime"].isNull())
        | (t["date"].isNotNull() & t["date"].try_cast("date").isNull())
        | (t["dateTime"].isNotNull() & t["dateTime"].try_cast("timestamp").isNull())
    )


def calendar_changes(raw: DataFrame, calendar_id: str, incremental: bool) -> tuple[DataFrame, DataFrame]:
    """Raw event JSON as changes; a full read has no cancelled events, an
    incremental one turns them into deletes. Broken rows come out apart."""
    parsed = raw.select("body", F.from_json("body", EVENT_SCHEMA).alias("e"))
    e = F.col("e")
    rule = (
        F.when(F.coalesce(e["id"] == "", e["id"].isNull()), F.lit("id"))
        .when(_bad_time(e["start"]) | _bad_time(e["end"]), F.lit("time"))
        .when(e["updated"].isNotNull() & vl.parse_clock(e["updated"]).isNull(), F.lit("updated"))
    )
    marked = parsed.withColumn("rule", rule)
    gone = F.coalesce(e["status"] == "cancelled", F.lit(False))
    good = marked.filter("rule IS NULL")
    if not incremental:
        good = good.filter(~gone)
    version = F.coalesce(e["etag"], e["updated"], F.sha2("body", 256))
    changes = good.select(
        vl.tuple_id("calendar-change", F.lit(calendar_id), e["id"], version).alias("change_id"),
        F.lit("calendar-event").alias("external_type"), e["id"].alias("external_id"),
        F.when(gone, F.lit("delete")).otherwise(F.lit("upsert")).alias("kind"),
        vl.parse_clock(e["updated"]).alias("recorded_at"), version.alias("revision"), "e",
    )
    return changes, marked.filter("rule IS NOT NULL").select("body", "rule")


def calendar_slots(changes: DataFrame, private: bool = False) -> DataFrame:
    """Up to eighteen named slots per upsert; private columns only when asked for."""
    e = F.col("e")
    text = lambda c: F.when(c.isNotNull(), vl.json_string(c))
    part = lambda c: F.when(c.isNotNull(), F.to_json(c))
    zones = F.struct(e["start"]["timeZone"].alias("start"), e["end"]["timeZone"].alias("end"))
    has_zone = F.coalesce(e["start"]["timeZone"], e["end"]["timeZone"]).isNotNull()
    slots = {
        "status": text(e["status"]), "summary": text(e["summary"]), "start": part(e["start"]), "end": part(e["end"]),
        "allDay": F.when(e["start"].isNotNull(), F.when(e["start"]["date"].isNotNull(), F.lit("true")).otherwise(F.lit("false"))),
        "timeZones": F.when(has_zone, F.to_json(zones)), "transparency": text(e["transparency"]), "visibility": text(e["visibility"]),
        "eventType": text(e["eventType"]), "recurrence": part(e["recurrence"]), "recurringEventId": text(e["recurringEventId"]),
        "originalStartTime": part(e["originalStartTime"]), "iCalUID": text(e["iCalUID"]), "sequence": e["sequence"].cast("string"),
    }
    if private:
        slots |= {
            "description": text(e["description"]), "location": text(e["location"]), "organizer": part(e["organizer"]),
            "attendees": F.when(e["attendees"].isNotNull(), F.to_json(F.array_sort(e["attendees"]))),
        }
    each = F.array(*[F.struct(F.lit(k).alias("slot_key"), v.alias("value_json")) for k, v in slots.items()])
    return changes.filter("kind = 'upsert'").select("external_id", "revision", F.explode(each).alias("s")).select(
        "external_id", "s.slot_key", F.concat(F.lit("CalendarEvent."), F.col("s.slot_key")).alias("property"), "s.value_json",
        vl.tuple_id("calendar-observation", F.col("external_id"), F.col("s.slot_key"), F.col("revision")).alias("observation_id"),
    ).filter("value_json IS NOT NULL")


def repo_items(raw: DataFrame, window: int) -> DataFrame:
    """Issues (not pull requests) of well-formed projects, newest first, the first few marked."""
    good = raw.filter(F.col("project").rlike(r"^[A-Za-z0-9][A-Za-z0-9-]*/[A-Za-z0-9._-]+$")).filter(
        F.get_json_object("body", "$.pull_request").isNull()
    )
    rows = good.select(
        "project", F.get_json_object("body", "$.number").cast("bigint").alias("number"),
        tx.scrub(F.get_json_object("body", "$.title")).alias("title"),
    )
    order = Window.partitionBy("project").orderBy(F.desc("number"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= window)


def manifest_fields(raw: DataFrame) -> DataFrame:
    """One row per (manifest, type, field) with its access flags."""
    schema = (
        "id string, capabilities array<string>, entities array<struct<canonicalType:string,externalType:string,"
        "fields:array<struct<canonical:string,external:string,access:array<string>>>>>"
    )
    m = raw.select(F.from_json("body", schema).alias("m"))
    types = m.select("m.id", "m.capabilities", F.explode("m.entities").alias("t"))
    return types.select("id", "capabilities", "t.canonicalType", "t.externalType", F.explode("t.fields").alias("f")).select(
        "id", "canonicalType", "externalType", "f.canonical", "f.external", "f.access", "capabilities"
    )


def manifest_violations(fields: DataFrame) -> DataFrame:
    """Repeated names within a type, access beyond the capabilities."""
    def repeated(column: str) -> DataFrame:
        return fields.groupBy("id", "canonicalType", column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            "id", F.col(column).alias("field"), F.lit(f"repeated-{column}").alias("rule")
        )

    beyond = fields.filter(F.size(F.array_except("access", "capabilities")) > 0).select("id", F.col("canonical").alias("field"), F.lit("access").alias("rule"))
    return repeated("canonical").unionByName(repeated("external")).unionByName(beyond)


def keyset_page(df: DataFrame, key: str, after: str, n: int) -> DataFrame:
    """The next page of a catalog, one row more than asked to tell whether it goes on."""
    return df.filter(F.col(key) > after).orderBy(key).limit(n + 1)


#: A round of doubling keeps the rows up to so many steps on: a power of two.
HOPS = 8


def _hops(step: DataFrame, scope: list[str]) -> DataFrame:
    """From one step (``__at``, ``__n1``) to the positions after 1 to ``HOPS`` steps, null beyond the end."""
    width = 1
    while width < HOPS:
        end = f"__n{width}"
        after = step.select(*scope, F.col("__at").alias(end), *[F.col(f"__n{i}").alias(f"__n{i + width}") for i in range(1, width + 1)])
        step, width = step.join(after, [*scope, end], "left"), 2 * width
    return step


def byte_bounded_pages(df: DataFrame, scope: list[str], key: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """A page number for every row: pages of a scope are filled in key order up to
    a row and a byte limit; a row above the limit has a page of its own. A scope may hold any
    share of the rows, as nothing is gathered by scope.

    Where the page that begins at a row would end follows from running sums. Which
    rows do begin one is found by doubling: the row 1, 2, 4, ... pages on, by a self-join on
    positions each time, in as many joins as the logarithm of the largest scope's
    pages; rows whose scope ends before that leave. A page's number is the sum of the steps
    taken to its first row. Null sizes count as zero; keys are unique within a scope.
    """
    sized = df.select(*scope, key, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("__size"))
    placed = pinned(with_ordinal(sized, scope, [key], "__at", {"__size": "__upto"}))
    # A row always has room for itself, so each finds a last row.
    room = F.greatest(F.col("__upto") - F.col("__size") + max_bytes, F.col("__upto"))
    ends = placed.groupBy(*scope, "__upto").agg(F.max("__at").alias("__last"))
    fits = as_of_lookup(placed.select(*scope, "__at", room.alias("__room"), (F.col("__size") > max_bytes).alias("__large")), ends, scope, "__room", "__upto")
    last = F.when(F.col("__large"), F.col("__at")).otherwise(F.least(F.col("__last"), F.col("__at") + (max_rows - 1)))
    step = fits.select(*scope, "__at", (last + 1).alias("__n1"))
    hops = [pinned(_hops(pinned(step), scope))]
    while not (far := hops[-1].filter(F.col(f"__n{HOPS}").isNotNull())).isEmpty():
        hops.append(pinned(_hops(far.select(*scope, "__at", F.col(f"__n{HOPS}").alias("__n1")), scope)))
    starts = placed.filter("__at = 1").select(*scope, "__at", F.lit(1).alias("page"))
    for k in range(len(hops) - 1, -1, -1):
        steps = [F.when(F.col(f"__n{i}").isNotNull(), F.struct(F.col(f"__n{i}").alias("__at"), (F.col("page") + i * HOPS**k).alias("page"))) for i in range(1, HOPS)]
        reached = F.explode(F.array_compact(F.array(F.struct("__at", "page"), *steps))).alias("__start")
        starts = starts.join(hops[k], [*scope, "__at"], "left").select(*scope, reached).select(*scope, "__start.*")
    members = starts.join(hops[0], [*scope, "__at"]).select(
        *scope, "page", F.explode(F.sequence(F.col("__at"), F.col("__n1") - 1)).alias("__at")
    )
    return placed.join(members, [*scope, "__at"]).select(*scope, key, "page")
