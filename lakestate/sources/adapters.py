"""The given tables in the shape of the engine's own tables.

Pure expressions over whole tables; nothing here triggers an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestate.session import prepare

DAY = "INTERVAL 1 DAY"

OBSERVATION_COLUMNS = [
    "observation_id", "entity_id", "property", "value_json", "provider",
    "external_id", "revision", "valid_from", "valid_to", "recorded_at",
]

# Configuration tables: fixed values, a handful of rows each.
ENTITY_TYPES = [
    ("Customer", ["customer", "client"]),
    ("Supplier", ["supplier", "vendor"]),
    ("Part", ["part", "article"]),
    ("Nation", ["nation", "country"]),
    ("Region", ["region"]),
    ("User", ["user", "account"]),
]
RELATION_TYPES = [
    ("A", ["accepted delivery of", "delivers"]),
    ("N", ["newly offers", "offers"]),
    ("R", ["returned delivery of", "returns"]),
    ("located-in", ["located in", "lies in"]),
]
PROPERTY_DESCRIPTORS = [
    ("Customer.lastOrderStatus", ["order state", "status"]),
    ("Customer.spendBand", ["spending", "band"]),
    ("User.purchase", ["bought", "purchase"]),
]
CONTEXT_KINDS = ["state", "decision", "commitment", "relationship", "event", "artifact"]


#: Size of a table's rows in memory, as a multiple of its file.
ROWS_TO_FILE = "10.0"


def _ts(name: str) -> Column:
    return F.date_trunc("millisecond", F.col(name).cast("timestamp"))


def _days(ts: Column, n: int) -> Column:
    return ts + F.expr(f"INTERVAL {n} DAYS")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# Schemas of the given tables, declared so that no read infers one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Lake:
    """Lazy tables over one folder of the given Parquet files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        # A Parquet file's rows take many times its size in memory, and most tables here are exploded or
        # given long ids besides. Joins planned on file sizes would send millions of rows through the driver.
        self.spark.conf.set("spark.sql.sources.fileCompressionFactor", ROWS_TO_FILE)
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """The given table, scanned as its files are split."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    # -- bitemporal records ------------------------------------------------

    def order_observations(self) -> DataFrame:
        """Two properties per order, exploded in one scan of the table."""
        o = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
            F.substring("o_orderpriority", 1, 1).alias("prio"), _ts("o_orderdate").alias("day"),
        )
        key = F.col("o_orderkey").cast("string")
        facts = F.array(
            F.struct(
                F.concat(F.lit("order-"), key).alias("observation_id"),
                F.lit("Customer.lastOrderStatus").alias("property"),
                F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')).alias("value_json"),
            ),
            F.struct(
                F.concat(F.lit("spend-"), key).alias("observation_id"),
                F.lit("Customer.spendBand").alias("property"),
                F.floor(F.col("o_totalprice") / 100000).cast("string").alias("value_json"),
            ),
        )
        return o.withColumn("fact", F.explode(facts)).select(
            "fact.observation_id",
            F.concat(F.lit("entity://customer/"), F.col("o_custkey").cast("string")).alias("entity_id"),
            "fact.property",
            "fact.value_json",
            F.concat(F.lit("p"), F.col("prio")).alias("provider"),
            key.alias("external_id"),
            _null("string").alias("revision"),
            F.col("day").alias("valid_from"),
            F.when(F.col("o_orderstatus") == "P", _days(F.col("day"), 120)).alias("valid_to"),
            F.date_trunc("quarter", "day").alias("recorded_at"),
        )

    def event_observations(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("observation_id"),
            F.concat(F.lit("entity://user/"), F.col("user_id").cast("string")).alias("entity_id"),
            F.concat(F.lit("User."), F.col("event_type")).alias("property"),
            F.col("props").alias("value_json"),
            F.concat(F.lit("s"), (F.hour("ts") % 4).cast("string")).alias("provider"),
            F.col("event_id").cast("string").alias("external_id"),
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("revision"),
            F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("valid_from"),
            _null("timestamp").alias("valid_to"),
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("recorded_at"),
        )

    def observations(self) -> DataFrame:
        return self.order_observations().unionByName(self.event_observations())

    def returned_lines(self) -> DataFrame:
        """The earliest returned, finished line of every order that has one, by ship date."""
        lines = self.table("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        first = F.min(F.struct("l_shipdate", "l_linenumber")).alias("first")
        return lines.groupBy("l_orderkey").agg(first).select("l_orderkey", "first.l_linenumber", "first.l_shipdate")

    def retractions(self) -> DataFrame:
        """A returned line ends what its order said about the customer."""
        day = _ts("l_shipdate")
        ident = F.concat_ws(
            "-", F.lit("return"), "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")
        )
        both = F.explode(F.array(F.lit("order-"), F.lit("spend-")))
        return self.returned_lines().withColumn("prefix", both).select(
            F.concat(ident, F.lit("/"), F.col("prefix")).alias("retraction_id"),
            F.lit("observation").alias("target_kind"),
            F.concat("prefix", F.col("l_orderkey").cast("string")).alias("target_id"),
            day.alias("effective_from"),
            _days(day, 15).alias("recorded_at"),
            F.lit("returns").alias("provider"),
            F.col("l_orderkey").cast("string").alias("external_id"),
            _null("string").alias("revision"),
            F.array(ident).alias("evidence_refs"),
        )

    def supplier_part_relations(self) -> DataFrame:
        day = _ts("l_shipdate")
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]
        return self.table("lineitem").select(*keys).distinct().select(
            F.concat_ws(
                "-", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd"),
            ).alias("relation_id"),
            F.concat(F.lit("entity://supplier/"), F.col("l_suppkey").cast("string")).alias("from_id"),
            F.concat(F.lit("entity://part/"), F.col("l_partkey").cast("string")).alias("to_id"),
            F.col("l_returnflag").alias("relation_type"),
            day.alias("valid_from"),
            _days(day, 60).alias("valid_to"),
            _days(day, 2).alias("recorded_at"),
        )

    def place_relations(self) -> DataFrame:
        start = F.lit("1990-01-01 00:00:00").cast("timestamp")

        def located(df: DataFrame, kind: str, key: str, target: str, to: str) -> DataFrame:
            return df.select(
                F.concat_ws("-", F.lit(f"place-{kind}"), F.col(key)).alias("relation_id"),
                F.concat(F.lit(f"entity://{kind}/"), F.col(key).cast("string")).alias("from_id"),
                F.concat(F.lit(f"entity://{to}/"), F.col(target).cast("string")).alias("to_id"),
                F.lit("located-in").alias("relation_type"),
                start.alias("valid_from"),
                _null("timestamp").alias("valid_to"),
                start.alias("recorded_at"),
            )

        return (
            located(self.table("customer"), "customer", "c_custkey", "c_nationkey", "nation")
            .unionByName(located(self.table("supplier"), "supplier", "s_suppkey", "s_nationkey", "nation"))
            .unionByName(located(self.table("nation"), "nation", "n_nationkey", "n_regionkey", "region"))
        )

    def relations(self) -> DataFrame:
        return (
            self.supplier_part_relations()
            .unionByName(self.place_relations())
            .withColumn("evidence_refs", F.array("relation_id"))
        )

    def relation_retractions(self) -> DataFrame:
        """A returned line ends its delivery."""
        day = _ts("l_shipdate")
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]
        lines = self.table("lineitem").filter(F.col("l_returnflag") == "R").select(*keys).distinct()
        ident = F.concat_ws(
            "-", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd"),
        )
        return lines.select(
            F.concat(F.lit("end-"), ident).alias("retraction_id"),
            F.lit("relation").alias("target_kind"),
            ident.alias("target_id"),
            _days(day, 20).alias("effective_from"),
            _days(day, 25).alias("recorded_at"),
            F.lit("returns").alias("provider"),
            F.col("l_orderkey").cast("string").alias("external_id"),
            _null("string").alias("revision"),
            F.array(ident).alias("evidence_refs"),
        )

    def authority_rules(self) -> DataFrame:
        """Two market segments trust named providers, in order; others the freshest."""
        provider_lists = F.when(
            F.col("c_mktsegment") == "BUILDING", F.array(F.lit("p1"), F.lit("p2"))
        ).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("p5")))
        return (
            self.table("customer")
            .filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
            .select(
                F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"),
                F.lit("Customer.lastOrderStatus").alias("property"),
                F.lit("provider").alias("kind"),
                provider_lists.alias("providers"),
            )
        )

    # -- identity ----------------------------------------------------------

    def named(self) -> DataFrame:
        """One row per (entity, alias): the names the given tables carry."""

        def names(table: str, kind: str, key: str, *aliases: Column) -> DataFrame:
            return self.table(table).select(
                F.concat(F.lit(f"entity://{kind}/"), F.col(key).cast("string")).alias("entity_id"),
                F.lit(kind.capitalize()).alias("entity_type"),
                F.posexplode(F.array(*aliases)).alias("n", "value"),
            )

        return (
            names("customer", "customer", "c_custkey", F.col("c_name"))
            .unionByName(names("supplier", "supplier", "s_suppkey", F.col("s_name")))
            .unionByName(names("nation", "nation", "n_nationkey", F.col("n_name")))
            .unionByName(names("region", "region", "r_regionkey", F.col("r_name")))
            .unionByName(
                names("part", "part", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name"))
            )
        )

    def user_ids(self) -> DataFrame:
        return self.table("events").select("user_id").distinct()

    def entities(self) -> DataFrame:
        users = self.user_ids().select(
            F.concat(F.lit("entity://user/"), F.col("user_id").cast("string")).alias("entity_id"),
            F.lit("User").alias("entity_type"),
        )
        return self.named().filter("n = 0").select("entity_id", "entity_type").unionByName(users)

    def aliases(self) -> DataFrame:
        users = self.user_ids().select(
            F.concat(F.lit("entity://user/"), F.col("user_id").cast("string")).alias("entity_id"),
            F.lit(0).alias("n"),
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("value"),
        )
        rows = self.named().select("entity_id", "n", "value").unionByName(users)
        recorded = F.when(F.col("n") == 0, F.lit("1990-01-01")).otherwise(F.lit("1999-06-01"))
        return rows.select(
            F.concat(F.lit("alias-"), F.col("n").cast("string"), F.lit("-"), F.col("entity_id")).alias("alias_id"),
            "entity_id",
            "value",
            recorded.cast("timestamp").alias("recorded_at"),
            F.array(F.concat(F.lit("name:"), F.col("entity_id"))).alias("evidence_refs"),
        )

    def entity_types(self) -> DataFrame:
        return self.spark.createDataFrame(ENTITY_TYPES, "type_id string, aliases array<string>")

    def relation_types(self) -> DataFrame:
        return self.spark.createDataFrame(RELATION_TYPES, "type_id string, aliases array<string>")

    def property_descriptors(self) -> DataFrame:
        return self.spark.createDataFrame(PROPERTY_DESCRIPTORS, "property string, aliases array<string>")

    def identity_queries(self) -> DataFrame:
        """One question per supplier, per nation, per distinct part name and per customer."""
        s = self.table("supplier").select(
            F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("query_id"),
            F.concat(
                F.lit("Which widget or ring deliveries has the vendor "), F.col("s_name"),
                F.lit(" returned, and who offers them?"),
            ).alias("text"),
        )
        n = self.table("nation").select(
            F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("query_id"),
            F.concat(F.lit("order status of "), F.col("n_name"), F.lit(" (country) today")).alias("text"),
        )
        p = self.table("part").groupBy("p_name").agg(F.min("p_brand").alias("brand")).select(
            F.concat(F.lit("p-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("query_id"),
            F.concat(F.lit("Price of the article "), F.col("brand"), F.lit(" "), F.col("p_name")).alias("text"),
        )
        c = self.table("customer").select(
            F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("query_id"),
            F.concat(F.lit("spending and order status for "), F.col("c_name")).alias("text"),
        )
        return s.unionByName(n).unionByName(p).unionByName(c)

    # -- retrieval ---------------------------------------------------------

    def context_records(self) -> DataFrame:
        """Documents (entity = source) and conversation turns (entity = conversation)."""
        labels = self.table("labels")
        kinds = F.array(*[F.lit(k) for k in CONTEXT_KINDS])
        number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
        docs = self.table("documents").join(labels, "doc_id", "left").select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record_id"),
            F.concat(F.lit("entity://source/"), F.col("source")).alias("entity_id"),
            F.element_at(kinds, number % len(CONTEXT_KINDS) + 1).alias("kind"),
            "text",
            F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("current"),
            F.when(F.col("quality") == 1, F.lit(1.0)).when(F.col("quality") == 0, F.lit(0.2)).alias("importance"),
        )
        turns = self.table("conversations").select(
            F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("record_id"),
            F.concat(F.lit("entity://conversation/"), F.col("conv_id").cast("string")).alias("entity_id"),
            F.when(F.col("role") == "user", F.lit("commitment"))
            .when(F.col("role") == "assistant", F.lit("decision"))
            .otherwise(F.lit("event")).alias("kind"),
            "text",
            (F.col("turn") > 0).alias("current"),
            _null("double").alias("importance"),
        )
        return docs.unionByName(turns)

    def context_entities(self) -> DataFrame:
        """Names of the record owners (sources and conversations)."""
        src = self.table("documents").select("source").distinct().select(
            F.concat(F.lit("entity://source/"), F.col("source")).alias("entity_id"),
            F.concat(F.lit("Source "), F.col("source")).alias("value"),
        )
        conv = self.table("conversations").select("conv_id").distinct().select(
            F.concat(F.lit("entity://conversation/"), F.col("conv_id").cast("string")).alias("entity_id"),
            F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("value"),
        )
        return src.unionByName(conv)

    def text_queries(self) -> DataFrame:
        """Benchmark passages as queries; even word counts get the larger budget."""
        return self.table("benchmark").select(
            F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("query_id"),
            "text",
            F.lit(1200).alias("budget_tokens"),
        )

    def source_queries(self) -> DataFrame:
        """One question per document source, naming it."""
        return self.table("documents").groupBy("source").agg(F.min("lang").alias("lang")).select(
            F.concat(F.lit("q-"), F.col("source")).alias("query_id"),
            F.concat(
                F.lit("What is current in source "), F.col("source"),
                F.lit(" about the and of der die les que?"),
            ).alias("text"),
            F.lit(3000).alias("budget_tokens"),
        )

    # -- feeds, artifacts, record sets -------------------------------------

    def source_changes(self) -> DataFrame:
        """Events as a change feed of user resources; errors delete the resource."""
        ts = _ts("ts")
        return self.table("events").select(
            F.lit("crm").alias("source_key"),
            F.concat(F.lit("chg-"), F.col("event_id").cast("string")).alias("change_id"),
            F.lit("user").alias("external_type"),
            F.col("user_id").cast("string").alias("external_id"),
            F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("upsert")).alias("kind"),
            F.when(F.col("event_type") != "view", ts).alias("effective_at"),
            F.when(F.col("event_type") != "click", ts + F.expr("INTERVAL 5 MINUTES")).alias("recorded_at"),
            _null("string").alias("revision"),
            "props",
            "event_type",
            F.col("value").alias("amount"),
            ts.alias("first_observed_at"),
            F.col("event_id").alias("ord"),
        )

    def artifact_mutations(self) -> DataFrame:
        """Pages as versions of their host; feed links are deletions."""
        host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
        gone = F.col("url").contains("utm_source=feed")
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")
        effective = base + F.make_interval(days=F.col("page_id").cast("int"))
        return self.table("pages").select(
            F.concat(F.lit("mut-"), F.col("page_id").cast("string")).alias("mutation_id"),
            F.lit("web").alias("source_key"),
            F.lit("page").alias("external_type"),
            host.alias("external_id"),
            F.when(gone, F.lit("delete")).otherwise(F.lit("upsert")).alias("kind"),
            effective.alias("effective_at"),
            (effective + F.expr("INTERVAL 2 DAYS")).alias("recorded_at"),
            F.col("page_id").cast("string").alias("revision"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.col("url").alias("source_uri"),
            F.when(~gone, F.sha2("html", 256)).alias("blob_digest"),
            F.when(~gone, F.octet_length("html").cast("bigint")).alias("blob_size"),
            F.when(~gone, F.lit("text/html")).alias("media_type"),
        )

    def page_bytes(self) -> DataFrame:
        return self.table("pages").select(
            F.encode("html", "UTF-8").alias("bytes"), F.lit("text/html").alias("media_type"), "page_id"
        )

    def order_payloads(self, replica: str = "left") -> DataFrame:
        """Orders as keyed records. The right replica lacks the first days of a
        month, differs on second days and has extra rows for third days."""
        o = self.table("orders")
        status = F.col("o_orderstatus")
        suffix = F.lit("")
        if replica == "right":
            o = o.filter(F.dayofmonth("o_orderdate") != 1)
            status = F.when(F.dayofmonth("o_orderdate") == 2, F.lit("X")).otherwise(status)
            copies = F.when(F.dayofmonth("o_orderdate") == 3, F.array(F.lit(""), F.lit("/copy"))).otherwise(
                F.array(F.lit(""))
            )
            o = o.withColumn("suffix", F.explode(copies))
            suffix = F.col("suffix")
        ident = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), suffix)
        payload = F.concat(
            F.lit('{"customer":'), F.col("o_custkey").cast("string"), F.lit(',"id":"'), ident,
            F.lit('","status":"'), status, F.lit('"}'),
        )
        return o.select(F.lit("observation").alias("kind"), ident.alias("record_id"), payload.alias("payload"))

    def journal_events(self) -> DataFrame:
        """Events as a runtime journal: one run per user."""
        mapped = (
            F.when(F.col("event_type") == "signup", F.lit("run.started"))
            .when(F.col("event_type") == "view", F.lit("mutation.requested"))
            .when(F.col("event_type") == "click", F.lit("mutation.applied"))
            .when(F.col("event_type") == "error", F.lit("mutation.failed"))
            .otherwise(F.lit("run.finished"))
        )
        return self.table("events").select(
            F.concat(F.lit("j-"), F.col("event_id").cast("string")).alias("event_id"),
            F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
            F.concat(F.lit("entity://user/"), F.col("user_id").cast("string")).alias("entity_id"),
            mapped.alias("type"),
            _ts("ts").alias("occurred_at"),
            F.concat(F.lit("svc-"), (F.hour("ts") % 3).cast("string")).alias("actor_subject"),
            F.concat_ws(":", F.col("user_id"), F.get_json_object("props", "$.k")).alias("mutation_id"),
            F.col("props").alias("payload"),
        )

    def access_events(self) -> DataFrame:
        """Events as an access log."""
        ops = (
            F.when(F.col("event_type") == "view", F.lit("context.compile"))
            .when(F.col("event_type") == "click", F.lit("records.read"))
            .when(F.col("event_type") == "purchase", F.lit("blob.read"))
            .otherwise(F.lit("context.search"))
        )
        denied = F.col("event_type") == "error"
        return self.table("events").select(
            _ts("ts").alias("at"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject"),
            ops.alias("operation"),
            F.when(denied, F.lit("deny")).otherwise(F.lit("allow")).alias("outcome"),
            F.when(denied, F.lit("no-matching-policy-rule")).alias("code"),
        )

    # -- policy ------------------------------------------------------------

    def principals(self) -> DataFrame:
        """One reader per market segment."""
        return self.table("customer").select("c_mktsegment").distinct().select(
            F.concat(F.lit("reader-"), F.lower("c_mktsegment")).alias("subject"),
            F.array(F.lit(" context:read"), F.lit("record:read "), F.lit("context:read")).alias("scopes"),
        )

    def grants(self) -> DataFrame:
        """Readers see customers of their segment; those in debt are refused."""
        return self.table("customer").select(
            F.concat(F.lit("reader-"), F.lower("c_mktsegment")).alias("subject"),
            F.concat(F.lit("entity://customer/"), F.col("c_custkey").cast("string")).alias("entity_id"),
            F.when(F.col("c_acctbal") < 0, F.lit("deny")).otherwise(F.lit("allow")).alias("effect"),
        )
