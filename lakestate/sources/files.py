"""Text files with front matter, and what is read out of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakestate.functions import text as tx
from lakestate.functions import values as vl

# Excerpt length, file size, files per project, text per project.
EXCERPT, MAX_FILE, MAX_DOCS, MAX_TEXT = 1100, 64 * 1024, 20, 11000


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """All Markdown files below a folder, with digest and parsed front matter."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    )
    return parse_markdown(
        files.select("path", F.col("modificationTime").alias("observed_at"), F.col("length").alias("size"), "content")
    )


def parse_markdown(files: DataFrame) -> DataFrame:
    """(path, content) with revision, front matter as JSON and body.

    Plain ``key: scalar`` lines are parsed by built-ins; only a front matter
    block with other YAML goes through the Arrow stage.
    """
    text = F.decode("content", "UTF-8")
    block = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    split = files.withColumn("__t", text).withColumn("revision", F.sha2("content", 256)).select(
        *files.columns, "revision", F.regexp_extract("__t", block, 1).alias("front"),
        F.when(F.col("__t").rlike(block), F.regexp_extract("__t", block, 2)).otherwise(F.col("__t")).alias("body"),
    )
    simple = F.forall(F.split("front", r"\r?\n"), lambda line: line.rlike(r'^[A-Za-z_][\w.-]*: +[^\s\[{&*!|>\'"%@`#][^#:]*$'))
    pairs = F.transform(
        F.split("front", r"\r?\n"),
        lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("v")),
    )
    scalar = lambda v: F.when(v.rlike(r"^(-?(0|[1-9]\d*)(\.\d+)?|true|false|null)$"), v).otherwise(vl.json_string(v))
    as_json = F.concat(
        F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(vl.json_string(p["k"]), F.lit(":"), scalar(p["v"]))), ","), F.lit("}")
    )
    is_simple = (F.col("front") != "") & simple
    plain = split.filter(is_simple | (F.col("front") == "")).withColumn("fields", F.when(F.col("front") != "", vl.canonical_json(as_json)))
    rest = split.filter(~is_simple & (F.col("front") != "")).withColumn("fields", vl.canonical_json(_yaml(F.col("front"))))
    return plain.unionByName(rest).drop("front")


@F.pandas_udf(T.StringType())
def _yaml(front: pd.Series) -> pd.Series:
    import yaml

    def parse(text: str) -> str | None:
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError:
            return None
        return json.dumps(value, default=str) if isinstance(value, dict) else None

    return front.map(parse)


def check_inventory(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files nobody listed and listed files that are not there."""
    extra = files.select("path").join(listed.select("path"), "path", "left_anti").withColumn("rule", F.lit("unlisted"))
    lost = listed.select("path").join(files.select("path"), "path", "left_anti").withColumn("rule", F.lit("missing"))
    return extra.unionByName(lost)


def scan_bounds(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Size of a scan and whether it is within its bounds."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes")).withColumn(
        "status",
        F.when(F.col("n_files") > max_files, F.lit("too-many-files")).when(F.col("n_bytes") > max_bytes, F.lit("too-many-bytes")).otherwise(F.lit("ok")),
    )


def value_at(fields: Column, pointer: Column) -> Column:
    """The value at a JSON pointer or dotted path, as canonical JSON."""
    found = F.try_variant_get(F.try_parse_json(fields), vl.pointer_path(pointer), "variant")
    return F.when(found.isNotNull(), F.to_json(found))


def observe_files(files: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bound files as snapshots, one row per readable field; absent fields come out as violations."""
    rows = files.join(bindings.filter("readable").withColumnRenamed("external_id", "path"), "path").withColumn(
        "value_json", value_at(F.col("fields"), F.col("external"))
    )
    seen = rows.filter("value_json IS NOT NULL").select(
        "entity_id", "provider", F.col("path").alias("external_id"), "revision", "observed_at", "external", "value_json"
    )
    lost = rows.filter("value_json IS NULL").select(F.col("path").alias("external_id"), "external", F.lit("undeclared-field").alias("rule"))
    return seen, lost


def doc_excerpts(docs: DataFrame) -> DataFrame:
    """Per project the scrubbed beginnings of its first documents, in order.

    The caps are the feature: large files are skipped, twenty documents at most,
    the joined text is cut. The constant rank limit is applied before the shuffle.
    """
    small = docs.filter(F.octet_length("text") <= MAX_FILE)
    order = Window.partitionBy("project").orderBy("path")
    first = small.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_DOCS)
    cut = F.substring(tx.scrub(F.col("text")), 1, EXCERPT)
    return first.groupBy("project").agg(
        F.substring(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", cut.alias("x")))), lambda r: F.concat(r["path"], F.lit(": "), r["x"])), "\n"),
            1, MAX_TEXT,
        ).alias("excerpt"),
        F.count(F.lit(1)).alias("n_docs"),
    )
