"""Documents that break things: nulls, blanks, long texts, repeats, clashing columns."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()), StructField("fp", LongType()), StructField("owner", StringType()), StructField("range", StringType()), StructField("component_id", StringType()),
])

LONG = " ".join(f"word{i * i % 7919} of{i % 13}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG), (8, "x" * 5_000), (9, "é" * 700 + " <|endoftext|>  a\n\n b"),
    (10, "same text here again"), (11, "same text here again"), (11, "same text here again"), (None, "no id at all"), (None, "no id at all"), (None, None),
    (-5, "  double  blanks \x01 and \x1c marks　wide "), (12, "日本語のテキスト 🎉🎉"), (9_000_000_000, "it's we'll I'm"),
]


def frame(spark, rows):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(d, t, "en", "src", None if t is None else len(t), 7, "o", "r", "c") for d, t in rows], SCHEMA)
