"""Text columns: normalisation, terms, token costs, readable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that NFKC leaves alone on their own; text made of these only
# skips the call. Combining marks lie outside, so a sequence that would
# compose never skips it.
_STABLE = r"^[\x00-\x7FÀ-ÿЀ-џ一-鿿]*$"


def nfkc(text: Column) -> Column:
    """NFKC form, by the ICU library Spark ships, inside the JVM."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(_STABLE), text).when(text.isNotNull(), composed)


def fold(text: Column) -> Column:
    """Lower-case, runs of other than letters and numbers become one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize(text: Column) -> Column:
    return fold(nfkc(text))


def with_normalized(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the normalised form of ``source`` as ``target``."""
    return df.withColumn(target, normalize(F.col(source)))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def token_count(normalized: Column) -> Column:
    return F.when(normalized == "", F.lit(0)).otherwise(F.size(F.split(normalized, " ")))


def alias_score(normalized: Column) -> Column:
    return token_count(normalized) * 100 + utf16_length(normalized)


def term_list(normalized: Column) -> Column:
    """Tokens of two or more UTF-16 units (four UTF-8 bytes = one astral sign)."""
    return F.filter(
        F.split(normalized, " "), lambda t: (F.length(t) >= 2) | (F.octet_length(t) >= 4)
    )


def terms(normalized: Column) -> Column:
    return F.array_distinct(term_list(normalized))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; zero for empty text."""
    return F.ceil(utf16_length(text) / 4).cast("int")


# Fixed value: what any record costs besides its text.
LEAST_COST = 8


def record_cost(text: Column) -> Column:
    return estimate_tokens(text) + F.lit(LEAST_COST)


def readable_property(name: Column) -> Column:
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(spaced, r"[._]+", " "))


def property_label(name: Column, aliases: Column) -> Column:
    """Readable name followed by its configured aliases."""
    return F.concat_ws(" / ", readable_property(name), aliases)


def scrub(text: Column) -> Column:
    """Control characters to spaces, as used for titles and excerpts."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+", " "))


def ngrams(tokens: Column, length: Column) -> Column:
    """All runs of ``length`` neighbouring tokens, joined by one space."""
    starts = F.when(
        F.size(tokens) >= length, F.sequence(F.lit(1), F.size(tokens) - length + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, length), " "))
