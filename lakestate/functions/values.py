"""JSON values, ids, digests, clocks."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# String tokens are matched first and kept whole; whole-valued doubles lose ".0".
_WHOLE = r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0(?![\d.eE])'
# An entity reference standing as a value, not as an object key.
_ENTITY_REF = r'(?<=^|[:\[,])"(entity://[^"]*)"(?!:)'


def canonical_json(text: Column) -> Column:
    """Key-sorted JSON with one spelling per value; NULL when it does not parse."""
    return F.regexp_replace(F.to_json(F.try_parse_json(text)), _WHOLE, "$1$2")


def json_string(text: Column) -> Column:
    """A string as a JSON value."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def context_value(value_json: Column) -> Column:
    """Strings without quotes, everything else as JSON."""
    return F.when(
        value_json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")
    ).otherwise(value_json)


def same_value(left: Column, right: Column) -> Column:
    return canonical_json(left).eqNullSafe(canonical_json(right))


def entity_refs(value_json: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(value_json, F.lit(_ENTITY_REF), F.lit(1)))


def pointer_path(pointer: Column) -> Column:
    """A JSON pointer or a plain dotted path as a variant path."""
    step = lambda part: F.when(
        part.rlike(r"^\d+$"), F.concat(F.lit("["), part, F.lit("]"))
    ).otherwise(F.concat(F.lit("['"), F.replace(part, F.lit("'"), F.lit("\\'")), F.lit("']")))
    unescaped = F.transform(
        F.split(pointer.substr(F.lit(2), F.length(pointer)), "/"),
        lambda part: F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")),
    )
    parts = F.when(pointer.startswith("/"), unescaped).otherwise(F.split(pointer, r"\."))
    return F.concat(F.lit("$"), F.array_join(F.transform(parts, step), ""))


def tuple_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id: prefix and digest of the JSON list of the parts."""
    text = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.concat(F.lit(prefix + ":"), F.sha2(text, 256))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_clock(text: Column) -> Column:
    """Any ISO text as a UTC timestamp in whole milliseconds; NULL when bad."""
    return F.date_trunc("millisecond", text.try_cast("timestamp"))


def epoch_key(secret: bytes, epoch_id: str) -> bytes:
    """HKDF-SHA256 (one block) of the epoch secret; runs once on the driver."""
    extracted = hmac.new(b"\x00" * 32, secret, hashlib.sha256).digest()
    return hmac.new(extracted, f"record-tags/{epoch_id}".encode() + b"\x01", hashlib.sha256).digest()


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer block of an HMAC key."""
    block = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_tag(inner: Column, outer: Column, domain: str, purpose: str, value: Column) -> Column:
    """HMAC-SHA256 over [domain, purpose, value] with the key's pads as columns, with built-ins only."""
    message = F.encode(F.to_json(F.array(F.lit(domain), F.lit(purpose), value)), "UTF-8")
    first = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, first), 256)


def group_digest(rows: DataFrame, keys: list[str], text: Column, name: str = "digest", counts: dict[str, Column] | None = None) -> DataFrame:
    """One SHA-256 per group, over the SHA-256 of each row's text; independent of row order.

    ``counts`` adds the number of a group's rows for which each condition holds.

    Row hashes are sorted and hashed in 65,536 strands by their first digits, and
    the strands' hashes in order once more, so no list holds more than a group's
    65,536th part of rows or 65,536 strands.
    """
    counts = counts or {}
    # Hashes are shuffled as bytes, half as long as their digits and in the same order.
    in_bytes = lambda text: F.unhex(F.sha2(text, 256))
    digits = lambda hashes: F.lower(F.array_join(F.transform(F.array_sort(hashes), F.hex), ""))
    hashed = rows.select(*keys, in_bytes(text).alias("__row"), *[held.cast("bigint").alias(n) for n, held in counts.items()])
    total = [F.sum(n).alias(n) for n in counts]
    strands = hashed.groupBy(*keys, F.substring("__row", 1, 2).alias("__strand")).agg(
        in_bytes(digits(F.collect_list("__row"))).alias("__hash"), *total
    )
    ordered = F.array_sort(F.collect_list(F.struct("__strand", "__hash")))
    joined = F.lower(F.array_join(F.transform(ordered, lambda s: F.hex(s["__hash"])), ""))
    return strands.groupBy(*keys).agg(F.sha2(joined, 256).alias(name), *total)


def json_list(*parts: Column | str) -> Column:
    """The parts as a JSON list of texts: unambiguous, and NULL is kept."""
    return F.to_json(F.array(*[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all i, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)
