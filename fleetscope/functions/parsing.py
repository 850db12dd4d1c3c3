"""Coercion of landed text into typed columns; bad input becomes a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> power of 1024
BYTE_SUFFIXES = {"b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4}

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,6}(GMT|UTC|Z|[+-][0-9]{2}:?[0-9]{2})$"


def text_to_long(text: Column) -> Column:
    """Whole-number text -> long, anything else -> null."""
    return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))


def text_to_double(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def safe_int(text: Column) -> Column:
    return F.coalesce(text_to_long(text), F.lit(0).cast("bigint"))


def json_int(text: Column) -> Column:
    """A JSON scalar read as text -> long: integers as they are, other numbers truncated, else 0."""
    return F.coalesce(text_to_long(text), text_to_double(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_byte_string(text: Column) -> Column:
    """``64MB``, ``1.5g`` or a bare integer -> bytes; null when it is neither."""
    clean = F.lower(F.trim(text))
    unit = F.regexp_extract(clean, r"([kmgt]?b|[kmgt])$", 1)
    number = F.regexp_replace(clean, r"([kmgt]?b|[kmgt])$", "")
    powers = F.create_map(*[F.lit(x) for pair in BYTE_SUFFIXES.items() for x in pair])
    factor = F.pow(F.lit(1024.0), F.try_element_at(powers, unit))
    return F.when(unit == "", text_to_long(clean)).otherwise((text_to_double(number) * factor).cast("bigint"))


def epoch_ms(ms: Column) -> Column:
    """Epoch milliseconds -> timestamp; null unless positive."""
    return F.when(ms > 0, F.timestamp_millis(ms))


def parse_spark_ts(text: Column) -> Column:
    """ISO time with an offset, or epoch milliseconds as text; null when it is neither."""
    iso = F.when(text.rlike(ISO_TIME), F.try_to_timestamp(F.regexp_replace(text, "(GMT|UTC)$", "Z")))
    return F.coalesce(iso, F.timestamp_millis(text_to_long(text)))


def coerce_enum(text: Column, allowed: tuple[str, ...], default: str) -> Column:
    upper = F.upper(text)
    return F.when(upper.isin(*allowed), upper).otherwise(F.lit(default))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))
