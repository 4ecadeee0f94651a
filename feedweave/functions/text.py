"""Text rules of the change feeds: blanks, exact matches, instants and integers inside JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when source text is trimmed, and the accepted instant format.
WHITE_SPACE = r"[\t-\r\x1c-\x1f\p{Z}]"
ISO_INSTANT = (
    r"(?i)\A[+-]?\d{4,9}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{0,9})?(Z|[+-]\d{2}(:\d{2})?)\z"
)


def trim_text(text: Column) -> Column:
    """Trim every kind of Unicode white space; Spark's own `trim` removes only the space character."""
    return F.regexp_replace(text, rf"\A{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(rf"\A{WHITE_SPACE}*\z")


def matches_fully(text: Column, pattern: str) -> Column:
    r"""Whole-text match; `$` would let a trailing line feed pass, `\z` does not."""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def parse_instant(text: Column) -> Column:
    """ISO-8601 instant with zone, or null. The looser forms Spark's cast accepts are refused."""
    return F.when(text.rlike(ISO_INSTANT), F.upper(text).try_cast("timestamp"))


def format_instant(ts: Column) -> Column:
    """ISO-8601 text in UTC with 0, 3 or 6 fraction digits, whichever is the shortest exact form."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS")),
        F.lit("Z"),
    )


def whole_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded towards the past like an ISO duration's seconds part."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)).cast("bigint")


def wrap_to_int(number: Column) -> Column:
    """A 64-bit integer narrowed to 32 bits by keeping the low bits."""
    return (F.pmod(number + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("int")
