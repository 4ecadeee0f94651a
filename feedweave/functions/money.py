"""Exact decimal text to minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,9})?\z"
# Amounts as they nearly always come; these need no digit work.
PLAIN = r"\A-?[0-9]{1,15}(\.[0-9]{1,2}0{0,20})?\z"
ROUNDING = "Rounding necessary"
OVERFLOW = "Overflow"


def is_decimal_text(text: Column) -> Column:
    return F.coalesce(text.rlike(DECIMAL_TEXT), F.lit(False))


def to_minor_units(text: Column) -> tuple[Column, Column]:
    """Decimal text in major units to (minor units, problem).

    Works on the digits and not on a rounded decimal: a cast to a fixed scale would silently round
    `10.5000001`. The problem is null when the amount has at most two decimals and fits 64 bits.
    """
    whole = F.regexp_extract(text, r"\A[+-]?([0-9]*)", 1)
    fraction = F.regexp_extract(text, r"\.([0-9]*)", 1)
    exponent_text = F.regexp_extract(text, r"[eE]([+-]?[0-9]{1,9})\z", 1)
    exponent = F.when(exponent_text != "", exponent_text.cast("int")).otherwise(F.lit(0))
    digits = F.regexp_replace(F.concat(whole, fraction), r"\A0+(?=[0-9])", "")
    shift = F.lit(2) + exponent - F.length(fraction)
    is_zero = digits.rlike(r"\A0*\z")
    spare = F.regexp_extract(digits, r"(0*)\z", 1)
    kept = F.substring(digits, F.lit(1), F.greatest(F.length(digits) + F.least(shift, F.lit(0)), F.lit(0)))
    grown = F.concat(digits, F.repeat(F.lit("0"), F.least(F.greatest(shift, F.lit(0)), F.lit(20))))
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    inexact = ~is_zero & (shift < 0) & (F.length(spare) < -shift)
    units = F.when(is_zero, F.lit(0).cast("bigint")).otherwise(
        F.concat(sign, F.when(shift < 0, kept).otherwise(grown)).try_cast("bigint")
    )
    plain = F.coalesce(text.rlike(PLAIN), F.lit(False))
    plain_units = (text.try_cast("decimal(17,2)") * 100).cast("bigint")
    problem = F.when(~plain, F.when(inexact, F.lit(ROUNDING)).when(~is_zero & units.isNull(), F.lit(OVERFLOW)))
    exact = F.when(plain, plain_units).otherwise(F.when(~inexact, units))
    return F.coalesce(exact, F.lit(0).cast("bigint")), problem
