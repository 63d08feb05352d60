"""Casts that yield NULL where a value cannot be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def strip_unicode(text: Column) -> Column:
    """Without blanks of any alphabet at both ends, the non-breaking one included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_nan_text(text: Column) -> Column:
    """Whether the text reads as the number NaN, with or without a sign."""
    return F.regexp_replace(F.lower(strip(text.cast("string"))), "^[+-]", "") == "nan"


def blank_to_null(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed != "", trimmed)


def no_nan(value: Column) -> Column:
    """NULL for NaN, which Spark would otherwise rank above every number."""
    return F.nanvl(value, F.lit(None).cast("double"))


def to_double(text: Column) -> Column:
    """Number or NULL. A trailing type letter ("1d", "1f") is not a number, "inf" is."""
    lower = F.lower(strip(text.cast("string")))
    typed = F.substring(lower, -1, 1).isin("d", "f") & ~lower.endswith("inf")
    return no_nan(F.when(typed, None).otherwise(lower).try_cast("double"))


def to_timestamp(text: Column) -> Column:
    return blank_to_null(text).try_cast("timestamp")


def finite_or_zero(value: Column) -> Column:
    """Missing and infinite become 0, as imputation before scaling expects."""
    number = F.nanvl(value.cast("double"), F.lit(0.0))
    return F.when(F.abs(number) < F.lit(float("inf")), number).otherwise(F.lit(0.0))


def safe_ratio(top: Column, bottom: Column, floor: float = 0.0) -> Column:
    """``top / bottom`` where the divisor is larger than ``floor`` in size, else NULL."""
    return F.when(F.abs(bottom) > floor, F.try_divide(top, bottom))
