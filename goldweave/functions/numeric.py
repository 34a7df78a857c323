"""Numbers inside texts, and their similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_price(value: Column) -> Column:
    """Digits and points of the text, half-even to cents; null if that is no number."""
    kept = F.regexp_replace(value.cast("string"), "[^0-9.]", "")
    return F.bround(kept.try_cast("decimal(38,10)"), 2).cast("double")


def parse_float(value: Column) -> Column:
    return F.regexp_extract(value.cast("string"), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def is_number_like(value: Column) -> Column:
    return parse_float(value).isNotNull()


def safe_float(value: Column, default: float = 0.0) -> Column:
    """The number that the text is, else ``default``; NaN counts as none."""
    x = value.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def clean_price(text: Column) -> Column:
    """A positive number without trailing zeros of its cents, else an empty text; on text without quotes."""
    x = F.trim(text).try_cast("double")
    plain = F.format_string("%.2f", x)
    return F.when(x > 0, F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))).otherwise(F.lit(""))


def digits_only(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")


def is_phone_like(value: Column) -> Column:
    return F.length(digits_only(value)) >= 7


def is_year_like(value: Column) -> Column:
    x = parse_float(value)
    return F.coalesce((x == F.floor(x)) & x.between(1400, 2200), F.lit(False))


def price_similarity(a: Column, b: Column) -> Column:
    """Missing 0.5; else one less the difference over the larger price, 1 at least."""
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1.0))))


def numeric_similarity(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))))


def price_log_delta(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.abs(F.log1p(a) - F.log1p(b)))
