"""Numbers as documents write them, and money in whole kuruş."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: Column) -> Column:
    """A double from text without commas and spaces; null if it isn't a plain number."""
    text = F.regexp_replace(c.cast("string"), "[ ,]", "")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_numeric(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("string"), "[ ,]", "").rlike(NUMBER), F.lit(False))


def cents(x: Column) -> Column:
    """Whole kuruş, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) * 100 + 0.5)).cast("long")


def money(x: Column) -> Column:
    """A double rounded to the kuruş."""
    return cents(x) / F.lit(100.0)


def numeric_close(a: Column, b: Column, tolerance: float) -> Column:
    """Within tolerance of the larger magnitude; two zeros are close, non-numbers are not."""
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    return F.coalesce(((a == 0) & (b == 0)) | (gap <= tolerance), F.lit(False))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def turkish_money(x: Column) -> Column:
    """1.234,56 TL, the sign in front."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.translate(F.format_number(F.abs(x), 2), ",.", ".,"), F.lit(" TL"))
