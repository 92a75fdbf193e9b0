"""Typed values from text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Outer blanks and quotes off; what is empty then is null."""
    return F.nullif(F.btrim(F.trim(c), F.lit('"')), F.lit(""))


def to_double(c: Column) -> Column:
    """A finite number, or null; no type suffixes, digit separators between digits allowed."""
    plain = F.regexp_replace(c, r"(?<=[0-9])_(?=[0-9])", "")
    number = plain.rlike(r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z")
    return F.when(number, plain.try_cast("double"))


def to_int(c: Column) -> Column:
    """A whole number; fractional text is rounded half away from zero."""
    return F.round(to_double(c)).try_cast("int")


def exact_sum(c: Column, scale: int = 6) -> Column:
    """A sum that is null only if all is null, and that does not depend on the order of rows.

    Values count to ``scale`` decimals.  Where a group holds one of 1e21 or more, which the decimals cannot
    hold, its sum is taken in doubles instead.
    """
    fits = F.coalesce(F.max(F.abs(c)), F.lit(0.0)) < 1e21
    return F.when(fits, F.sum(c.try_cast(f"decimal(28,{scale})")).cast("double")).otherwise(F.sum(c))
