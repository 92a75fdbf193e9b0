"""Quarter labels and calendar arithmetic, on the driver and as columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PERIOD = re.compile(r"(\d{4})Q([1-4])")


def period_start(label: str) -> dt.date:
    """First day of a quarter written ``YYYYQn``."""
    m = PERIOD.fullmatch(str(label))
    if m is None:
        raise ValueError(f"not a quarter: {label!r}")
    return dt.date(int(m[1]), 3 * int(m[2]) - 2, 1)


def period_label(day: dt.date) -> str:
    return f"{day.year}Q{(day.month + 2) // 3}"


def shift(label: str, quarters: int) -> str:
    start = period_start(label)
    n = start.year * 4 + (start.month - 1) // 3 + quarters
    return f"{n // 4}Q{n % 4 + 1}"


def quarters(first: str, last: str) -> list[str]:
    """All quarters from ``first`` to ``last``."""
    if period_start(last) < period_start(first):
        raise ValueError(f"{last} is before {first}")
    out = [first]
    while out[-1] != last:
        out.append(shift(out[-1], 1))
    return out


def day(label: str) -> Column:
    return F.lit(period_start(label))


def label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def moved(date: Column, quarters_: Column | int) -> Column:
    return F.add_months(date, (quarters_ if isinstance(quarters_, Column) else F.lit(quarters_)) * 3)


def index(date: Column, origin: str = "0001Q1") -> Column:
    """Quarters since ``origin``."""
    first = period_start(origin)
    return (F.year(date) - first.year) * 4 + F.quarter(date) - (first.month + 2) // 3


def at_offset(value: Column, quarters_: int, *keys: str, date: str = "quarter") -> Column:
    """``value`` of the same keys exactly so many quarters away (null if there is no such row).

    A calendar lag, not a row lag: a range frame of one point.  One shuffle by the keys
    serves any number of offsets.
    """
    w = Window.partitionBy(*keys).orderBy(index(F.col(date)))
    return F.first(value).over(w.rangeBetween(quarters_, quarters_))
