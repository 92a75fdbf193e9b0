"""Running sums in the order of a value, made by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.sources.sinks import cut


def running_sum(rows: DataFrame, keys: list[str], order: list[str], weight: str = "n", *, total: str = "cells", upto: str = "upto") -> DataFrame:
    """Adds ``upto``, the sum of ``weight`` over rows of the same keys up to this one in ``order``, and ``total``, their whole sum.

    No task sorts more than its share: rows are dealt out by ranges of (keys, order) and written, so that the ranges stay as they
    are; a running sum within each range is raised by the sum of the ranges before it, of which there are
    few.  ``order`` must tell the rows of one key apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    by = Window.partitionBy(*keys)
    sums = d.groupBy(*keys, "_range").agg(F.sum(weight).alias("_own"))  # at most a row for each range and key
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_own").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_own").over(by).alias(total))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_within", F.sum(weight).over(within))
    same = [d[k].eqNullSafe(sums[k]) for k in [*keys, "_range"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return d.join(sums, on).select(*[d[c] for c in rows.columns], (F.col("_within") + F.col("_before")).alias(upto), total)


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each name in ``at``): quantiles by group, linear between the two neighbouring values; nulls are left out.

    Rows with equal values become one count first; the running sum over the distinct values, made range by range, tells
    which of them hold the two ranks.  No task holds a group, and nothing but counts is shuffled after the first
    aggregate.  Groups without a value are missing.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("n"))
    d = running_sum(counts, keys, ["_value"])
    place = {name: (F.col("cells") - 1) * F.lit(q) for name, q in at.items()}
    holds = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("_value")))
    found = d.groupBy(*keys, "cells").agg(*[holds(f(p)).alias(f"_{side}_{name}") for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    return found.select(*keys, *[(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (p - F.floor(p))).alias(name) for name, p in place.items()])


def with_quantiles(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``groups``, one row for each group of ``keys``, with the quantiles of the group's ``rows``; null where it has no value."""
    q = quantiles(rows, keys, value, at).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        on = same if on is None else on & same
    return groups.join(q, on, "left").drop(*[f"_key_{k}" for k in keys])
