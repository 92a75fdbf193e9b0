"""Nineteen declared quality checks, and the verdict against expectations.

Each base table is read once: its checks are one aggregate, which is then unpivoted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.errors import ContractError


def _rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    one = df.agg(*[c.cast("string").alias(k) for k, c in checks.items()])
    return one.unpivot([], list(checks), "check_name", "observed_value")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows repeat an earlier row's keys (nulls are equal)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def unmatched_ids(records: DataFrame, master: DataFrame) -> DataFrame:
    """Ids of records that the master lacks."""
    return records.where("unit_id is not null").select("unit_id").distinct().join(master, "unit_id", "left_anti")


def quality_checks(raw: DataFrame, records: DataFrame, master: DataFrame, units: DataFrame, entities: DataFrame) -> DataFrame:
    """(check_name, observed_value), both text."""
    v = F.col("value")
    single = lambda df, name, c: df.select(F.lit(name).alias("check_name"), c.cast("string").alias("observed_value"))
    # A null quarter beside a valid year is not counted: the comparison is null.
    parts = [
        _rows(raw, {"raw_quarterly_rows": F.count("*")}),
        _rows(records, {
            "domain_source_rows": F.count("*"), "domain_distinct_units": F.count_distinct("unit_id"),
            "invalid_unit_ids": F.count_if(F.col("unit_id").isNull() | ~F.col("unit_id").rlike(r"\A[0-9]+\z")),
            "invalid_periods": F.count_if(F.col("cal_year").isNull() | ~F.col("cal_quarter").between(1, 4)),
            "invalid_values": F.count_if(F.col("value_raw").isNotNull() & v.isNull()), "negative_value_rows": F.count_if(v < 0),
        }),
        single(repeated_keys(records, "unit_id", "cal_year", "cal_quarter", "subunit"), "duplicate_source_keys", F.col("n")),
        single(repeated_keys(master.where("unit_id is not null"), "unit_id"), "duplicate_master_ids", F.col("n")),
        _rows(unmatched_ids(records, master), {"unmatched_unit_ids": F.count("*")}),
        _rows(units, {
            "unit_quarter_rows": F.count("*"), "unit_quarter_positive_rows": F.count_if(v > 0), "unit_quarter_zero_rows": F.count_if(v == 0),
            "unit_quarter_all_null_rows": F.count_if(v.isNull()), "entity_count": F.count_distinct("entity"), "period_min": F.min("period"),
            "period_max": F.max("period"), "missing_entity_unit_quarters": F.count_if(F.col("entity").isNull()),
        }),
        _rows(entities, {"entity_quarter_rows": F.count("*")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def verdict(observed: dict[str, str | None], expected: dict[str, object]) -> list[dict]:
    """A record for each check; one that is missing or differs raises, one that is not expected is diagnostic."""
    out = [{"check": k, "expected": str(v), "observed": observed.get(k), "status": "passed" if observed.get(k) == str(v) else "blocking"} for k, v in expected.items()]
    out += [{"check": k, "expected": None, "observed": v, "status": "diagnostic"} for k, v in observed.items() if k not in expected]
    bad = [x["check"] for x in out if x["status"] == "blocking"]
    if bad:
        raise ContractError("quality checks failed: " + ", ".join(sorted(bad)))
    return out
