"""Typed ingest and the two null-preserving rollups: record to unit-quarter to entity-quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.text import clean, exact_sum, to_double, to_int

#: Text fields of a source record.
RAW = ["unit_id", "unit_name", "entity", "subunit", "cal_year", "cal_quarter", "employees", "hours", "value", "domain"]


def typed_records(raw: DataFrame, domain: str = "C") -> DataFrame:
    """The records of one domain, typed; text that is no number becomes null, and stays in ``value_raw``."""
    d = raw.where(F.upper(F.btrim(F.trim("domain"), F.lit('"'))) == domain)
    text = {c: clean(F.col(c)) for c in RAW}
    return d.select(
        text["unit_id"].alias("unit_id"), text["unit_name"].alias("unit_name"), F.upper(text["entity"]).alias("entity"), text["subunit"].alias("subunit"),
        to_int(text["cal_year"]).alias("cal_year"), to_int(text["cal_quarter"]).alias("cal_quarter"),
        to_double(text["employees"]).alias("employees"), to_double(text["hours"]).alias("hours"),
        to_double(text["value"]).alias("value"), text["value"].alias("value_raw"),
    )


def master_units(master: DataFrame) -> DataFrame:
    return master.select(clean(F.col("unit_id")).alias("unit_id"), F.upper(clean(F.col("entity"))).alias("entity"), clean(F.col("domain")).alias("domain"))


def unit_quarters(records: DataFrame) -> DataFrame:
    """One row for each (unit, entity, year, quarter); null keys are groups; a sum of nulls is null."""
    some, every = F.count("value"), F.count("*")
    d = records.groupBy("unit_id", "entity", "cal_year", "cal_quarter").agg(
        exact_sum(F.col("value")).alias("value"), exact_sum(F.col("employees")).alias("employees"), exact_sum(F.col("hours")).alias("hours"),
        every.alias("source_rows"), some.alias("reported_rows"), (every - some).alias("missing_rows"),
        (some == 0).alias("all_null"), ((some > 0) & (some < every)).alias("partly_null"))
    ok = F.col("cal_year").isNotNull() & F.col("cal_quarter").between(1, 4)
    return d.withColumns({
        "period": F.concat(F.col("cal_year").cast("string"), F.lit("Q"), F.col("cal_quarter").cast("string")),
        "quarter": F.when(ok, F.make_date("cal_year", F.when(ok, F.col("cal_quarter") * 3 - 2), F.lit(1))),
    })


def entity_quarters(units: DataFrame) -> DataFrame:
    """One row for each (entity, quarter)."""
    few = lambda c: F.count_if(c).alias
    return units.groupBy("entity", "cal_year", "cal_quarter", "period", "quarter").agg(
        exact_sum(F.col("value")).alias("value"), F.count("*").alias("unit_rows"), F.count("value").alias("observed_units"),
        (F.count("*") - F.count("value")).alias("all_null_units"),
        few(F.col("value") > 0)("positive_units"), few(F.col("value") == 0)("zero_units"), few(F.col("partly_null"))("partly_null_units"),
        F.sum("source_rows").alias("source_rows"), exact_sum(F.col("employees")).alias("employees"), exact_sum(F.col("hours")).alias("hours"))


def masked(units_or_panel: DataFrame, cutoff) -> DataFrame:
    """Magnitudes after ``cutoff`` hidden: null stays null, any value reads 1."""
    v = F.col("value")
    return units_or_panel.withColumn("value", F.when(F.col("quarter") <= F.lit(cutoff), v).when(v.isNull(), v).otherwise(F.lit(1.0)))
