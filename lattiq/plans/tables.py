"""The panel's roles played by the order tables: text records, master, and what the rollups make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators.rollup import entity_quarters, master_units, typed_records, unit_quarters

EVALUATION = {"modeling_start": "1995Q1", "minimum_history": 8, "recent_quarters": 4}
VALIDATION = {"start": "1997Q1", "end": "1998Q4", "count": 8}
DEVELOPMENT_TARGET_END = "1999Q4"
HOLDOUT = {"start": "2000Q1", "end": "2000Q2", "count": 2}
HOLDOUT_TARGET_END = "2001Q2"
LATEST, LATEST_TARGET_END = "2001Q3", "2002Q3"
FIRST, LAST, VALUES_TO = "1995Q1", "2001Q3", "1999Q4"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str, entity: str = "segment") -> DataFrame:
    """Orders as text records with quotes, blanks, empty and zero values, and two domains."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    date = F.col("o_orderdate").cast("date")
    name = F.lower("n_name") if entity == "nation" else F.concat(F.lower("n_name"), F.lit("/"), F.col("c_mktsegment"))
    value = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderpriority") == "5-LOW", "0").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    text = lambda c: c.cast("string")
    return d.select(
        F.concat(F.lit('"'), text(F.col("o_custkey")), F.lit('"')).alias("unit_id"), F.concat(F.lit("Unit "), text(F.col("o_custkey"))).alias("unit_name"),
        F.concat(F.lit(" "), name).alias("entity"), F.col("o_orderpriority").alias("subunit"), text(F.year(date)).alias("cal_year"), text(F.quarter(date)).alias("cal_quarter"),
        text(F.col("o_orderkey") % 50).alias("employees"), text(F.col("o_orderkey") % 1000).alias("hours"), value.alias("value"),
        F.when(F.col("o_orderkey") % 10 == 0, "M").otherwise(" c ").alias("domain"))


def raw_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as master text: every seventh is missing, every eleventh comes twice."""
    c = read(spark, sf_dir, "customer")
    c = c.where("c_custkey % 7 <> 0").unionByName(c.where("c_custkey % 11 = 0 and c_custkey % 7 <> 0"))
    return c.select(F.concat(F.lit(' "'), F.col("c_custkey").cast("string"), F.lit('"')).alias("unit_id"), F.col("c_mktsegment").alias("entity"), F.lit("C").alias("domain"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_records(raw_records(spark, sf_dir))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_units(raw_master(spark, sf_dir))


def units(spark: SparkSession, sf_dir: str, entity: str = "segment") -> DataFrame:
    return unit_quarters(typed_records(raw_records(spark, sf_dir, entity)))


def panel(spark: SparkSession, sf_dir: str, entity: str = "segment") -> DataFrame:
    """The entity-quarter panel; kept, since a forecast reads it several times and it is small."""
    # The predicate names an aggregate's result, so it stays above it; below, it would parse each record's text many times more.
    d = entity_quarters(units(spark, sf_dir, entity)).where(F.when(F.col("source_rows") > 0, F.col("quarter").isNotNull()))
    return d.select("entity", "cal_year", "cal_quarter", "period", "quarter", "value").persist()
