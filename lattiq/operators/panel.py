"""Panel operators over (entity, quarter, value): validation, coverage, change, shares, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.errors import LeakageError, PanelError
from lattiq.functions.periods import at_offset, day, label, period_start
from lattiq.functions.ranks import with_quantiles
from lattiq.functions.text import exact_sum
from lattiq.sources.sinks import cut

STATUSES = ["leading_absence", "internal_absence", "trailing_absence", "observed_null", "observed_zero", "observed_positive", "observed_masked"]


def need(df: DataFrame, *columns: str, error: type[Exception] = PanelError) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error("missing columns: " + ", ".join(missing))


def unique(df: DataFrame, *keys: str, error: type[Exception] = PanelError) -> None:
    """Raise if two rows share their keys."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise error("repeated keys: " + ", ".join(keys))


def validate_panel(panel: DataFrame) -> DataFrame:
    """The panel itself, once its keys, dates, signs and labels are checked in one aggregate."""
    need(panel, "entity", "cal_year", "cal_quarter", "period", "quarter", "value")
    start = (F.dayofmonth("quarter") == 1) & F.month("quarter").isin(1, 4, 7, 10)
    groups = panel.groupBy("entity", "quarter").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(start, F.lit(False))).alias("dates"), F.count_if(F.col("value") < 0).alias("signs"),
        F.count_if(~F.coalesce(label(F.col("quarter")) == F.col("period"), F.lit(False))).alias("labels"))
    r = groups.agg(F.count_if(F.col("n") > 1).alias("keys"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dates", "signs", "labels")]).first()
    for k, what in (("keys", "repeated entity-quarter keys"), ("dates", "dates that start no quarter"), ("signs", "negative values"), ("labels", "labels that disagree with dates")):
        if r[k]:
            raise PanelError(f"panel has {what}: {r[k]}")
    return panel


def assert_window(df: DataFrame, last: str) -> None:
    found = df.agg(F.max("quarter")).first()[0]
    if found is not None and found > period_start(last):
        raise LeakageError(f"values after {last}: {found}")


def window(panel: DataFrame, first: str, last: str) -> DataFrame:
    return panel.where(F.col("quarter").between(day(first), day(last)))


def coverage_grid(panel: DataFrame, *, first: str, last: str, values_to: str) -> DataFrame:
    """Every entity in every quarter, and why its value is there or not; magnitudes after ``values_to`` stay hidden."""
    dates = F.explode(F.sequence(day(first), day(last), F.expr("interval 3 months")))
    grid = panel.where("entity is not null").select("entity").distinct().select("entity", dates.alias("quarter"))
    d = grid.join(panel.select("entity", "quarter", "value", F.lit(True).alias("present")), ["entity", "quarter"], "left")
    own = Window.partitionBy("entity")
    d = d.withColumns({
        "row_present": F.coalesce("present", F.lit(False)),
        "first_present": F.min(F.when(F.col("present"), F.col("quarter"))).over(own), "last_present": F.max(F.when(F.col("present"), F.col("quarter"))).over(own),
    })
    here, open_ = F.col("row_present"), F.col("quarter") <= day(values_to)
    status = (
        F.when(here & ~open_, "observed_masked").when(here & F.col("value").isNull(), "observed_null").when(here & (F.col("value") == 0), "observed_zero")
        .when(here & (F.col("value") > 0), "observed_positive").when(F.col("quarter") < F.col("first_present"), "leading_absence")
        .when(F.col("quarter") > F.col("last_present"), "trailing_absence").otherwise("internal_absence"))
    return d.select("entity", "quarter", label(F.col("quarter")).alias("period"), "row_present", (here & F.col("value").isNotNull()).alias("target_observed"),
                    "first_present", "last_present", status.alias("coverage_status"), F.when(open_, F.col("value")).alias("eda_target"))


def coverage_summary(grid: DataFrame) -> DataFrame:
    """Counts of each status by entity, for entities that are present at all."""
    here = F.when(F.col("row_present"), F.col("period"))
    d = grid.groupBy("entity").agg(F.min(here).alias("first_present"), F.max(here).alias("last_present"), F.count(here).alias("observed_rows"),
                                   *[F.count_if(F.col("coverage_status") == s).alias(s) for s in STATUSES])
    return d.where("observed_rows > 0")


def status_counts(grid: DataFrame) -> DataFrame:
    return grid.groupBy("coverage_status").agg(F.count("*").alias("cells"))


def window_overview(dev: DataFrame) -> DataFrame:
    v = F.col("value")
    return dev.agg(F.count("*").alias("rows"), F.count_distinct("entity").alias("entities"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
                   F.count_if(v.isNull()).alias("null_values"), F.count_if(v == 0).alias("zero_values"), F.count_if(v > 0).alias("positive_values"))


def national_series(panel: DataFrame) -> DataFrame:
    return panel.groupBy("quarter").agg(F.min("period").alias("period"), F.sum("value").alias("value"), F.count("value").alias("observed_entities"))


def target_summary(dev: DataFrame) -> DataFrame:
    v = F.col("value")
    d = dev.groupBy("entity").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(v).alias("observed_periods"), F.count_if(v == 0).alias("zero_periods"),
        F.count_if(v > 0).alias("positive_periods"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return d.withColumn("zero_share", F.try_divide("zero_periods", "observed_periods")).orderBy(F.desc("total"), "entity")  # largest first


def calendar_changes(dev: DataFrame, *, threshold: float = 3.5) -> DataFrame:
    """Quarter and year changes, and each entity's robust z of the log year change.

    0.67448975 (a fixed value) makes the median absolute deviation comparable to a normal standard deviation.
    """
    v = F.col("value")
    d = dev.select("entity", "quarter", "period", "value", at_offset(v, -1, "entity").alias("lag1"), at_offset(v, -4, "entity").alias("lag4"))
    d = d.withColumns({"qoq": v - F.col("lag1"), "yoy": v - F.col("lag4"), "log_yoy": F.log1p("value") - F.log1p("lag4")})
    own = Window.partitionBy("entity")
    d = d.withColumn("mid", F.median("log_yoy").over(own)).withColumn("mad", F.median(F.abs(F.col("log_yoy") - F.col("mid"))).over(own))
    d = d.withColumn("robust_z", F.when(F.col("mad") > 0, F.lit(0.67448975) * (F.col("log_yoy") - F.col("mid")) / F.col("mad")))
    return d.drop("mid", "mad").withColumns({"outlier": F.coalesce(F.abs("robust_z") >= threshold, F.lit(False)), "abs_yoy": F.abs("yoy")})


def flag_counts(changes: DataFrame, by: str = "year") -> DataFrame:
    key = F.year("quarter") if by == "year" else F.col(by)
    return changes.where("outlier").groupBy(key.alias(by)).agg(F.count("*").alias("flags"))


def drilldown(changes: DataFrame, units: DataFrame) -> DataFrame:
    """The unit rows behind flagged entity-quarters.

    The key names an aggregate's result, so that what the join infers about quarters stays above the rollup; pushed below, these
    conditions parse each record's text many times more.  A semi join may go below it as a whole; an inner join with the distinct flags does not.
    """
    flags = changes.where("outlier").select(F.col("entity"), F.col("quarter").alias("_flagged")).distinct()
    keyed = units.withColumn("_flagged", F.when(F.col("source_rows") > 0, F.col("quarter")))
    return keyed.join(flags, ["entity", "_flagged"]).select(units.columns)


def drilldown_summary(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    return rows.groupBy("entity", "period").agg(F.count("*").alias("unit_rows"), F.count(v).alias("observed_units"), exact_sum(v).alias("value"), F.max(v).alias("largest"))


def top_contributors(rows: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest units of each entity and period, with their shares.

    Totals are combined on the map side; only the ``n`` largest need an order, and the group limit keeps that many a task.
    """
    d = cut(rows.where("value is not null").select("entity", "period", "unit_id", "value"))
    totals = d.groupBy(F.col("entity").alias("_entity"), F.col("period").alias("_period")).agg(F.sum("value").alias("total"))
    place = F.row_number().over(Window.partitionBy("entity", "period").orderBy(F.desc("value"), "unit_id"))
    best = d.withColumn("rank", place).where(F.col("rank") <= n)
    same = F.col("entity").eqNullSafe(F.col("_entity")) & F.col("period").eqNullSafe(F.col("_period"))
    share = F.when(F.col("total") > 0, F.col("value") / F.col("total"))
    return best.join(totals, same).select("entity", "period", "unit_id", "value", share.alias("share"), "rank")


def seasonal_share(dev: DataFrame) -> DataFrame:
    """Each quarter's share of the year, over entity-years with four values and a positive total."""
    own = Window.partitionBy("entity", "cal_year")
    d = dev.withColumns({"n": F.count("value").over(own), "year_total": F.sum("value").over(own)}).where("n = 4 and year_total > 0")
    d = cut(d.select("cal_quarter", (F.col("value") / F.col("year_total")).alias("share")))
    years = d.groupBy("cal_quarter").agg(F.count("*").alias("entity_years"))
    return with_quantiles(years, d, ["cal_quarter"], "share", {"median": 0.5, "q25": 0.25, "q75": 0.75})


def concentration(dev: DataFrame, top: int = 5) -> DataFrame:
    """By quarter: total, entities, the largest ones' share, and the Herfindahl index.

    Totals and sums of squares are combined on the map side; only the ``top`` values need an
    order, and the group limit keeps that many a task.
    """
    d = dev.where("value is not null")
    sums = d.groupBy("quarter").agg(F.min("period").alias("period"), F.sum("value").alias("total"), F.count_distinct("entity").alias("entities"), F.sum(F.col("value") ** 2).alias("squares"))
    place = F.row_number().over(Window.partitionBy("quarter").orderBy(F.desc("value"), "entity"))
    best = d.select("quarter", "value", place.alias("place")).where(F.col("place") <= top).groupBy("quarter").agg(F.sum("value").alias("top"))
    return sums.join(best, "quarter").select("quarter", "period", "total", "entities", F.when(F.col("total") != 0, F.col("top") / F.col("total")).alias("top_share"),
                                             F.when(F.col("total") != 0, F.col("squares") / F.col("total") ** 2).alias("hhi"))
