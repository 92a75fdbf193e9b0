"""Forecast cells: eligibility at an origin, scale, targets, baseline forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.errors import EvaluationError, PanelError
from lattiq.functions.periods import at_offset, day, label, moved, period_start, quarters, shift
from lattiq.operators.panel import need, unique

MODELS = ("persistence", "seasonal_naive")


def origin_labels(block: dict, *, horizons=(), before: str | None = None) -> list[str]:
    """The origins of a block {start, end, count}; targets of ``horizons`` must end before the quarter ``before``."""
    out = quarters(block["start"], block["end"])
    if len(out) != block["count"]:
        raise EvaluationError(f"{block['count']} origins declared, {len(out)} found")
    if before and horizons and period_start(shift(block["end"], max(horizons))) >= period_start(before):
        raise EvaluationError("targets reach into the next block")
    return out


def origin_eligibility(panel: DataFrame, origins: list[str], *, modeling_start: str, minimum_history: int, recent_quarters: int) -> DataFrame:
    """One row for each origin and entity.

    All origins' counts are one aggregate by entity, combined on the map side; rows are not multiplied by origins.
    """
    for o in origins:
        if period_start(o) < period_start(modeling_start):
            raise PanelError(f"origin {o} precedes {modeling_start}")
    seen = F.col("value").isNotNull()
    counts = []
    for i, o in enumerate(origins):
        counts += [F.count_if(seen & F.col("quarter").between(day(modeling_start), day(o))).alias(f"h{i}"),
                   F.count_if(seen & F.col("quarter").between(day(shift(o, 1 - recent_quarters)), day(o))).alias(f"r{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("origin"), day(o).alias("origin_date"), F.col(f"h{i}").alias("history"), F.col(f"r{i}").alias("recent")) for i, o in enumerate(origins)]))
    d = panel.where("entity is not null").groupBy("entity").agg(*counts).select("entity", rows.alias("x")).select("entity", "x.*")
    d = d.withColumns({"meets_history": F.col("history") >= minimum_history, "meets_recent": F.col("recent") == recent_quarters})
    return d.withColumn("eligible", F.col("meets_history") & F.col("meets_recent"))


def eligibility_transitions(eligibility: DataFrame) -> DataFrame:
    was = F.lag("eligible").over(Window.partitionBy("entity").orderBy("origin_date"))
    d = eligibility.withColumn("was", was).where("was is not null and eligible <> was")
    return d.select("origin", "origin_date", "entity", F.when(F.col("eligible"), "entered").otherwise("exited").alias("transition"), "history", "recent")


def eligible_counts(eligibility: DataFrame) -> DataFrame:
    return eligibility.groupBy("origin", "origin_date").agg(F.count_if(F.col("eligible")).alias("eligible"))


def seasonal_scale(panel: DataFrame, *, modeling_start: str) -> DataFrame:
    """At each quarter: the mean of all yearly absolute differences so far, and how many there are."""
    d = panel.where(F.col("quarter") >= day(modeling_start))
    d = d.withColumn("diff", F.abs(F.col("value") - at_offset(F.col("value"), -4, "entity")))
    so_far = Window.partitionBy("entity").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("entity", "quarter", F.avg("diff").over(so_far).alias("scale"), F.count("diff").over(so_far).alias("scale_n"))


def forecast_cells(panel: DataFrame, *, origins: list[str], target_end: str, modeling_start: str, minimum_history: int, recent_quarters: int, horizons=(1, 2, 3, 4), check: bool = True) -> DataFrame:
    """Eligible entity x origin x horizon, with scale at the origin and the actual value at the target."""
    if check:
        last = panel.agg(F.max("quarter")).first()[0]
        if last is not None and last > period_start(target_end):
            raise EvaluationError(f"values after {target_end}")
    if any(period_start(shift(o, h)) > period_start(target_end) for o in origins for h in horizons):
        raise EvaluationError(f"targets after {target_end}")
    e = origin_eligibility(panel, origins, modeling_start=modeling_start, minimum_history=minimum_history, recent_quarters=recent_quarters).where("eligible")
    s = seasonal_scale(panel, modeling_start=modeling_start).withColumnRenamed("quarter", "origin_date")
    d = e.join(s, ["entity", "origin_date"], "left").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    d = d.withColumn("target_date", moved(F.col("origin_date"), F.col("horizon")))
    actual = panel.select("entity", F.col("quarter").alias("target_date"), F.col("value").alias("actual"))
    d = d.join(actual, ["entity", "target_date"], "left")
    return d.select("entity", "origin", "origin_date", label(F.col("target_date")).alias("target_period"), "target_date", "horizon", "eligible", "history", "recent", "actual", "scale", "scale_n")


def flags(d: DataFrame) -> DataFrame:
    """Whether a forecast is there, was observed, is scored, and if not, why."""
    f, a = F.col("forecast").isNotNull(), F.col("actual").isNotNull()
    why = F.when(~a & ~f, "actual_and_forecast_missing").when(~a, "actual_missing").when(~f, "forecast_missing").otherwise("")
    return d.withColumns({"prediction_available": f, "actual_observed": a, "scored": f & a, "unscored_reason": why})


def baseline_forecasts(cells: DataFrame, panel: DataFrame, *, check: bool = True) -> DataFrame:
    """Persistence repeats the origin's value, seasonal naive that of the target's quarter a year earlier."""
    need(cells, "entity", "origin", "origin_date", "target_period", "target_date", "horizon", "eligible", "actual", "scale", "scale_n")
    if check:
        unique(cells, "entity", "origin_date", "horizon")
        if not cells.where("not eligible").isEmpty():
            raise PanelError("only eligible cells are forecast")
    d = cells.withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    source = F.when(F.col("model") == "persistence", F.col("origin_date")).otherwise(moved(F.col("target_date"), -4))
    d = d.withColumn("source_date", source)
    if check and not d.where("source_date > origin_date").isEmpty():
        raise PanelError("a forecast uses what came after its origin")
    value = panel.select("entity", F.col("quarter").alias("source_date"), F.col("value").alias("forecast"))
    return flags(d.join(value, ["entity", "source_date"], "left").withColumn("source_period", label(F.col("source_date"))))


def by_horizon(mapping: dict[int, str]) -> Column:
    """The model that a horizon maps to."""
    return F.coalesce(*[F.when(F.col("horizon") == h, F.lit(m)) for h, m in mapping.items()])


def select_by_horizon(forecasts: DataFrame, mapping: dict[int, str], *, name: str | None = None, check: bool = True) -> DataFrame:
    """One model's rows for each horizon; with ``name`` it becomes the model, and the source model is kept."""
    d = forecasts.where(F.col("model") == by_horizon(mapping))
    if check:
        have = {r[0] for r in d.select("horizon").distinct().collect()}
        if have != set(mapping):
            raise PanelError(f"no forecasts for horizons {sorted(set(mapping) - have)}")
        unique(d, "entity", "origin_date", "target_date", "horizon")
    return d.withColumns({"source_model": F.col("model"), "model": F.lit(name)}) if name else d


def same_at(forecasts: DataFrame, horizon: int = 4) -> DataFrame:
    """The models side by side at one horizon, and whether they agree (nulls agree)."""
    d = forecasts.where(F.col("horizon") == horizon).groupBy("entity", "origin_date").pivot("model", list(MODELS)).agg(F.first("forecast"))
    return d.withColumn("agree", F.col(MODELS[0]).eqNullSafe(F.col(MODELS[1])))
