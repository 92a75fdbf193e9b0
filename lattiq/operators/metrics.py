"""Forecast errors and their summaries by model, horizon, entity, origin and volume band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.errors import PanelError
from lattiq.functions.ranks import running_sum, with_quantiles
from lattiq.sources.sinks import cut


def with_errors(forecasts: DataFrame) -> DataFrame:
    d = forecasts.withColumn("error", F.col("forecast") - F.col("actual"))
    d = d.withColumns({"abs_error": F.abs("error"), "squared_error": F.col("error") ** 2})
    return d.withColumn("scaled_error", F.when(F.col("scale") > 0, F.col("abs_error") / F.col("scale")))


def _scored(c: str) -> Column:
    return F.when(F.col("scored"), F.col(c))


def _over(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def _volume() -> Column:
    return F.coalesce(F.sum(_scored("actual")), F.lit(0.0))


def record() -> list[Column]:
    """The base metrics of a group of forecast rows; what is undefined is null."""
    rows, have, scored = F.count("*"), F.count_if(F.col("prediction_available")), F.count_if(F.col("scored"))
    return [
        rows.alias("forecast_rows"), have.alias("predicted_rows"), scored.alias("scored_cells"), (have / rows).alias("prediction_coverage"),
        (scored / rows).alias("target_availability"), _volume().alias("actual_volume"), _over(F.sum(_scored("abs_error")), _volume()).alias("wape"),
        F.avg(_scored("abs_error")).alias("mae"), F.sqrt(F.avg(_scored("squared_error"))).alias("rmse"), F.avg(_scored("error")).alias("mean_error"),
        _over(F.sum(_scored("error")), _volume()).alias("bias"), F.count(_scored("scaled_error")).alias("mase_cells"),
    ]


def entity_metrics(forecasts: DataFrame) -> DataFrame:
    keep = {"forecast_rows", "scored_cells", "actual_volume", "wape", "mae", "rmse", "mean_error", "mase_cells"}
    d = with_errors(forecasts).groupBy("model", "horizon", "entity").agg(*record(), F.avg(_scored("scaled_error")).alias("mase"))
    return d.select("model", "horizon", "entity", "mase", *[c for c in d.columns if c in keep])


def overall_metrics(forecasts: DataFrame) -> DataFrame:
    """By model and horizon, with the mean and median over entities' own MASE."""
    mase = cut(entity_metrics(forecasts).select("model", "horizon", "mase"))
    own = mase.groupBy("model", "horizon").agg(F.avg("mase").alias("mean_entity_mase"), F.count("mase").alias("mase_entities"))
    own = with_quantiles(own, mase, ["model", "horizon"], "mase", {"median_entity_mase": 0.5})
    return with_errors(forecasts).groupBy("model", "horizon").agg(*record()).join(own, ["model", "horizon"], "left")


def origin_metrics(forecasts: DataFrame) -> DataFrame:
    return with_errors(forecasts).groupBy("model", "horizon", "origin", "origin_date").agg(*record())


def volume_bands(forecasts: DataFrame) -> DataFrame:
    """A band for each observed cell by its actual's rank among all cells (ties share their average rank).

    Ranks are made from counts by distinct value, whose running sum is made range by range.
    """
    cells = forecasts.where("actual_observed").groupBy("entity", "origin_date", "horizon").agg(F.first("actual").alias("actual"))
    values = running_sum(cells.groupBy("actual").agg(F.count("*").alias("n"), F.lit(1).alias("all")), ["all"], ["actual"])
    rank = values.select("actual", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("cells")).alias("p"))
    band = F.when(F.col("p") <= 0.25, "low").when(F.col("p") <= 0.5, "medium").when(F.col("p") <= 0.75, "high").otherwise("very_high")
    return cells.join(rank, "actual").select("entity", "origin_date", "horizon", band.alias("volume_band"))


def volume_metrics(forecasts: DataFrame) -> DataFrame:
    d = forecasts.where("scored").join(volume_bands(forecasts), ["entity", "origin_date", "horizon"])
    return with_errors(d).groupBy("model", "horizon", "volume_band").agg(*record())


def assert_covered(metrics: DataFrame) -> None:
    bad = metrics.where("prediction_coverage <> 1").select("model", "horizon").collect()
    if bad:
        raise PanelError("forecasts are missing for " + ", ".join(f"{r.model}/h{r.horizon}" for r in bad))


def audit(metrics: DataFrame, expected: dict[tuple[str, int], tuple[int, float, float]]) -> None:
    """Scored cells exactly, WAPE in per cent to two places, median MASE to three."""
    want = metrics.sparkSession.createDataFrame([(*k, int(c), float(w), float(m)) for k, (c, w, m) in expected.items()], "model string, horizon int, cells long, wape_percent double, mase double")
    have = metrics.select("model", "horizon", F.col("scored_cells").alias("have_cells"), F.round(F.col("wape") * 100, 2).alias("have_wape"), F.round("median_entity_mase", 3).alias("have_mase"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("cells", "have_cells"), ("wape_percent", "have_wape"), ("mase", "have_mase"))]
    bad = want.join(have, ["model", "horizon"], "left").where(~(same[0] & same[1] & same[2])).orderBy("model", "horizon").collect()  # a row for each model and horizon at most
    if bad:
        raise PanelError("audit: " + "; ".join(f"{r.model}/h{r.horizon}: {(r.have_cells, r.have_wape, r.have_mase)} instead of {(r.cells, r.wape_percent, r.mase)}" for r in bad))


def mase_by_model(metrics: DataFrame, models) -> DataFrame:
    """An entity's MASE averaged over horizons, a column for each model."""
    return metrics.groupBy("entity").pivot("model", list(models)).agg(F.avg("mase"))


def comparator_table(metrics: DataFrame, mapping: dict[int, str]) -> DataFrame:
    """Each horizon's WAPE by model side by side, their gap in basis points, and the mapped comparator's own."""
    a, b = "persistence", "seasonal_naive"
    d = metrics.groupBy("horizon").pivot("model", [a, b]).agg(F.first("wape"))
    use = F.coalesce(*[F.when((F.col("horizon") == h), F.struct(F.lit(m).alias("m"), F.col(m).alias("w"))) for h, m in mapping.items()])
    return d.withColumns({"gap_bp": F.abs(F.col(a) - F.col(b)) * 10_000, "comparator_model": use["m"], "comparator_wape": use["w"]})
