"""The locked procedure: final forecasts with frozen intervals, latest forecasts, planning summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.errors import HoldoutError, PanelError
from lattiq.functions.ranks import running_sum
from lattiq.operators import cells as C
from lattiq.operators import metrics as M
from lattiq.operators import uncertainty as U
from lattiq.sources.sinks import cut

PROCEDURE = "horizon_specific_naive_baseline_v1"
MAPPING = {1: "persistence", 2: "persistence", 3: "seasonal_naive", 4: "persistence"}


def integrity(forecasts: DataFrame, *, latest: bool = False) -> DataFrame:
    """The forecasts, once one aggregate has found them all there, finite, not negative and, if latest, without actuals."""
    f = F.col("forecast")
    bad = F.isnan(f) | (F.abs(f) == float("inf")) | (f < 0)
    r = forecasts.agg(F.count("*").alias("n"), F.count_if(~F.col("prediction_available")).alias("gone"), F.count_if(bad).alias("bad"), F.count_if(F.col("actual").isNotNull() | F.col("scored")).alias("known")).first()
    if not r["n"] or r["gone"] or r["bad"]:
        raise PanelError("final forecasts must be there, finite and not negative")
    if latest and r["known"]:
        raise HoldoutError("latest forecasts hold actuals")
    return forecasts


def final_forecasts(panel: DataFrame, quantiles: DataFrame, *, evaluation: dict, origins: list[str], target_end: str, mapping=MAPPING, coverages=U.COVERAGES, name: str = "final_baseline", check: bool = True) -> DataFrame:
    d = C.forecast_cells(panel, origins=origins, target_end=target_end, check=check, **evaluation)
    d = C.select_by_horizon(C.baseline_forecasts(d, panel, check=check), mapping, name=name, check=check)
    return M.with_errors(U.frozen_intervals(d, quantiles, coverages, check=check))


def latest_forecasts(panel: DataFrame, quantiles: DataFrame, *, evaluation: dict, origin: str, target_end: str, snapshot: str, revision: str, mapping=MAPPING, coverages=U.COVERAGES, check: bool = True) -> DataFrame:
    d = final_forecasts(panel, quantiles, evaluation=evaluation, origins=[origin], target_end=target_end, mapping=mapping, coverages=coverages, check=check)
    d = d.withColumns({"source_snapshot": F.lit(snapshot), "revision_status": F.lit(revision)})
    return integrity(d, latest=True) if check else d


def planning_summary(latest: DataFrame, focus=(1, 2), *, check: bool = True) -> DataFrame:
    """One row an entity: near forecasts side by side, their mean and width, and the rank by mean."""
    own = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    cols = [own(h, c).alias(f"h{h}_{c}") for h in focus for c in ("target_period", "forecast", "lower_80", "upper_80")]
    d = latest.where(F.col("horizon").isin(*focus)).groupBy("entity").agg(*cols, F.count_distinct("horizon").alias("n"), F.avg("forecast").alias("near_mean"), F.avg(F.col("upper_80") - F.col("lower_80")).alias("near_width_80"))
    if check and not d.where(F.col("n") != len(focus)).isEmpty():
        raise PanelError("an entity lacks a near forecast")
    # Competition ranks: as many as have a larger mean, and one; counted by distinct mean, range by range.
    means = d.groupBy("near_mean").agg(F.count("*").alias("m"), F.lit(1).alias("all")).withColumn("order", F.coalesce(-F.col("near_mean"), F.lit(float("inf"))))
    ranks = running_sum(means, ["all"], ["order"], "m").select(F.col("near_mean").alias("mean"), (F.col("upto") - F.col("m") + 1).cast("int").alias("priority"))
    return d.drop("n").join(ranks, F.col("near_mean").eqNullSafe(F.col("mean"))).drop("mean")


def evaluate_final(holdout_panel: DataFrame, latest_panel: DataFrame, development: DataFrame, *, evaluation: dict, config: dict) -> dict[str, DataFrame]:
    """The nine result tables, for the models (``mapping``) and ``coverages`` that ``config`` names.  Call only after the holdout is opened."""
    mapping, coverages = config["mapping"], tuple(config["coverages"])
    own = {"evaluation": evaluation, "mapping": mapping, "coverages": coverages}
    dev = cut(C.select_by_horizon(development, mapping, name="final_baseline"))
    q = cut(U.calibration_quantiles(dev, development_end=config["development_end"], coverages=coverages))
    held = integrity(cut(final_forecasts(holdout_panel, q, origins=config["holdout_origins"], target_end=config["holdout_target_end"], **own)))
    overall = M.overall_metrics(held)
    M.assert_covered(overall)
    latest = cut(latest_forecasts(latest_panel, q, origin=config["latest_origin"], target_end=config["latest_target_end"], snapshot=config["snapshot"], revision=config["revision"], **own))
    return {
        "calibration_quantiles": q, "holdout_forecasts": held, "holdout_metrics": overall, "holdout_entity_metrics": M.entity_metrics(held), "holdout_origin_metrics": M.origin_metrics(held),
        "holdout_volume_metrics": M.volume_metrics(held), "holdout_interval_metrics": U.interval_metrics(held, coverages, pooled=True), "latest_forecasts": latest, "latest_planning_summary": planning_summary(latest, config["focus"]),
    }
