"""Registered queries over the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.periods import period_start, quarters
from lattiq.operators import cells as C
from lattiq.operators import features as X
from lattiq.operators import final as Z
from lattiq.operators import metrics as M
from lattiq.operators import panel as P
from lattiq.operators import quality as Q
from lattiq.operators import ridge as R
from lattiq.operators import rollup as L
from lattiq.operators import uncertainty as U
from lattiq.plans import tables as T
from lattiq.plans.sql import BOOTSTRAP, DELTA_ALPHAS, LOG_ALPHAS, PLACES, oracles
from lattiq.sources.sinks import cut

START = T.EVALUATION["modeling_start"]
ORIGINS = quarters(T.VALIDATION["start"], T.VALIDATION["end"])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` decimals, so that sums may be taken in any order; squares are too large to round."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" and c != "squared_error" else F.col(c) for c, k in df.dtypes])


def _dev(s, d):
    return P.window(T.panel(s, d), T.FIRST, T.VALUES_TO)


def _eligibility(s, d):
    return C.origin_eligibility(T.panel(s, d), ORIGINS, **T.EVALUATION)


def _cells(s, d):
    return C.forecast_cells(_dev(s, d), origins=ORIGINS, target_end=T.DEVELOPMENT_TARGET_END, check=False, **T.EVALUATION)


def _baseline(s, d):
    return C.baseline_forecasts(_cells(s, d), _dev(s, d), check=False)


def _final(s, d):
    return C.select_by_horizon(_baseline(s, d), Z.MAPPING, name="final_baseline", check=False)


def _quantiles(s, d):
    return U.calibration_quantiles(_final(s, d), development_end=T.VALIDATION["end"], check=False)


def _held(s, d):
    p = P.window(T.panel(s, d), T.FIRST, T.HOLDOUT_TARGET_END)
    return Z.final_forecasts(p, _quantiles(s, d), evaluation=T.EVALUATION, origins=quarters(T.HOLDOUT["start"], T.HOLDOUT["end"]), target_end=T.HOLDOUT_TARGET_END, check=False)


def _latest(s, d):
    return Z.latest_forecasts(T.panel(s, d), _quantiles(s, d), evaluation=T.EVALUATION, origin=T.LATEST, target_end=T.LATEST_TARGET_END, snapshot="tables", revision="revisable", check=False)


def _features(s, d):
    return X.panel_features(_dev(s, d), modeling_start=START)


def _candidates(s, d, response="log", alphas=LOG_ALPHAS):
    return R.rolling_candidates(_features(s, d), _cells(s, d), alphas=alphas, modeling_start=START, response=response, check=False)


def _ridge_forecasts(s, d, *how):
    f = _candidates(s, d, *how)["forecasts"].withColumn("forecast", F.round("forecast", PLACES))
    return f.select("alpha", "entity", "origin_date", "horizon", "forecast", "actual", "scored", "floored", "seen")


def _alpha(s, d, forecasts=None, base=None):
    f = _candidates(s, d)["forecasts"] if forecasts is None else forecasts
    m = M.with_errors(f).groupBy("alpha", "horizon").agg(*M.record())
    t = M.comparator_table(M.overall_metrics(_baseline(s, d) if base is None else base), Z.MAPPING).select("horizon", "comparator_wape")
    return R.select_alpha(m.join(t, "horizon"), check=False)


def _pairs(s, d):
    """The forecasts under the penalty that is selected, beside the comparator's."""
    f, base = cut(_candidates(s, d)["forecasts"]), cut(_baseline(s, d))
    best = f.join(F.broadcast(_alpha(s, d, f, base).where("selected").select("alpha")), "alpha")  # one row
    return R.pair_with_comparator(best, base, Z.MAPPING, check=False)


def _changes(s, d):
    return P.calendar_changes(_dev(s, d), threshold=2.0)


def _drill(s, d):
    return P.drilldown(_changes(s, d), T.units(s, d))


def _grid(s, d):
    return P.coverage_grid(T.panel(s, d), first=T.FIRST, last=T.LAST, values_to=T.VALUES_TO)


def _checks(s, d):
    raw, u = T.raw_records(s, d), T.units(s, d).persist()
    return Q.quality_checks(raw, T.records(s, d).persist(), T.master(s, d), u, L.entity_quarters(u))


def _overview(s, d):
    v = F.col("value")
    return T.units(s, d).agg(F.count("*").alias("rows"), F.count_distinct("entity").alias("entities"), F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v.isNull()).alias("all_null"))


def _comparator(s, d):
    return M.comparator_table(M.overall_metrics(_baseline(s, d)), Z.MAPPING)


def _acf(s, d):
    return U.residual_acf(_baseline(s, d).where("model = 'persistence'"), minimum_pairs=5)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "typed_ingest_projection": T.records,
    "mine_quarter_rollup": T.units,
    "state_quarter_rollup": lambda s, d: L.entity_quarters(T.units(s, d)),
    "quality_checks": _checks,
    "duplicate_keys": lambda s, d: Q.repeated_keys(T.records(s, d), "unit_id", "cal_year", "cal_quarter", "subunit"),
    "unmatched_ids": lambda s, d: Q.unmatched_ids(T.records(s, d), T.master(s, d)),
    "masked_projection": lambda s, d: L.masked(T.panel(s, d), period_start(T.VALUES_TO)),
    "panel_overview": _overview,
    "window_overview": lambda s, d: P.window_overview(_dev(s, d)),
    "national_series": lambda s, d: P.national_series(T.panel(s, d)),
    "coverage_grid": _grid,
    "coverage_summary": lambda s, d: P.coverage_summary(_grid(s, d)),
    "coverage_status_counts": lambda s, d: P.status_counts(_grid(s, d)),
    "target_summary": lambda s, d: P.target_summary(_dev(s, d)),
    "calendar_changes": lambda s, d: _changes(s, d).drop("robust_z", "outlier"),
    "robust_outliers": lambda s, d: _changes(s, d).select("entity", "quarter", "robust_z", "outlier"),
    "outlier_counts": lambda s, d: P.flag_counts(_changes(s, d)),
    "seasonal_share": lambda s, d: P.seasonal_share(_dev(s, d)),
    "concentration": lambda s, d: P.concentration(_dev(s, d)),
    "origin_eligibility": _eligibility,
    "eligible_counts": lambda s, d: C.eligible_counts(_eligibility(s, d)),
    "eligibility_transitions": lambda s, d: C.eligibility_transitions(_eligibility(s, d)),
    "seasonal_scale": lambda s, d: C.seasonal_scale(_dev(s, d), modeling_start=START),
    "forecast_cells": _cells,
    "baseline_forecasts": _baseline,
    "error_columns": lambda s, d: M.with_errors(_baseline(s, d)).select("model", "entity", "origin_date", "horizon", "error", "abs_error", "squared_error", "scaled_error"),
    "state_metrics": lambda s, d: M.entity_metrics(_baseline(s, d)),
    "overall_metrics": lambda s, d: M.overall_metrics(_baseline(s, d)),
    "origin_metrics": lambda s, d: M.origin_metrics(_baseline(s, d)),
    "volume_bands": lambda s, d: M.volume_bands(_baseline(s, d)),
    "volume_metrics": lambda s, d: M.volume_metrics(_baseline(s, d)),
    "mase_by_model": lambda s, d: M.mase_by_model(M.entity_metrics(_baseline(s, d)), C.MODELS),
    "comparator_table": _comparator,
    "h4_pivot_check": lambda s, d: C.same_at(_baseline(s, d)),
    "final_selection": _final,
    "calibration_quantiles": _quantiles,
    "frozen_intervals": _held,
    "interval_metrics": lambda s, d: U.interval_metrics(_held(s, d), pooled=True),
    "interval_guardrails": lambda s, d: U.guardrails(U.interval_metrics(_held(s, d), pooled=True), {0.80: (0.75, 0.85), 0.95: (0.90, 0.98)}),
    "prequential_intervals": lambda s, d: U.prequential_intervals(_final(s, d), warmup_origins=2).select("entity", "origin_date", "horizon", "lower_80", "upper_80", "lower_95", "upper_95", "interval_available_80", "interval_source"),
    "latest_forecasts": _latest,
    "planning_summary": lambda s, d: Z.planning_summary(_latest(s, d), check=False),
    "training_examples_log": lambda s, d: X.training_examples(_features(s, d), outer_origin="1998Q4", horizon=2, modeling_start=START),
    "training_examples_delta": lambda s, d: X.training_examples(_features(s, d), outer_origin="1998Q4", horizon=2, modeling_start=START, response="delta"),
    "prediction_features": lambda s, d: X.prediction_features(_features(s, d), _cells(s, d), check=False).select("entity", "origin_date", "horizon", *X.LOG, "target_quarter"),
    "comparator_pairs": lambda s, d: _comparator_pairs(s, d),
    "residual_acf": _acf,
    "acf_summary": lambda s, d: U.acf_summary(_acf(s, d)),
    "binned_residuals": lambda s, d: U.binned_residuals(_baseline(s, d).where("model = 'persistence'"), column="forecast"),
    "top_contributors": lambda s, d: P.top_contributors(_drill(s, d)),
    "drilldown": lambda s, d: P.drilldown_summary(_drill(s, d)),
    "ridge_log": lambda s, d: _ridge_forecasts(s, d),
    "ridge_delta": lambda s, d: _ridge_forecasts(s, d, "delta", DELTA_ALPHAS),
    "ridge_coefficients": lambda s, d: _candidates(s, d)["coefficients"],
    "ridge_training_diagnostics": lambda s, d: _candidates(s, d)["diagnostics"],
    "ridge_diagnostic_summary": lambda s, d: R.diagnostic_summary(_candidates(s, d, alphas=(1.0,))["forecasts"]).withColumn("mae", F.round("mae", PLACES)),
    "alpha_selection": _alpha,
    "bootstrap_skill": lambda s, d: U.bootstrap_skill(_pairs(s, d), **BOOTSTRAP),
    "bootstrap_baselines": lambda s, d: U.bootstrap_skill(_comparator_pairs(s, d), **BOOTSTRAP),
}


def _comparator_pairs(s, d):
    """Seasonal naive as the candidate, so that SQL can say the same."""
    b = _baseline(s, d)
    return R.pair_with_comparator(b.where("model = 'seasonal_naive'"), b, Z.MAPPING, check=False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to nation quarters to baseline forecasts to overall metrics."""
    p = P.window(T.panel(spark, sf_dir, "nation"), T.FIRST, T.VALUES_TO)
    cells = C.forecast_cells(p, origins=ORIGINS, target_end=T.DEVELOPMENT_TARGET_END, check=False, **T.EVALUATION)
    return rounded(M.overall_metrics(C.baseline_forecasts(cells, p, check=False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda s, d, f=f: rounded(f(s, d))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracles()
