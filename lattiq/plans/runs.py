"""The four runs: build the dataset, evaluate baselines, select a candidate, evaluate the locked procedure."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.errors import ContractError, SelectionError
from lattiq.functions.periods import period_start, shift
from lattiq.operators import cells as C
from lattiq.operators import features as X
from lattiq.operators import final as Z
from lattiq.operators import guards as G
from lattiq.operators import metrics as M
from lattiq.operators import panel as P
from lattiq.operators import ridge as R
from lattiq.operators import uncertainty as U
from lattiq.operators.quality import quality_checks, verdict
from lattiq.operators.rollup import RAW, entity_quarters, master_units, typed_records, unit_quarters
from lattiq.plans import lineage as N
from lattiq.plans.holdout import Ledger
from lattiq.sources.delimited import FileSpec, scan, until, validate_raw_file
from lattiq.sources.sinks import cut


def build_dataset(spark: SparkSession, config: dict, files: dict[str, tuple[str, FileSpec]], runs_root: str | Path, *, names: dict[str, str], root: str | Path = ".") -> dict:
    """Raw files to unit-quarter and entity-quarter tables, with every contract and check on the way.

    ``files`` has ``records`` and ``master`` (path, spec); ``names`` maps the operators' field names to the files' columns.
    """
    started = dt.datetime.now(dt.UTC)
    status = {k: validate_raw_file(spark, p, s) for k, (p, s) in files.items()}
    pick = lambda k, cols: scan(spark, *files[k]).select(*[F.col(f"`{names[c]}`").alias(c) for c in cols])
    raw = pick("records", RAW)
    records = typed_records(raw, config.get("domain", "C")).persist()
    master = master_units(pick("master", ["unit_id", "entity", "domain"]))
    units = unit_quarters(records).persist()
    entities = entity_quarters(units).persist()
    try:
        observed = {r.check_name: r.observed_value for r in quality_checks(raw, records, master, units, entities).collect()}  # nineteen rows
        checks = verdict(observed, config["quality_expectations"])
        return N.write_run(
            {"unit_quarter": (units, ["quarter", "unit_id", "entity"], ["quarter"]), "entity_quarter": (entities, ["quarter", "entity"], ["quarter"])},  # a folder a quarter: what is after a cutoff isn't opened
            runs_root, stage="build", config=config, root=root, started=started, raw=status, checks=checks)
    finally:
        for d in (records, units, entities):
            d.unpersist()


def _evaluation(config: dict) -> dict:
    ev = config["evaluation"]
    return {"modeling_start": ev["modeling_start"], "minimum_history": ev["eligibility"]["minimum_non_null_history"], "recent_quarters": ev["eligibility"]["required_consecutive_recent_observations"]}


def development_tables(panel: DataFrame, config: dict, audit: dict | None = None) -> dict[str, DataFrame]:
    """Baseline forecasts over the development origins and their metrics; both models must agree four quarters ahead."""
    ev = config["evaluation"]
    horizons = ev["forecast_horizons"]
    origins = C.origin_labels(ev["validation_origins"], horizons=horizons, before=ev["holdout_origins"]["start"])
    end = shift(ev["validation_origins"]["end"], max(horizons))
    guards = G.Guards()  # watched while the tables below are made; no job is a guard's alone
    P.need(panel, "entity", "cal_year", "cal_quarter", "period", "quarter", "value")
    panel = cut(G.watched_panel(panel, guards, end))
    guards.settle()
    cells = cut(C.forecast_cells(panel, origins=origins, target_end=end, horizons=horizons, check=False, **_evaluation(config)))
    f = cut(G.watched_baselines(C.baseline_forecasts(cells, panel, check=False), guards, equal_at=4 if 4 in horizons else None))
    guards.settle()
    overall = cut(M.overall_metrics(f))
    if audit:
        M.audit(overall, audit)
    return {"forecasts": f, "metrics": overall, "entity_metrics": M.entity_metrics(f), "origin_metrics": M.origin_metrics(f), "volume_metrics": M.volume_metrics(f)}


_KEYS = {"forecasts": ["model", "origin_date", "entity", "horizon"], "metrics": ["model", "horizon"], "entity_metrics": ["model", "horizon", "entity"],
         "origin_metrics": ["model", "horizon", "origin_date"], "volume_metrics": ["model", "horizon", "volume_band"]}


#: What a run of baselines has to say of itself before others build on it.
BASELINE_CHECKS = {"prediction_coverage": "passed", "horizon_four_equality": "passed", "holdout_opened": False}


def run_baselines(spark: SparkSession, config: dict, runs_root: str | Path, *, root: str | Path = ".", audit: dict | None = None) -> dict:
    """Baselines of the newest build.  With ``audit`` its figures must come out, and the manifest says that they did."""
    started = dt.datetime.now(dt.UTC)
    source = N.latest_manifest(spark, runs_root, stage="build", config=config)
    ev = config["evaluation"]
    end = period_start(shift(ev["validation_origins"]["end"], max(ev["forecast_horizons"])))
    panel = until(N.artifact(spark, runs_root, source["outputs"]["entity_quarter"]), end)
    tables = development_tables(panel, config, audit)
    checks = BASELINE_CHECKS | {"frozen_baseline_audit": "passed" if audit else "not_requested"}
    return N.write_run({k: (d, _KEYS[k]) for k, d in tables.items()}, runs_root, stage="baselines", config=config, root=root, started=started, source_run=source["run_id"], checks=checks)


def baseline_manifest(spark: SparkSession, config: dict, runs_root: str | Path, build: dict) -> dict:
    """The newest passed baselines of this build, with every check; a project that freezes figures (``evaluation.baseline_audit``) needs their audit, too."""
    audited = {"frozen_baseline_audit": "passed"} if config["evaluation"].get("baseline_audit") else {}
    return N.latest_manifest(spark, runs_root, stage="baselines", config=config, source_run=build["run_id"], checks=BASELINE_CHECKS | audited)


def selection_tables(panel: DataFrame, config: dict, candidate: dict) -> dict[str, DataFrame]:
    """All of candidate selection: forecasts for every penalty, the penalty chosen, its intervals, diagnostics and skill."""
    N.check_candidate_keys(candidate)
    ev, block = config["evaluation"], candidate["selection_origins"]
    if period_start(block["end"]) >= period_start(candidate["confirmation_origins"]["start"]):
        raise SelectionError("selection and confirmation overlap")
    end = shift(block["end"], max(ev["forecast_horizons"]))
    last = panel.agg(F.max("quarter")).first()[0]
    if last is not None and last > period_start(end):
        raise SelectionError(f"selection was given values after {end}")
    panel = cut(P.validate_panel(panel))
    cells = cut(C.forecast_cells(panel, origins=C.origin_labels(block), target_end=end, **_evaluation(config)))
    base = cut(C.baseline_forecasts(cells, panel))
    if "procedure_id" in candidate:
        N.check_candidate_config(candidate)
    response = N.CANDIDATES[candidate["procedure_id"]][0] if "procedure_id" in candidate else candidate.get("response", "log")
    own = candidate.get("intervals", {})
    coverages, warmup = tuple(map(float, own.get("coverages", U.COVERAGES))), int(own.get("warmup_origins", 8))
    x = cut(X.panel_features(panel, modeling_start=ev["modeling_start"]))
    got = R.rolling_candidates(x, cells, alphas=candidate["alphas"], modeling_start=ev["modeling_start"], response=response)
    f = cut(got["forecasts"])
    overall = M.overall_metrics(base)
    comparators = M.comparator_table(overall, Z.MAPPING)
    by_alpha = M.with_errors(f).groupBy("alpha", "horizon").agg(*M.record()).join(comparators.select("horizon", "comparator_model", "comparator_wape"), "horizon")
    by_alpha = cut(by_alpha)
    chosen = cut(R.select_alpha(by_alpha, float(candidate.get("tie_tolerance", 1e-4))))
    best = cut(f.join(F.broadcast(chosen.where("selected").select("alpha")), "alpha"))  # one row
    pairs = cut(R.pair_with_comparator(best, base, Z.MAPPING))
    intervals = U.prequential_intervals(best, warmup_origins=warmup, coverages=coverages)
    selected = cut(M.overall_metrics(best))
    M.assert_covered(selected)
    shown = U.selection_only(best, block["end"])
    acf = U.residual_acf(shown)
    numeric = X.LOG if response == "log" else X.DELTA
    seen = cut(shown.join(X.prediction_features(x, cells, response=response).select("entity", "origin_date", "horizon", *numeric), ["entity", "origin_date", "horizon"], "left"))
    bins = [U.binned_residuals(seen, column=c) for c in ("forecast", *numeric)]
    for more in bins[1:]:
        bins[0] = bins[0].unionByName(more)
    gates = candidate.get("gates")
    boot = candidate["bootstrap"]
    return {
        "cells": cells, "baseline_forecasts": base, "baseline_metrics": overall, "candidate_forecasts": f, "alpha_metrics": by_alpha, "alpha_summary": chosen, "selected_forecasts": intervals,
        "selected_metrics": selected, "selected_entity_metrics": M.entity_metrics(best), "selected_origin_metrics": M.origin_metrics(best), "selected_volume_metrics": M.volume_metrics(best), "interval_metrics": U.interval_metrics(intervals, coverages),
        "coefficients": got["coefficients"], "training_diagnostics": got["diagnostics"], "diagnostic_summary": R.diagnostic_summary(best), "residual_acf": acf, "acf_summary": U.acf_summary(acf),
        "binned_residuals": bins[0], "pairs": pairs, "bootstrap_skill": U.bootstrap_skill(pairs, **boot, generator="numpy"),
        **({"promotion": R.promotion(panel.sparkSession, {f"wape_h{r.horizon}": r.wape for r in selected.collect()}, gates)} if gates else {}),
    }


#: What a selection run has looked at: its diagnostics wait for a reader, and nothing after its block was opened.
SELECTION_STATUS = {"prediction_coverage": "passed", "diagnostic_gate_status": "awaiting_review", "confirmation_opened": False, "holdout_opened": False}


def run_selection(spark: SparkSession, config: dict, candidate: dict, runs_root: str | Path, *, root: str | Path = ".") -> dict:
    """Selection over the newest build; its baselines must have passed their checks."""
    started = dt.datetime.now(dt.UTC)
    N.check_candidate_config(candidate)
    source = N.latest_manifest(spark, runs_root, stage="build", config=config)
    base = baseline_manifest(spark, config, runs_root, source)
    end = period_start(shift(candidate["selection_origins"]["end"], max(config["evaluation"]["forecast_horizons"])))
    panel = until(N.artifact(spark, runs_root, source["outputs"]["entity_quarter"]), end)
    tables = selection_tables(panel, config, candidate)
    return N.write_run({k: (d, d.columns[:3]) for k, d in tables.items()}, runs_root, stage="selection", config=config, root=root, started=started, source_run=source["run_id"], baseline_run=base["run_id"], candidate_sha256=N.config_hash(candidate), checks=SELECTION_STATUS)


FINAL_TABLES = {"calibration_quantiles", "holdout_forecasts", "holdout_metrics", "holdout_entity_metrics", "holdout_origin_metrics", "holdout_volume_metrics", "holdout_interval_metrics", "latest_forecasts", "latest_planning_summary"}


#: What a passed final run has done: guards that raise else, and the holdout that it opened and left closed to others.
FINAL_CHECKS = {"prediction_coverage": "passed", "forecast_integrity": "passed", "holdout_opened": True, "holdout_closed": True}


def run_final(spark: SparkSession, config: dict, final: dict, runs_root: str | Path, *, open_holdout: bool = False, root: str | Path = ".") -> dict:
    """The locked procedure, once: a second call gives back the run that passed."""
    started = dt.datetime.now(dt.UTC)
    N.check_final_config(final, config)
    procedure = N.config_hash(final)
    try:
        passed = N.latest_manifest(spark, runs_root, stage="final", config=config, procedure_sha256=procedure, names=FINAL_TABLES)
    except ContractError:
        passed = None
    build = N.latest_manifest(spark, runs_root, stage="build", config=config)
    base = baseline_manifest(spark, config, runs_root, build)
    ledger = Ledger(spark, str(runs_root))
    if ledger.admit(procedure, consent=open_holdout, passed=passed and passed["run_id"]):
        return passed | {"mode": "reuse", "tables": N.load_outputs(spark, runs_root, passed)}
    panel = N.artifact(spark, runs_root, build["outputs"]["entity_quarter"])  # holdout scans are made after the ledger has opened it
    held, latest = final["holdout_origins"], final["latest_forecast"]
    tables = Z.evaluate_final(
        until(panel, period_start(held["target_end"])), until(panel, period_start(latest["origin"])),
        N.artifact(spark, runs_root, base["outputs"]["forecasts"]), evaluation=_evaluation(config),
        config={"development_end": final["development_calibration_origins"]["end"], "holdout_origins": C.origin_labels(held), "holdout_target_end": held["target_end"],
                "latest_origin": latest["origin"], "latest_target_end": latest["target_end"], "snapshot": config.get("snapshot", {}).get("checkpoint_id", ""), "revision": latest["revision_status"],
                "mapping": {int(h): m for h, m in final["models_by_horizon"].items()}, "coverages": final["intervals"]["coverages"], "focus": tuple(final["reporting"]["operational_focus_horizons"])})
    m = N.write_run({k: (d, d.columns[:3]) for k, d in tables.items()}, runs_root, stage="final", config=config, root=root, started=started, procedure_sha256=procedure, source_run=build["run_id"], baseline_run=base["run_id"], checks=FINAL_CHECKS)
    ledger.settle(procedure, m["run_id"])
    return m | {"mode": "new", "tables": tables}
