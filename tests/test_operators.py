import hashlib
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from lattiq.errors import EvaluationError, HoldoutError, LeakageError, PanelError
from lattiq.functions import periods as Q
from lattiq.operators import cells as C
from lattiq.operators import features as X
from lattiq.operators import final as Z
from lattiq.operators import metrics as M
from lattiq.operators import panel as P
from lattiq.operators import ridge as R
from lattiq.operators import uncertainty as U

PANEL = "entity string, cal_year int, cal_quarter int, period string, quarter date, value double"
EV = {"modeling_start": "2019Q1", "minimum_history": 8, "recent_quarters": 4}


def panel(spark, rows):
    out = []
    for entity, period, value in rows:
        d = Q.period_start(period)
        out.append((entity, d.year, (d.month + 2) // 3, period, d, value))
    return spark.createDataFrame(out, PANEL)


def ramp(spark, values, entity="AA", first="2019Q1"):
    return panel(spark, [(entity, Q.shift(first, i), v) for i, v in enumerate(values)])


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_periods():
    assert Q.quarters("2019Q3", "2020Q2") == ["2019Q3", "2019Q4", "2020Q1", "2020Q2"]
    assert Q.shift("2020Q1", -5) == "2018Q4" and Q.period_label(dt.date(2020, 7, 1)) == "2020Q3"
    for bad in ("2020Q5", "20Q1", "2020Q1 "):
        with pytest.raises(ValueError):
            Q.period_start(bad)
    with pytest.raises(ValueError):
        Q.quarters("2020Q2", "2020Q1")


def test_coverage_statuses(spark):
    p = panel(spark, [("AA", "2020Q2", 10.0), ("AA", "2020Q3", 0.0), ("AA", "2021Q1", None), ("AA", "2021Q2", 7.0)])
    g = by(P.coverage_grid(p, first="2020Q1", last="2021Q3", values_to="2021Q1"), "period")
    got = [g[(q,)]["coverage_status"] for q in Q.quarters("2020Q1", "2021Q3")]
    assert got == ["leading_absence", "observed_positive", "observed_zero", "internal_absence", "observed_null", "observed_masked", "trailing_absence"]
    assert g[("2021Q2",)]["eda_target"] is None
    s = P.coverage_summary(P.coverage_grid(p, first="2020Q1", last="2021Q3", values_to="2021Q1")).first()
    assert (s.observed_rows, s.internal_absence, s.observed_zero) == (4, 1, 1)


def test_calendar_lag_is_no_row_lag(spark):
    r = by(P.calendar_changes(panel(spark, [("AA", "2020Q1", 10.0), ("AA", "2020Q3", 15.0), ("AA", "2021Q1", 20.0)])), "period")
    assert r[("2020Q3",)]["qoq"] is None and r[("2021Q1",)]["qoq"] is None and r[("2021Q1",)]["yoy"] == 10.0
    assert not r[("2020Q1",)]["outlier"]


def test_panel_guards(spark):
    with pytest.raises(PanelError):
        P.validate_panel(panel(spark, [("AA", "2020Q1", 1.0), ("AA", "2020Q1", 2.0)]))
    with pytest.raises(PanelError):
        P.validate_panel(panel(spark, [("AA", "2020Q1", -1.0)]))
    with pytest.raises(PanelError):
        P.validate_panel(spark.createDataFrame([("AA", 2020, 1, "2020Q2", dt.date(2020, 1, 1), 1.0)], PANEL))
    with pytest.raises(LeakageError):
        P.assert_window(ramp(spark, [1.0, 2.0]), "2019Q1")


def test_eligibility_counts_zero_and_not_null(spark):
    rows = [("AA", q, v) for q, v in zip(Q.quarters("2020Q1", "2020Q4"), [1.0, 0.0, 2.0, 3.0], strict=True)]
    rows += [("BB", q, v) for q, v in zip(Q.quarters("2020Q1", "2020Q4"), [1.0, None, 2.0, 3.0], strict=True)]
    e = by(C.origin_eligibility(panel(spark, rows), ["2020Q4"], modeling_start="2020Q1", minimum_history=3, recent_quarters=4), "entity")
    assert e[("AA",)]["eligible"] and not e[("BB",)]["eligible"] and e[("BB",)]["history"] == 3 and e[("BB",)]["meets_history"]
    with pytest.raises(PanelError):
        C.origin_eligibility(panel(spark, rows), ["2019Q4"], modeling_start="2020Q1", minimum_history=3, recent_quarters=4)


@pytest.fixture(scope="module")
def ramp_forecasts(spark):
    p = ramp(spark, [float(i) for i in range(1, 13)])
    cells = C.forecast_cells(p, origins=["2020Q4"], target_end="2021Q4", **EV)
    return C.baseline_forecasts(cells, p).persist()


def test_ramp_golden(ramp_forecasts):
    f = by(ramp_forecasts, "model", "horizon")
    assert f[("persistence", 1)]["forecast"] == 8.0 and f[("seasonal_naive", 1)]["forecast"] == 5.0
    assert f[("persistence", 1)]["actual"] == 9.0 and f[("persistence", 4)]["actual"] == 12.0 and f[("persistence", 1)]["scale"] == 4.0
    m = by(M.overall_metrics(ramp_forecasts), "model", "horizon")[("persistence", 1)]
    assert math.isclose(m["wape"], 1 / 9) and (m["mae"], m["rmse"]) == (1.0, 1.0) and math.isclose(m["bias"], -1 / 9) and m["median_entity_mase"] == 0.25
    assert C.same_at(ramp_forecasts).where("not agree").isEmpty()


def test_missing_actual_is_unscored_with_a_reason(spark):
    p = ramp(spark, [1.0] * 8 + [None, 1.0, 1.0, 1.0])
    f = by(C.baseline_forecasts(C.forecast_cells(p, origins=["2020Q4"], target_end="2021Q4", **EV), p), "model", "horizon")
    r = f[("persistence", 1)]
    assert r["forecast"] == 1.0 and not r["scored"] and r["unscored_reason"] == "actual_missing" and r["scale"] == 0.0
    e = by(M.with_errors(C.baseline_forecasts(C.forecast_cells(p, origins=["2020Q4"], target_end="2021Q4", **EV), p)), "model", "horizon")
    assert e[("persistence", 2)]["scaled_error"] is None


def test_forecast_guards(spark):
    p = ramp(spark, [1.0] * 12)
    with pytest.raises(EvaluationError):
        C.forecast_cells(p, origins=["2020Q4"], target_end="2021Q3", **EV)
    with pytest.raises(EvaluationError):
        C.origin_labels({"start": "2020Q1", "end": "2020Q4", "count": 3})
    with pytest.raises(EvaluationError):
        C.origin_labels({"start": "2020Q1", "end": "2020Q4", "count": 4}, horizons=[4], before="2021Q4")


def test_volume_bands_share_ties(spark):
    rows = [("E%d" % i, dt.date(2020, 1, 1), 1, float(v), True) for i, v in enumerate([1, 2, 2, 2, 5, 6, 7, 8])]
    d = spark.createDataFrame(rows, "entity string, origin_date date, horizon int, actual double, actual_observed boolean")
    got = [by(M.volume_bands(d), "entity")[("E%d" % i,)]["volume_band"] for i in range(8)]
    pct = pd.Series([1, 2, 2, 2, 5, 6, 7, 8]).rank(pct=True)
    assert got == list(pd.cut(pct, [0, .25, .5, .75, 1], labels=["low", "medium", "high", "very_high"], include_lowest=True))


def test_conformal_quantile():
    assert U.finite_sample_quantile([1, 2, 3, 4], 0.8) == 4.0
    with pytest.raises(PanelError):
        U.finite_sample_quantile([], 0.8)


def preq(spark, rows):
    return spark.createDataFrame(rows, "origin_date date, entity string, horizon int, forecast double, actual double, scored boolean, scale double")


def test_prequential_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(Q.period_start(Q.shift("2019Q1", o)), e, h, float(f), None if rng.random() < .1 else float(f + rng.integers(-9, 9)), True, [0.0, 2.0, None][k % 3])
            for o in range(7) for k, e in enumerate("ABC") for h in (1, 2) for f in [rng.integers(50, 90)]]
    rows = [r if r[4] is not None else (*r[:5], False, r[6]) for r in rows]
    got = by(U.prequential_intervals(preq(spark, rows), warmup_origins=2), "origin_date", "entity", "horizon")
    dates = sorted({r[0] for r in rows})
    for o, e, h, f, _, _, s in rows:
        past = [(abs(r[3] - r[4]), r[6]) for r in rows if r[2] == h and r[0] < o and r[5]]
        pool = [x / y for x, y in past if y] if s else [x for x, _ in past]
        r = got[(o, e, h)]
        if o in dates[:2] or not pool:
            assert r["lower_80"] is None and r["interval_source"] == ""
        else:
            m = U.finite_sample_quantile(pool, 0.8) * (s or 1)
            assert math.isclose(r["lower_80"], max(0, f - m)) and math.isclose(r["upper_80"], f + m)


def test_interval_metrics(spark):
    d = spark.createDataFrame([(1, 10.0, 8.0, 13.0, True), (1, 20.0, 10.0, 15.0, True), (2, None, 1.0, 2.0, True)], "horizon int, actual double, lower_80 double, upper_80 double, interval_available_80 boolean")
    m = by(U.interval_metrics(d, (0.8,), pooled=True), "scope", "horizon")
    assert m[("horizon", 1)]["empirical_coverage"] == 0.5 and m[("horizon", 1)]["mean_width"] == 5.0 and math.isclose(m[("horizon", 1)]["mean_winkler"], (5 + 5 + 10 * 5) / 2)
    assert m[("horizon", 2)]["interval_cells"] == 0 and m[("horizon", 2)]["mean_width"] is None and m[("pooled", None)]["interval_cells"] == 2


@pytest.mark.parametrize("generator", ["numpy", "hash"])
def test_bootstrap_against_direct(spark, generator):
    rng = np.random.default_rng(1)
    rows = [(Q.period_start(Q.shift("2019Q1", o)), e, h, 100.0, 100.0 + float(rng.normal()), 100.0 + float(rng.normal())) for o in range(8) for e in "AB" for h in (1, 2)]
    d = spark.createDataFrame(rows, "origin_date date, entity string, horizon int, actual double, candidate_forecast double, comparator_forecast double")
    got = by(U.bootstrap_skill(d, block_length=3, replications=40, seed=9, generator=generator), "summary")
    draws = U.block_starts(8, block_length=3, replications=40, seed=9)
    if generator == "hash":
        start = lambda r, b: int(int(hashlib.md5(f"9:{r}:{b}".encode()).hexdigest()[:13], 16) / 2**52 * 6)
        draws = [[start(r, b) + k for b in range(3) for k in range(3)][:8] for r in range(40)]
    f = pd.DataFrame(rows, columns=["o", "e", "h", "a", "c", "b"])
    dates = sorted(f.o.unique())
    skill = {h: [] for h in (1, 2)}
    for s in draws:
        w = f.o.map(pd.Series([dates[i] for i in s]).value_counts()).fillna(0)
        for h in skill:
            k = f.h == h
            skill[h].append(1 - ((f.c - f.a).abs() * w)[k].sum() / ((f.b - f.a).abs() * w)[k].sum())
    assert math.isclose(got[("horizon_1",)]["lower_95"], np.percentile(skill[1], 2.5))
    assert math.isclose(got[("equal_weight_mean",)]["upper_95"], np.percentile(np.mean([skill[1], skill[2]], axis=0), 97.5))
    same = d.withColumn("comparator_forecast", d["candidate_forecast"])
    assert all(r.point_skill == 0 for r in U.bootstrap_skill(same, block_length=3, replications=5, seed=1).collect())


def test_quantiles_by_range_counts(spark):
    from lattiq.functions.ranks import quantiles, with_quantiles

    rng = np.random.default_rng(7)
    rows = [(k, int(v) / 4) for k in ("a", "b", None) for v in rng.integers(0, 60, 300 if k != "b" else 7)] + [("c", None), ("a", None), ("d", 1.5)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = {"low": 0.0, "q": 0.3, "median": 0.5, "q9": 0.975, "high": 1.0}
    got = {r.k: r for r in quantiles(d, ["k"], "v", at).collect()}
    assert got.keys() == {"a", "b", None, "d"}
    for k, r in got.items():
        own = [v for g, v in rows if g == k and v is not None]
        assert all(math.isclose(r[n], np.quantile(own, q)) for n, q in at.items())
    every = with_quantiles(d.select("k").distinct(), d, ["k"], "v", {"median": 0.5})
    assert {r.k: r.median for r in every.collect()}["c"] is None and every.count() == 5
    assert "percentile" not in every._jdf.queryExecution().toString()


def test_acf(spark):
    rows = [(Q.period_start(Q.shift("2015Q1", o)), e, 1, float(o if e == "A" else 5), 0.0, True) for o in range(16) for e in "AB"]
    d = spark.createDataFrame(rows, "origin_date date, entity string, horizon int, forecast double, actual double, scored boolean")
    r = by(U.residual_acf(d, lags=(1,), minimum_pairs=12), "entity")
    assert math.isclose(r[("A",)]["correlation"], 1.0) and r[("A",)]["pairs"] == 15 and r[("B",)]["correlation"] is None


def test_features_golden(spark):
    p = ramp(spark, [10., 20., 15., 0., 5., 15., 25., 30., 28., 35., 40., 42.])
    f = X.panel_features(p, modeling_start="2019Q1")
    r = by(X.training_examples(f, outer_origin="2020Q4", horizon=1, modeling_start="2019Q1", response="delta"), "pseudo_origin")
    x = r[("2020Q2",)]
    assert (x.level_t, x.raw_change_1, x.raw_change_2, x.raw_change_3, x.recent_zero_count, x.response) == (15.0, 10.0, 5.0, -15.0, 1, 10.0)
    assert set(r) == {("2019Q4",), ("2020Q1",), ("2020Q2",), ("2020Q3",)}
    assert by(f.where("horizon = 1"), "origin_date")[(dt.date(2019, 10, 1),)]["origin_index"] == 3


def plain_fit(train, ask, numeric, penalty, intercept):
    """The whole design with a one-hot column for each entity and quarter, solved at once."""
    x, z = train[numeric].to_numpy(float), ask[numeric].to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    std[x.min(0) == x.max(0)] = 1
    a, b, names = [(x - mean) / std], [(z - mean) / std], [f"numeric__{c}" for c in numeric]
    for c in ("entity", "target_quarter"):
        levels = sorted(set(train[c]))
        a.append((train[c].to_numpy()[:, None] == np.array(levels)).astype(float))
        b.append((ask[c].to_numpy()[:, None] == np.array(levels)).astype(float))
        names += [f"categorical__{c}_{v}" for v in levels]
    x, z, y = np.hstack(a), np.hstack(b), train["response"].to_numpy()
    mx, my = (x.mean(0), y.mean()) if intercept else (np.zeros(x.shape[1]), 0.0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + penalty * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    base = my - mx @ w
    raw = ask[numeric[0]].to_numpy(float) + z @ w + base
    varied = a[0][:, x[:, : len(numeric)].std(0) > 0]
    return np.expm1(np.maximum(0, raw)) if intercept else np.maximum(0, raw), raw < 0, dict(zip(names, w, strict=True)), base, np.linalg.cond(varied), np.triu(np.abs(np.corrcoef(varied, rowvar=False)), 1).max()


@pytest.mark.parametrize("response", ["log", "delta"])
def test_ridge_solves_the_penalised_problem(spark, response):
    rng = np.random.default_rng(4)
    labels = Q.quarters("2015Q1", "2022Q4")
    rows = [(e, Q.period_start(q), float(round(100 * k + 20 * (i % 4) + 3 * i + rng.normal() * 15))) for k, (e, first) in enumerate([("AA", 0), ("BB", 0), ("CC", 3), ("DD", 14)], 1) for i, q in enumerate(labels) if i >= first]
    panel = spark.createDataFrame([(e, d.year, (d.month + 2) // 3, Q.period_label(d), d, v) for e, d, v in rows], "entity string, cal_year int, cal_quarter int, period string, quarter date, value double")
    ev = {"modeling_start": "2015Q1", "minimum_history": 4, "recent_quarters": 4}
    cells = C.forecast_cells(panel, origins=["2019Q1", "2019Q3", "2021Q2"], target_end="2022Q4", **ev)
    x = X.panel_features(panel, modeling_start="2015Q1")
    alphas, numeric = [0.5, 50.0], X.LOG if response == "log" else X.DELTA
    got = R.rolling_candidates(x, cells, alphas=alphas, modeling_start="2015Q1", response=response)
    f, coef, diag = (got[k].toPandas() for k in ("forecasts", "coefficients", "diagnostics"))
    train, ask = X.supervised(x, modeling_start="2015Q1", response=response).toPandas(), X.prediction_features(x, cells, response=response).toPandas()
    assert len(f) == 2 * len(ask) and not f["seen"].all()
    for (origin, h), p in ask.groupby(["origin_date", "horizon"]):
        t = train[(train["horizon"] == h) & (train["target_date"] <= origin)]
        for alpha in alphas:
            want, floored, w, base, cond, corr = plain_fit(t, p, numeric, alpha, response == "log")
            own = f[(f["origin_date"] == origin) & (f["horizon"] == h) & (f["alpha"] == alpha)].set_index("entity").loc[list(p["entity"])]
            assert np.allclose(own["forecast"], want, rtol=1e-7) and list(own["floored"]) == list(floored) and list(own["seen"]) == [e in set(t["entity"]) for e in p["entity"]]
            c = coef[(coef["origin_date"] == origin) & (coef["horizon"] == h) & (coef["alpha"] == alpha)]
            assert set(c["feature"]) == set(w) and np.allclose(c["coefficient"], [w[k] for k in c["feature"]], atol=1e-7) and np.allclose(c["intercept"], base, atol=1e-7)
        r = diag[(diag["origin_date"] == origin) & (diag["horizon"] == h)].iloc[0]
        assert r["training_rows"] == len(t) and np.isclose(r["condition"], cond, rtol=1e-5) and np.isclose(r["correlation"], corr, rtol=1e-6)
    for bad in ([0.0], [float("nan")], []):
        with pytest.raises(PanelError):
            R.rolling_candidates(x, cells, alphas=bad, modeling_start="2015Q1", response=response)


def test_alpha_selection(spark):
    rows = [(0.1, 1, .9, 1., 1.), (0.1, 2, .9, 1., 1.), (1., 1, .90005, 1., 1.), (1., 2, .90005, 1., 1.), (10., 1, .1, 1., .9), (10., 2, .1, 1., 1.)]
    d = by(R.select_alpha(spark.createDataFrame(rows, "alpha double, horizon int, wape double, comparator_wape double, prediction_coverage double")), "alpha")
    assert d[(1.,)]["selected"] and not d[(0.1,)]["selected"] and not d[(10.,)]["eligible"]


def test_final_and_planning(spark):
    p = ramp(spark, [float(i) for i in range(1, 20)])
    dev_panel = P.window(p, "2019Q1", "2021Q4")
    dev = C.baseline_forecasts(C.forecast_cells(dev_panel, origins=["2020Q4"], target_end="2021Q4", **EV), dev_panel)
    tables = Z.evaluate_final(P.window(p, "2019Q1", "2022Q4"), p, dev, evaluation=EV, config={
        "development_end": "2020Q4", "holdout_origins": ["2021Q4"], "holdout_target_end": "2022Q4", "latest_origin": "2023Q3", "latest_target_end": "2024Q3", "snapshot": "s", "revision": "r", "mapping": Z.MAPPING, "coverages": (0.8, 0.95), "focus": (1, 2)})
    assert set(tables) == {"calibration_quantiles", "holdout_forecasts", "holdout_metrics", "holdout_entity_metrics", "holdout_origin_metrics", "holdout_volume_metrics", "holdout_interval_metrics", "latest_forecasts", "latest_planning_summary"}
    assert tables["holdout_forecasts"].count() == 4 and tables["latest_forecasts"].count() == 4 and tables["holdout_interval_metrics"].count() == 10
    assert tables["latest_planning_summary"].first()["priority"] == 1
    with pytest.raises(HoldoutError):
        U.calibration_quantiles(dev, development_end="2020Q3")
    other = Z.final_forecasts(p.withColumn("value", p["value"] * 1), tables["calibration_quantiles"], evaluation=EV, origins=["2021Q4"], target_end="2023Q3")
    assert [r.lower_80 for r in other.orderBy("horizon").collect()] == [r.lower_80 for r in tables["holdout_forecasts"].orderBy("horizon").collect()]


def test_audit_names_what_differs(spark):
    from lattiq.operators.metrics import audit

    d = spark.createDataFrame([("persistence", 1, 40, 0.123449, 1.23449), ("persistence", 2, 40, 0.2, 1.0)], "model string, horizon int, scored_cells long, wape double, median_entity_mase double")
    audit(d, {("persistence", 1): (40, 12.34, 1.234)})
    for want in ((41, 12.34, 1.234), (40, 12.35, 1.234), (40, 12.34, 1.235)):
        with pytest.raises(PanelError, match="persistence"):
            audit(d, {("persistence", 1): want})
    with pytest.raises(PanelError):
        audit(d, {("seasonal_naive", 1): (40, 12.34, 1.234)})


def test_sums_are_exact_and_huge_values_count(spark):
    from pyspark.sql import functions as F

    from lattiq.functions.text import exact_sum

    d = spark.createDataFrame([(1, 0.1)] * 10 + [(2, None), (3, 1e25), (3, 5.0), (4, 0.1), (4, None)], "k int, v double")
    got = {r.k: r.s for r in d.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {1: 1.0, 2: None, 3: 1e25 + 5.0, 4: 0.1}


def test_ranges_give_the_same_running_sums(spark):
    from lattiq.functions.ranks import running_sum

    rng = np.random.default_rng(3)
    rows = [(int(k), float(v), 1) for k, v in zip(rng.integers(0, 3, 500), rng.permutation(500), strict=True)] + [(9, None, 1)]
    d = spark.createDataFrame(rows, "k int, v double, n int")
    for r in running_sum(d, ["k"], ["v"]).collect():
        own = [x for x in rows if x[0] == r.k]
        assert r.cells == len(own) and r.upto == (1 if r.v is None else sum(x[1] is None or x[1] <= r.v for x in own))


def test_errors_without_a_place_have_no_quantile(spark):
    from lattiq.operators.uncertainty import order_statistics

    d = spark.createDataFrame([(1, float(i)) for i in range(1, 11)] + [(1, float("nan")), (1, float("inf")), (1, None), (2, float("nan"))], "horizon int, v double")
    got = {(r.horizon, r.coverage): (r.quantile, r.cells) for r in order_statistics(d, "v", ["horizon"]).collect()}
    assert got == {(1, 0.8): (9.0, 10), (1, 0.95): (10.0, 10)}
