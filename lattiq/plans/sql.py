"""DuckDB statements equal to the registered queries, put together from shared common table expressions."""

from __future__ import annotations

from lattiq.functions.periods import period_start, quarters
from lattiq.plans import tables as T

START, TO, LAST = (f"DATE '{period_start(x)}'" for x in (T.EVALUATION["modeling_start"], T.VALUES_TO, T.LAST))
H, K = T.EVALUATION["minimum_history"], T.EVALUATION["recent_quarters"]
QIDX = "(year({0})*4+quarter({0}))"


def _origins(labels: list[str]) -> str:
    return ", ".join(f"('{o}', DATE '{period_start(o)}')" for o in labels)


CLEAN = "nullif(trim(trim({0}), '\"'), '')"
RAW = """raw AS (SELECT '"' || o_custkey || '"' AS unit_id, 'Unit ' || o_custkey AS unit_name, ' ' || lower(n_name) || '/' || c_mktsegment AS entity,
    o_orderpriority AS subunit, year(o_orderdate)::VARCHAR AS cal_year, quarter(o_orderdate)::VARCHAR AS cal_quarter, (o_orderkey % 50)::VARCHAR AS employees,
    (o_orderkey % 1000)::VARCHAR AS hours, CASE WHEN o_orderstatus='P' THEN '' WHEN o_orderpriority='5-LOW' THEN '0' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS value,
    CASE WHEN o_orderkey % 10 = 0 THEN 'M' ELSE ' c ' END AS domain
    FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)"""
_c = CLEAN.format
RECORDS = RAW + f""",
records AS (SELECT {_c('unit_id')} AS unit_id, {_c('unit_name')} AS unit_name, upper({_c('entity')}) AS entity, {_c('subunit')} AS subunit,
    TRY_CAST({_c('cal_year')} AS INTEGER) AS cal_year, TRY_CAST({_c('cal_quarter')} AS INTEGER) AS cal_quarter, TRY_CAST({_c('employees')} AS DOUBLE) AS employees,
    TRY_CAST({_c('hours')} AS DOUBLE) AS hours, TRY_CAST({_c('value')} AS DOUBLE) AS value, {_c('value')} AS value_raw FROM raw WHERE upper(trim(trim(domain), '"')) = 'C')"""
MASTER = """mr AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0),
master AS (SELECT c_custkey::VARCHAR AS unit_id FROM mr)"""
_s = lambda c: f"sum({c}::DECIMAL(28,6))::DOUBLE"
UNITS = RECORDS + f""",
units AS (SELECT unit_id, entity, cal_year, cal_quarter, {_s('value')} AS value, {_s('employees')} AS employees, {_s('hours')} AS hours, count(*) AS source_rows,
    count(value) AS reported_rows, count(*)-count(value) AS missing_rows, count(value)=0 AS all_null, count(value)>0 AND count(value)<count(*) AS partly_null,
    cal_year::VARCHAR || 'Q' || cal_quarter::VARCHAR AS period,
    CASE WHEN cal_year IS NOT NULL AND cal_quarter BETWEEN 1 AND 4 THEN make_date(cal_year, (cal_quarter-1)*3+1, 1) END AS quarter FROM records GROUP BY 1,2,3,4)"""
ENTITIES = UNITS + f""",
eq AS (SELECT entity, cal_year, cal_quarter, period, quarter, {_s('value')} AS value, count(*) AS unit_rows, count(value) AS observed_units, count(*)-count(value) AS all_null_units,
    count(*) FILTER (WHERE value>0) AS positive_units, count(*) FILTER (WHERE value=0) AS zero_units, count(*) FILTER (WHERE partly_null) AS partly_null_units,
    sum(source_rows)::BIGINT AS source_rows, {_s('employees')} AS employees, {_s('hours')} AS hours FROM units GROUP BY 1,2,3,4,5)"""
PANEL = ENTITIES + """,
p AS (SELECT entity, cal_year, cal_quarter, period, quarter, value FROM eq WHERE quarter IS NOT NULL)"""
DEV = PANEL + f",\ndev AS (SELECT * FROM p WHERE quarter BETWEEN DATE '1995-01-01' AND {TO})"
CHANGES = DEV + """,
c0 AS (SELECT a.entity, a.quarter, a.period, a.value, b.value AS lag1, c.value AS lag4 FROM dev a
    LEFT JOIN dev b ON a.entity=b.entity AND b.quarter = a.quarter - INTERVAL 3 MONTH LEFT JOIN dev c ON a.entity=c.entity AND c.quarter = a.quarter - INTERVAL 12 MONTH),
c1 AS (SELECT *, value-lag1 AS qoq, value-lag4 AS yoy, ln(1+value)-ln(1+lag4) AS log_yoy FROM c0),
c2 AS (SELECT *, median(log_yoy) OVER (PARTITION BY entity) AS mid FROM c1),
c3 AS (SELECT *, median(abs(log_yoy-mid)) OVER (PARTITION BY entity) AS mad FROM c2),
ch AS (SELECT * EXCLUDE (mid, mad), CASE WHEN mad>0 THEN 0.67448975*(log_yoy-mid)/mad END AS robust_z, coalesce(abs(CASE WHEN mad>0 THEN 0.67448975*(log_yoy-mid)/mad END)>=2.0, false) AS outlier, abs(yoy) AS abs_yoy FROM c3),
drill AS (SELECT u.* FROM units u SEMI JOIN (SELECT entity, quarter FROM ch WHERE outlier) f ON u.entity=f.entity AND u.quarter=f.quarter)"""
GRID = PANEL + f""",
g AS (SELECT entity, unnest(generate_series(DATE '1995-01-01', {LAST}, INTERVAL 3 MONTH))::DATE AS quarter FROM (SELECT DISTINCT entity FROM p WHERE entity IS NOT NULL)),
g1 AS (SELECT g.entity, g.quarter, p.value, p.quarter IS NOT NULL AS row_present FROM g LEFT JOIN p ON g.entity=p.entity AND g.quarter=p.quarter),
g2 AS (SELECT *, min(CASE WHEN row_present THEN quarter END) OVER (PARTITION BY entity) AS first_present, max(CASE WHEN row_present THEN quarter END) OVER (PARTITION BY entity) AS last_present FROM g1),
grid AS (SELECT entity, quarter, year(quarter) || 'Q' || quarter(quarter) AS period, row_present, row_present AND value IS NOT NULL AS target_observed, first_present, last_present,
    CASE WHEN row_present AND quarter>{TO} THEN 'observed_masked' WHEN row_present AND value IS NULL THEN 'observed_null' WHEN row_present AND value=0 THEN 'observed_zero'
    WHEN row_present AND value>0 THEN 'observed_positive' WHEN quarter<first_present THEN 'leading_absence' WHEN quarter>last_present THEN 'trailing_absence' ELSE 'internal_absence' END AS coverage_status,
    CASE WHEN quarter<={TO} THEN value END AS eda_target FROM g2)"""


def eligibility(labels: list[str], src: str, out: str) -> str:
    return f""",
{out} AS (SELECT *, history >= {H} AS meets_history, recent = {K} AS meets_recent, history >= {H} AND recent = {K} AS eligible FROM (
    SELECT o.origin, o.d AS origin_date, e.entity, count(*) FILTER (WHERE x.value IS NOT NULL AND x.quarter BETWEEN {START} AND o.d) AS history,
    count(*) FILTER (WHERE x.value IS NOT NULL AND x.quarter BETWEEN o.d - INTERVAL {3 * (K - 1)} MONTH AND o.d) AS recent
    FROM (SELECT DISTINCT entity FROM {src} WHERE entity IS NOT NULL) e CROSS JOIN (VALUES {_origins(labels)}) o(origin, d) LEFT JOIN {src} x ON x.entity=e.entity GROUP BY 1,2,3))"""


def scale(src: str, out: str) -> str:
    return f""",
{out}_d AS (SELECT a.entity, a.quarter, abs(a.value-b.value) AS diff FROM {src} a LEFT JOIN {src} b ON a.entity=b.entity AND b.quarter = a.quarter - INTERVAL 12 MONTH AND b.quarter>={START} WHERE a.quarter>={START}),
{out} AS (SELECT entity, quarter, avg(diff) OVER w AS scale, count(diff) OVER w AS scale_n FROM {out}_d WINDOW w AS (PARTITION BY entity ORDER BY quarter ROWS UNBOUNDED PRECEDING))"""


def cells(labels: list[str], src: str, n: str) -> str:
    """Cells and baseline forecasts: CTEs cells<n> and f<n>."""
    return eligibility(labels, src, f"el{n}") + scale(src, f"sc{n}") + f""",
cells{n} AS (SELECT e.entity, e.origin, e.origin_date, year(t) || 'Q' || quarter(t) AS target_period, t AS target_date, h AS horizon, e.eligible, e.history, e.recent, a.value AS actual, s.scale, s.scale_n
    FROM (SELECT *, (origin_date + to_months(3*h))::DATE AS t FROM el{n} CROSS JOIN (VALUES (1),(2),(3),(4)) z(h) WHERE eligible) e
    LEFT JOIN sc{n} s ON s.entity=e.entity AND s.quarter=e.origin_date LEFT JOIN {src} a ON a.entity=e.entity AND a.quarter=e.t),
f{n} AS (SELECT c.*, m.model, m.sd AS source_date, v.value AS forecast, year(m.sd) || 'Q' || quarter(m.sd) AS source_period, v.value IS NOT NULL AS prediction_available, actual IS NOT NULL AS actual_observed,
    v.value IS NOT NULL AND actual IS NOT NULL AS scored, CASE WHEN actual IS NULL AND v.value IS NULL THEN 'actual_and_forecast_missing' WHEN actual IS NULL THEN 'actual_missing' WHEN v.value IS NULL THEN 'forecast_missing' ELSE '' END AS unscored_reason
    FROM cells{n} c CROSS JOIN LATERAL (SELECT 'persistence' AS model, c.origin_date AS sd UNION ALL SELECT 'seasonal_naive', (c.target_date - INTERVAL 12 MONTH)::DATE) m LEFT JOIN {src} v ON v.entity=c.entity AND v.quarter=m.sd),
e{n} AS (SELECT *, forecast-actual AS error, abs(forecast-actual) AS abs_error, (forecast-actual)*(forecast-actual) AS squared_error, CASE WHEN scale>0 THEN abs(forecast-actual)/scale END AS scaled_error FROM f{n})"""


F = DEV + cells(quarters(T.VALIDATION["start"], T.VALIDATION["end"]), "dev", "")
CHOSEN = "CASE WHEN horizon=3 THEN 'seasonal_naive' ELSE 'persistence' END"
RECORD = """count(*) AS forecast_rows, count(*) FILTER (WHERE prediction_available) AS predicted_rows, count(*) FILTER (WHERE scored) AS scored_cells,
    count(*) FILTER (WHERE prediction_available)::DOUBLE/count(*) AS prediction_coverage, count(*) FILTER (WHERE scored)::DOUBLE/count(*) AS target_availability,
    coalesce(sum(actual) FILTER (WHERE scored),0) AS actual_volume, CASE WHEN sum(actual) FILTER (WHERE scored)>0 THEN sum(abs_error) FILTER (WHERE scored)/sum(actual) FILTER (WHERE scored) END AS wape,
    avg(abs_error) FILTER (WHERE scored) AS mae, sqrt(avg(squared_error) FILTER (WHERE scored)) AS rmse, avg(error) FILTER (WHERE scored) AS mean_error,
    CASE WHEN sum(actual) FILTER (WHERE scored)>0 THEN sum(error) FILTER (WHERE scored)/sum(actual) FILTER (WHERE scored) END AS bias, count(scaled_error) FILTER (WHERE scored) AS mase_cells"""
ENTITY_METRICS = F + f""",
em0 AS (SELECT model, horizon, entity, {RECORD}, avg(scaled_error) FILTER (WHERE scored) AS mase FROM e GROUP BY 1,2,3),
em AS (SELECT model, horizon, entity, mase, forecast_rows, scored_cells, actual_volume, wape, mae, rmse, mean_error, mase_cells FROM em0)"""
OVERALL = ENTITY_METRICS + f""",
om AS (SELECT * FROM (SELECT model, horizon, {RECORD} FROM e GROUP BY 1,2) LEFT JOIN (SELECT model, horizon, avg(mase) AS mean_entity_mase, median(mase) AS median_entity_mase, count(mase) AS mase_entities FROM em GROUP BY 1,2) USING (model, horizon))"""
BANDS = F + """,
bc AS (SELECT DISTINCT entity, origin_date, horizon, actual FROM f WHERE actual_observed),
bands AS (SELECT entity, origin_date, horizon, CASE WHEN p<=0.25 THEN 'low' WHEN p<=0.5 THEN 'medium' WHEN p<=0.75 THEN 'high' ELSE 'very_high' END AS volume_band FROM
    (SELECT *, (rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual)-1)/2.0)/count(*) OVER () AS p FROM bc))"""
FINAL = F + f""",
fin AS (SELECT * REPLACE ('final_baseline' AS model), model AS source_model FROM e WHERE model={CHOSEN})"""
_q = lambda v, c: f"list_sort(list({v}))[least(count({v}), ceil((count({v})+1)*{c}))::INT]"
QUANT = FINAL + f""",
qs AS (SELECT horizon, cov AS coverage, CASE WHEN cov=0.8 THEN s80 ELSE s95 END AS scaled_quantile, sn AS scaled_cells, CASE WHEN cov=0.8 THEN p80 ELSE p95 END AS plain_quantile, pn AS plain_cells,
    (SELECT min(origin_date) FROM fin) AS calibration_start, (SELECT max(origin_date) FROM fin) AS calibration_end FROM (SELECT horizon,
    {_q('scaled_error', 0.8)} AS s80, {_q('scaled_error', 0.95)} AS s95, count(scaled_error) AS sn, {_q('abs_error', 0.8)} AS p80, {_q('abs_error', 0.95)} AS p95, count(abs_error) AS pn
    FROM (SELECT horizon, scaled_error, abs_error FROM fin WHERE scored) WHERE abs_error IS NOT NULL GROUP BY horizon) CROSS JOIN (VALUES (0.8::DOUBLE),(0.95::DOUBLE)) z(cov))""".replace("list(scaled_error)", "list(scaled_error) FILTER (WHERE scaled_error IS NOT NULL)")


def frozen(labels: list[str], end: str, n: str) -> str:
    m = lambda k: f"CASE WHEN coalesce(x.scale>0,false) THEN q{k}.scaled_quantile*x.scale ELSE q{k}.plain_quantile END"
    return QUANT + f",\npp{n} AS (SELECT * FROM p WHERE quarter <= DATE '{period_start(end)}')" + cells(labels, f"pp{n}", n) + f""",
fr{n} AS (SELECT x.* REPLACE ('final_baseline' AS model), x.model AS source_model, greatest(0, forecast-{m(80)}) AS lower_80, forecast+{m(80)} AS upper_80, true AS interval_available_80,
    greatest(0, forecast-{m(95)}) AS lower_95, forecast+{m(95)} AS upper_95, true AS interval_available_95, CASE WHEN coalesce(x.scale>0,false) THEN 'entity_scale' ELSE 'pooled_plain' END AS interval_source
    FROM e{n} x JOIN qs q80 ON q80.horizon=x.horizon AND q80.coverage=0.8 JOIN qs q95 ON q95.horizon=x.horizon AND q95.coverage=0.95 WHERE x.model={CHOSEN.replace('horizon', 'x.horizon')})"""


HELD = frozen(quarters(T.HOLDOUT["start"], T.HOLDOUT["end"]), T.HOLDOUT_TARGET_END, "h")
NOW = frozen([T.LATEST], T.LATEST_TARGET_END, "n")
IM = HELD + """,
iv AS (SELECT horizon, actual, 0.8::DOUBLE AS coverage, lower_80 AS lo, upper_80 AS hi FROM frh UNION ALL SELECT horizon, actual, 0.95::DOUBLE, lower_95, upper_95 FROM frh),
im AS (SELECT coverage, horizon, CASE WHEN grouping(horizon)=0 THEN 'horizon' ELSE 'pooled' END AS scope, count(actual) AS interval_cells, avg((actual BETWEEN lo AND hi)::INT::DOUBLE) AS empirical_coverage,
    avg(hi-lo) FILTER (WHERE actual IS NOT NULL) AS mean_width, median(hi-lo) FILTER (WHERE actual IS NOT NULL) AS median_width, avg((hi-lo)/actual) FILTER (WHERE actual>0) AS mean_relative_width,
    avg(hi-lo + 2/(1-coverage)*CASE WHEN actual<lo THEN lo-actual WHEN actual>hi THEN actual-hi ELSE 0 END) FILTER (WHERE actual IS NOT NULL) AS mean_winkler
    FROM iv GROUP BY GROUPING SETS ((coverage, horizon), (coverage)))"""
PREQ = FINAL + """,
pn AS (SELECT *, dense_rank() OVER (ORDER BY origin_date) AS nth FROM fin),
pq AS (SELECT a.horizon, a.nth, list_sort(list(b.scaled_error) FILTER (WHERE b.scaled_error IS NOT NULL)) AS sl, list_sort(list(b.abs_error)) AS pl FROM (SELECT DISTINCT horizon, nth FROM pn WHERE nth>2) a
    JOIN pn b ON b.horizon=a.horizon AND b.nth<a.nth AND b.scored GROUP BY 1,2),
pm AS (SELECT n.*, CASE WHEN coalesce(scale>0,false) THEN sl[least(len(sl),ceil((len(sl)+1)*0.8))::INT]*scale ELSE pl[least(len(pl),ceil((len(pl)+1)*0.8))::INT] END AS m80,
    CASE WHEN coalesce(scale>0,false) THEN sl[least(len(sl),ceil((len(sl)+1)*0.95))::INT]*scale ELSE pl[least(len(pl),ceil((len(pl)+1)*0.95))::INT] END AS m95 FROM pn n LEFT JOIN pq USING (horizon, nth))"""
LAGS = ", ".join(f"l{k}.value AS lag{k}" for k in range(4))
FEAT = F + f""",
fl AS (SELECT a.entity, a.quarter AS origin_date, {LAGS} FROM dev a {' '.join(f'LEFT JOIN dev l{k} ON l{k}.entity=a.entity AND l{k}.quarter = a.quarter - INTERVAL {3 * k} MONTH' for k in range(4))}),
ft AS (SELECT fl.*, h AS horizon, (origin_date+to_months(3*h))::DATE AS target_date, quarter((origin_date+to_months(3*h))::DATE)::INT AS target_quarter, ln(1+lag0) AS log_level_t,
    ln(1+lag0)-ln(1+lag1) AS log_change_1, ln(1+lag1)-ln(1+lag2) AS log_change_2, ln(1+lag2)-ln(1+lag3) AS log_change_3, lag0 AS level_t, lag0-lag1 AS raw_change_1, lag1-lag2 AS raw_change_2, lag2-lag3 AS raw_change_3,
    (coalesce(lag0=0,false)::INT+coalesce(lag1=0,false)::INT+coalesce(lag2=0,false)::INT+coalesce(lag3=0,false)::INT) AS recent_zero_count, ((year(origin_date)-1995)*4+quarter(origin_date)-1)::INT AS origin_index,
    lag0 IS NOT NULL AND lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag3 IS NOT NULL AS complete FROM fl CROSS JOIN (VALUES (1),(2),(3),(4)) z(h)),
tr AS (SELECT ft.*, y.value AS label FROM ft JOIN dev y ON y.entity=ft.entity AND y.quarter=ft.target_date WHERE complete AND y.value IS NOT NULL AND origin_date>=DATE '1995-10-01' AND horizon=2 AND ft.target_date<=DATE '1998-10-01')"""
ACF = F + f""",
ar AS (SELECT entity, horizon, origin_date, error AS x FROM e WHERE model='persistence' AND scored),
ap AS (SELECT a.entity, a.horizon, z.lag, a.x, b.x AS y FROM ar a CROSS JOIN (VALUES (1),(4)) z(lag) LEFT JOIN ar b ON b.entity=a.entity AND b.horizon=a.horizon AND b.origin_date = a.origin_date - to_months(3*z.lag)),
acf AS (SELECT entity, horizon, lag, count(y) AS pairs, CASE WHEN count(y)>=5 AND min(x) FILTER (WHERE y IS NOT NULL)<max(x) FILTER (WHERE y IS NOT NULL) AND min(y)<max(y) THEN corr(x,y) END AS correlation FROM ap GROUP BY 1,2,3)"""
_log = "log_level_t, log_change_1, log_change_2, log_change_3, recent_zero_count, origin_index"
_delta = "level_t, raw_change_1, raw_change_2, raw_change_3, recent_zero_count, origin_index"
_pick = "entity, year(origin_date) || 'Q' || quarter(origin_date) AS pseudo_origin, origin_date AS pseudo_origin_date, target_date, horizon"

K_NUMERIC, SIZE = 6, 12  # constant, six numbers, four quarters, response


def ridge(response: str, alphas: tuple[float, ...]) -> str:
    """The penalised fits, training rows copied for each origin, the entities eliminated, and eleven equations solved row by row."""
    numeric = (_log if response == "log" else _delta).split(", ")
    y = "ln(1+y.value)-log_level_t" if response == "log" else "y.value-level_t"
    vector = ", ".join(["1.0", *[f"{c}::DOUBLE" for c in numeric], *[f"(target_quarter={q})::INT::DOUBLE" for q in range(1, 5)], y])
    entry = "(a.l - sj.mean*ai.l - si.mean*ja.l + si.mean*sj.mean*aa.l)/(si.spread*sj.spread) + CASE WHEN a.i=a.j AND a.i>1 THEN a.alpha ELSE 0 END"
    if response != "log":
        entry = f"CASE WHEN a.i=1 OR a.j=1 THEN (a.i=a.j)::INT::DOUBLE ELSE {entry} END"
    shift = " + ".join(f"mean[{i}]/spread[{i}]*w[{i}]" for i in range(2, K_NUMERIC + 2))
    level = " + ".join([numeric[0], "raw[1]", *[f"{c}*raw[{i + 2}]" for i, c in enumerate(numeric)], f"raw[{K_NUMERIC + 1} + target_quarter]", "coalesce(ow.own, 0)"])
    floor = f"greatest({level}, 0)"
    return FEAT + f""",
al AS (SELECT unnest({[float(a) for a in alphas]}::DOUBLE[]) AS alpha), ou AS (SELECT DISTINCT origin_date AS oo FROM cells),
trn AS (SELECT ft.entity, ft.horizon, ft.target_date, complete AND y.value IS NOT NULL AS fit, [{vector}]::DOUBLE[] AS v FROM ft LEFT JOIN dev y ON y.entity=ft.entity AND y.quarter=ft.target_date WHERE origin_date>=DATE '1995-10-01'),
xa AS (SELECT oo, trn.* FROM trn JOIN ou ON target_date<=oo), xr AS (SELECT * FROM xa WHERE fit),
es AS (SELECT oo, horizon, entity, [{', '.join(f'sum(v[{i}])' for i in range(1, SIZE + 1))}] AS s FROM xr GROUP BY 1,2,3),
ij AS (SELECT i, j FROM (SELECT unnest(range(1,{SIZE + 1})) AS i) CROSS JOIN (SELECT unnest(range(1,{SIZE + 1})) AS j)),
gr AS (SELECT oo, horizon, i, j, sum(v[i]*v[j]) AS g, min(v[i]) AS lo, max(v[i]) AS hi FROM xr CROSS JOIN ij GROUP BY 1,2,3,4),
st AS (SELECT d.oo, d.horizon, d.i, d.g>0 AS held, n.g AS n, d.lo<d.hi AS varied, CASE WHEN d.i BETWEEN 2 AND {K_NUMERIC + 1} THEN m.g/n.g ELSE 0 END AS mean,
    CASE WHEN d.i BETWEEN 2 AND {K_NUMERIC + 1} AND d.lo<d.hi AND d.g/n.g-(m.g/n.g)*(m.g/n.g)>0 THEN sqrt(d.g/n.g-(m.g/n.g)*(m.g/n.g)) ELSE 1 END AS spread
    FROM gr d JOIN gr m ON m.oo=d.oo AND m.horizon=d.horizon AND m.i=1 AND m.j=d.i JOIN gr n ON n.oo=d.oo AND n.horizon=d.horizon AND n.i=1 AND n.j=1 WHERE d.i=d.j),
le AS (SELECT g.oo, g.horizon, alpha, g.i, g.j, g.g-t AS l FROM gr g JOIN (SELECT oo, horizon, alpha, i, j, sum(s[i]*s[j]/(s[1]+alpha)) AS t FROM es CROSS JOIN al CROSS JOIN ij GROUP BY 1,2,3,4,5) k USING (oo, horizon, i, j)),
eqs AS (SELECT a.oo, a.horizon, a.alpha, a.i, list({entry} ORDER BY a.j) AS r FROM le a JOIN st si ON si.oo=a.oo AND si.horizon=a.horizon AND si.i=a.i JOIN st sj ON sj.oo=a.oo AND sj.horizon=a.horizon AND sj.i=a.j
    JOIN le ai ON ai.oo=a.oo AND ai.horizon=a.horizon AND ai.alpha=a.alpha AND ai.i=a.i AND ai.j=1 JOIN le ja ON ja.oo=a.oo AND ja.horizon=a.horizon AND ja.alpha=a.alpha AND ja.i=1 AND ja.j=a.j
    JOIN le aa ON aa.oo=a.oo AND aa.horizon=a.horizon AND aa.alpha=a.alpha AND aa.i=1 AND aa.j=1 WHERE a.i<{SIZE} GROUP BY 1,2,3,4),
rec AS (SELECT oo, horizon, alpha, 1 AS k, list(r ORDER BY i) AS m FROM eqs GROUP BY 1,2,3
    UNION ALL SELECT oo, horizon, alpha, k+1, list_transform(m, lambda r, i: CASE WHEN i=k THEN list_transform(r, lambda x: x/m[k][k]) ELSE list_transform(r, lambda x, j: x-r[k]*(m[k][j]/m[k][k])) END) FROM rec WHERE k<{SIZE}),
ww AS (SELECT oo, horizon, alpha, list_transform(m, lambda r: r[{SIZE}]) AS w, mean, spread, held, n FROM rec JOIN (SELECT oo, horizon, list(mean ORDER BY i) AS mean, list(spread ORDER BY i) AS spread, list(held ORDER BY i) AS held, min(n) AS n FROM st GROUP BY 1,2) USING (oo, horizon) WHERE k={SIZE}),
fits AS (SELECT *, list_transform(w, lambda x, i: CASE WHEN i=1 THEN x-({shift}) ELSE x/spread[i] END) AS raw FROM ww),
own AS (SELECT oo, horizon, alpha, entity, (s[{SIZE}]-list_sum(list_transform(raw, lambda x, i: x*s[i])))/(s[1]+alpha) AS own, w FROM es JOIN fits USING (oo, horizon)),
lv AS (SELECT c.*, z.alpha, {level} AS level, ow.own IS NOT NULL AS seen, {'exp(' + floor + ')-1' if response == 'log' else floor} AS forecast FROM cells c JOIN ft ON ft.entity=c.entity AND ft.origin_date=c.origin_date AND ft.horizon=c.horizon
    JOIN fits z ON z.oo=c.origin_date AND z.horizon=c.horizon LEFT JOIN own ow ON ow.oo=z.oo AND ow.horizon=z.horizon AND ow.alpha=z.alpha AND ow.entity=c.entity),
rf AS (SELECT *, level<0 AS floored, forecast IS NOT NULL AS prediction_available, forecast IS NOT NULL AND actual IS NOT NULL AS scored, forecast-actual AS error, abs(forecast-actual) AS abs_error, (forecast-actual)*(forecast-actual) AS squared_error,
    CASE WHEN scale>0 THEN abs(forecast-actual)/scale END AS scaled_error FROM lv)"""


def _ridge_forecasts(response: str, alphas: tuple[float, ...]) -> str:
    return f"WITH RECURSIVE {ridge(response, alphas)}\nSELECT alpha, entity, origin_date, horizon, round(forecast, {PLACES}) AS forecast, actual, scored, floored, seen FROM rf"


def _ridge_coefficients(alphas: tuple[float, ...]) -> str:
    names = [f"numeric__{c}" for c in _log.split(", ")] + [f"categorical__target_quarter_{q}" for q in range(1, 5)]
    return f"""WITH RECURSIVE {ridge("log", alphas)}
SELECT alpha, origin_date, horizon, feature, round(coefficient, 6) AS coefficient, round(intercept, 6) AS intercept FROM (
    SELECT alpha, oo AS origin_date, horizon, {names}[x] AS feature, w[x+1] AS coefficient, w[1] AS intercept FROM fits CROSS JOIN (SELECT unnest(range(1, {len(names) + 1})) AS x) WHERE x<={K_NUMERIC} OR held[x+1]
    UNION ALL SELECT alpha, oo, horizon, 'categorical__entity_' || entity, own, w[1] FROM own)"""


def _ridge_diagnostics(alphas: tuple[float, ...], sweeps: int = 8) -> str:
    """Eigenvalues by rotations: one pair of entries becomes zero after the other."""
    k = K_NUMERIC
    pairs = [[p, q] for _ in range(sweeps) for p in range(1, k + 1) for q in range(p + 1, k + 1)]
    turned = "list_transform(m, lambda r, i: CASE WHEN i=p THEN list_transform(m[p], lambda x, j: c*x-s*m[q][j]) WHEN i=q THEN list_transform(m[p], lambda x, j: s*x+c*m[q][j]) ELSE r END)"
    return f"""WITH RECURSIVE {ridge("log", alphas)},
cv AS (SELECT a.oo, a.horizon, a.i, a.j, a.g/si.n-si.mean*sj.mean AS cov, si.varied AND sj.varied AS varied FROM gr a JOIN st si ON si.oo=a.oo AND si.horizon=a.horizon AND si.i=a.i JOIN st sj ON sj.oo=a.oo AND sj.horizon=a.horizon AND sj.i=a.j
    WHERE a.i BETWEEN 2 AND {k + 1} AND a.j BETWEEN 2 AND {k + 1}),
cr AS (SELECT a.oo, a.horizon, a.i, a.j, a.varied, CASE WHEN a.i=a.j THEN 1 WHEN a.varied THEN a.cov/sqrt(b.cov*c.cov) ELSE 0 END AS r FROM cv a JOIN cv b ON b.oo=a.oo AND b.horizon=a.horizon AND b.i=a.i AND b.j=a.i JOIN cv c ON c.oo=a.oo AND c.horizon=a.horizon AND c.i=a.j AND c.j=a.j),
jac AS (SELECT oo, horizon, 1 AS k, list(row ORDER BY i) AS m FROM (SELECT oo, horizon, i, list(r ORDER BY j) AS row FROM cr GROUP BY 1,2,3) GROUP BY 1,2
    UNION ALL SELECT oo, horizon, k+1, list_transform({turned}, lambda r: list_transform(r, lambda x, j: CASE WHEN j=p THEN c*r[p]-s*r[q] WHEN j=q THEN s*r[p]+c*r[q] ELSE x END))
    FROM (SELECT *, 1/sqrt(1+t*t) AS c, t/sqrt(1+t*t) AS s FROM (SELECT *, CASE WHEN m[p][q]=0 THEN 0 ELSE (CASE WHEN tau<0 THEN -1 ELSE 1 END)/(abs(tau)+sqrt(1+tau*tau)) END AS t
    FROM (SELECT *, CASE WHEN m[p][q]=0 THEN 0 ELSE (m[q][q]-m[p][p])/(2*m[p][q]) END AS tau FROM (SELECT *, {pairs}[k][1] AS p, {pairs}[k][2] AS q FROM jac WHERE k<={len(pairs)})))))
SELECT oo AS origin_date, horizon, n.rows AS training_rows, n.candidates AS candidate_training_rows, n.candidates-n.rows AS excluded_training_rows, CASE WHEN d.any_varied THEN CASE WHEN lo>1e-12*hi THEN round(sqrt(hi/lo), 6) ELSE 'inf'::DOUBLE END END AS condition, round(CASE WHEN d.any_varied THEN d.top END, 6) AS correlation
FROM (SELECT oo, horizon, list_max(ev) AS hi, list_min(ev) AS lo FROM (SELECT oo, horizon, list_transform(m, lambda r, i: r[i]) AS ev FROM jac WHERE k={len(pairs) + 1}))
JOIN (SELECT oo, horizon, count(*) FILTER (WHERE fit) AS rows, count(*) AS candidates FROM xa GROUP BY 1,2) n USING (oo, horizon)
JOIN (SELECT oo, horizon, bool_or(varied) AS any_varied, coalesce(max(abs(r)) FILTER (WHERE i<j), 0) AS top FROM cr GROUP BY 1,2) d USING (oo, horizon)"""


def _alpha_ctes(alphas: tuple[float, ...]) -> str:
    return ridge("log", alphas) + f""",
om AS (SELECT model, horizon, sum(abs_error) FILTER (WHERE scored)/sum(actual) FILTER (WHERE scored) AS wape FROM e GROUP BY 1,2),
am AS (SELECT alpha, horizon, count(*) FILTER (WHERE prediction_available)::DOUBLE/count(*) AS coverage, sum(abs_error) FILTER (WHERE scored)/sum(actual) FILTER (WHERE scored) AS wape FROM rf GROUP BY 1,2),
asum AS (SELECT alpha, avg(1-am.wape/om.wape) AS mean_skill, min(coverage) AS min_coverage, count(DISTINCT horizon) AS horizons FROM am JOIN om USING (horizon) WHERE om.model={CHOSEN} GROUP BY 1),
asel AS (SELECT *, min_coverage=1 AS eligible, coalesce(alpha=(SELECT max(alpha) FROM asum WHERE min_coverage=1 AND mean_skill>=(SELECT max(mean_skill) FROM asum WHERE min_coverage=1)-0.0001), false) AS selected FROM asum)"""


def bootstrap(pairs: str, block_length: int, replications: int, seed: int) -> str:
    """Every replication's origins one by one, its blocks' starts from the same hash, then its skill; ``pairs`` has horizon, origin_date, actual, a and b."""
    return f"""bp AS ({pairs}), bo AS (SELECT origin_date, row_number() OVER (ORDER BY origin_date) AS nth FROM (SELECT DISTINCT origin_date FROM bp)), bn AS (SELECT count(*) AS n FROM bo),
bd AS (SELECT r, b, k, floor(('0x' || substr(md5('{seed}:' || r || ':' || b), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE * ((SELECT n FROM bn) - {block_length - 1}))::BIGINT + k + 1 AS nth
    FROM (SELECT unnest(range(0, {replications})) AS r) CROSS JOIN (SELECT unnest(range(0, (SELECT ceil(n / {block_length}.0)::BIGINT FROM bn))) AS b) CROSS JOIN (SELECT unnest(range(0, {block_length})) AS k) WHERE b * {block_length} + k < (SELECT n FROM bn)),
bs AS (SELECT horizon, origin_date, sum(abs(a-actual)) AS a, sum(abs(b-actual)) AS b, sum(actual) AS v FROM bp GROUP BY 1,2),
br AS (SELECT r, horizon, CASE WHEN sum(v)>0 AND sum(b)>0 THEN 1-sum(a)/sum(b) END AS skill FROM (SELECT d.r, s.* FROM bd d JOIN bo USING (nth) JOIN bs s USING (origin_date)) GROUP BY 1,2),
pt AS (SELECT horizon, CASE WHEN sum(v)>0 AND sum(b)>0 THEN 1-sum(a)/sum(b) END AS point_skill FROM bs GROUP BY 1)
SELECT summary, horizon, round(point_skill,6) AS point_skill, round(lower_95,6) AS lower_95, round(upper_95,6) AS upper_95, {replications}::INT AS replications FROM (
    SELECT 'horizon_' || horizon AS summary, horizon, point_skill, quantile_cont(skill, 0.025) AS lower_95, quantile_cont(skill, 0.975) AS upper_95 FROM br JOIN pt USING (horizon) GROUP BY 1,2,3
    UNION ALL SELECT 'equal_weight_mean', NULL, (SELECT avg(point_skill) FROM pt), quantile_cont(skill, 0.025), quantile_cont(skill, 0.975) FROM (SELECT r, avg(skill) AS skill FROM br GROUP BY 1))"""


BOOTSTRAP = {"block_length": 4, "replications": 2000, "seed": 20}
_COMPARED = f"(SELECT * FROM f WHERE model={CHOSEN}) b ON b.entity=a.entity AND b.origin_date=a.origin_date AND b.horizon=a.horizon WHERE a.actual IS NOT NULL AND a.forecast IS NOT NULL AND b.forecast IS NOT NULL"
#: Ridge forecasts, of millions in the panel's unit, are compared to tens: two ways of solving agree to 10 to 12 digits.
PLACES = -1
LOG_ALPHAS, DELTA_ALPHAS = (0.1, 1.0, 10.0, 100.0), (1.0, 100.0, 10000.0, 1000000.0)
CHECKS = ENTITIES + ",\n" + MASTER + """,
checks AS (SELECT 'raw_quarterly_rows' AS check_name, count(*)::VARCHAR AS observed_value FROM raw
UNION ALL SELECT 'domain_source_rows', count(*)::VARCHAR FROM records UNION ALL SELECT 'domain_distinct_units', count(DISTINCT unit_id)::VARCHAR FROM records
UNION ALL SELECT 'duplicate_source_keys', coalesce(sum(n-1),0)::BIGINT::VARCHAR FROM (SELECT count(*) AS n FROM records GROUP BY unit_id, cal_year, cal_quarter, subunit HAVING count(*)>1)
UNION ALL SELECT 'invalid_unit_ids', count(*)::VARCHAR FROM records WHERE unit_id IS NULL OR NOT regexp_full_match(unit_id,'[0-9]+')
UNION ALL SELECT 'invalid_periods', count(*)::VARCHAR FROM records WHERE cal_year IS NULL OR cal_quarter NOT BETWEEN 1 AND 4
UNION ALL SELECT 'invalid_values', count(*)::VARCHAR FROM records WHERE value_raw IS NOT NULL AND value IS NULL UNION ALL SELECT 'negative_value_rows', count(*)::VARCHAR FROM records WHERE value<0
UNION ALL SELECT 'duplicate_master_ids', coalesce(sum(n-1),0)::BIGINT::VARCHAR FROM (SELECT count(*) AS n FROM master WHERE unit_id IS NOT NULL GROUP BY unit_id HAVING count(*)>1)
UNION ALL SELECT 'unmatched_unit_ids', count(*)::VARCHAR FROM (SELECT DISTINCT unit_id FROM records WHERE unit_id IS NOT NULL AND unit_id NOT IN (SELECT unit_id FROM master))
UNION ALL SELECT 'unit_quarter_rows', count(*)::VARCHAR FROM units UNION ALL SELECT 'unit_quarter_positive_rows', count(*)::VARCHAR FROM units WHERE value>0
UNION ALL SELECT 'unit_quarter_zero_rows', count(*)::VARCHAR FROM units WHERE value=0 UNION ALL SELECT 'unit_quarter_all_null_rows', count(*)::VARCHAR FROM units WHERE value IS NULL
UNION ALL SELECT 'entity_count', count(DISTINCT entity)::VARCHAR FROM units UNION ALL SELECT 'period_min', min(period) FROM units UNION ALL SELECT 'period_max', max(period) FROM units
UNION ALL SELECT 'entity_quarter_rows', count(*)::VARCHAR FROM eq UNION ALL SELECT 'missing_entity_unit_quarters', count(*)::VARCHAR FROM units WHERE entity IS NULL)"""


def _r(cols: str, places: int = 6) -> str:
    return " REPLACE (" + ", ".join(f"round({c.strip()}, {places}) AS {c.strip()}" for c in cols.split(",")) + ")"


_rec = "prediction_coverage, target_availability, actual_volume, wape, mae, rmse, mean_error, bias"
_err = "scale, error, abs_error, scaled_error"
_ints = "lower_80, upper_80, lower_95, upper_95"
_drop_e = "EXCLUDE (error, abs_error, squared_error, scaled_error)"


def oracles() -> dict[str, str]:
    q = lambda ctes, body: f"WITH {ctes}\n{body}"
    return {
        "typed_ingest_projection": q(RECORDS, "SELECT * FROM records"),
        "mine_quarter_rollup": q(UNITS, "SELECT * FROM units"),
        "state_quarter_rollup": q(ENTITIES, "SELECT * FROM eq"),
        "quality_checks": q(CHECKS, "SELECT * FROM checks"),
        "duplicate_keys": q(RECORDS, "SELECT coalesce(sum(n-1),0)::BIGINT AS n FROM (SELECT count(*) AS n FROM records GROUP BY unit_id, cal_year, cal_quarter, subunit HAVING count(*)>1)"),
        "unmatched_ids": q(RECORDS + ",\n" + MASTER, "SELECT DISTINCT r.unit_id FROM records r LEFT JOIN master m USING (unit_id) WHERE r.unit_id IS NOT NULL AND m.unit_id IS NULL"),
        "masked_projection": q(PANEL, f"SELECT * REPLACE (CASE WHEN quarter<={TO} THEN value WHEN value IS NULL THEN value ELSE 1.0::DOUBLE END AS value) FROM p"),
        "panel_overview": q(UNITS, "SELECT count(*) AS rows, count(DISTINCT entity) AS entities, count(*) FILTER (WHERE value>0) AS positive, count(*) FILTER (WHERE value=0) AS zero, count(*) FILTER (WHERE value IS NULL) AS all_null FROM units"),
        "window_overview": q(DEV, "SELECT count(*) AS rows, count(DISTINCT entity) AS entities, min(period) AS first_period, max(period) AS last_period, count(*) FILTER (WHERE value IS NULL) AS null_values, count(*) FILTER (WHERE value=0) AS zero_values, count(*) FILTER (WHERE value>0) AS positive_values FROM dev"),
        "national_series": q(PANEL, "SELECT quarter, min(period) AS period, round(sum(value),6) AS value, count(value) AS observed_entities FROM p GROUP BY quarter"),
        "coverage_grid": q(GRID, "SELECT * FROM grid"),
        "coverage_summary": q(GRID, "SELECT entity, min(CASE WHEN row_present THEN period END) AS first_present, max(CASE WHEN row_present THEN period END) AS last_present, count(*) FILTER (WHERE row_present) AS observed_rows, "
            + ", ".join(f"count(*) FILTER (WHERE coverage_status='{s}') AS {s}" for s in ("leading_absence", "internal_absence", "trailing_absence", "observed_null", "observed_zero", "observed_positive", "observed_masked")) + " FROM grid GROUP BY entity HAVING count(*) FILTER (WHERE row_present)>0"),
        "coverage_status_counts": q(GRID, "SELECT coverage_status, count(*) AS cells FROM grid GROUP BY 1"),
        "target_summary": q(DEV, "SELECT entity, min(period) AS first_period, max(period) AS last_period, count(value) AS observed_periods, count(*) FILTER (WHERE value=0) AS zero_periods, count(*) FILTER (WHERE value>0) AS positive_periods, round(coalesce(sum(value),0),6) AS total, round(avg(value),6) AS mean, round(median(value),6) AS median, round(stddev_samp(value),6) AS std, min(value) AS min, max(value) AS max, round(count(*) FILTER (WHERE value=0)/nullif(count(value),0),6) AS zero_share FROM dev GROUP BY entity"),
        "calendar_changes": q(CHANGES, "SELECT * EXCLUDE (robust_z, outlier)" + _r("qoq, yoy, log_yoy, abs_yoy") + " FROM ch"),
        "robust_outliers": q(CHANGES, "SELECT entity, quarter, round(robust_z,6) AS robust_z, outlier FROM ch"),
        "outlier_counts": q(CHANGES, "SELECT year(quarter)::INT AS year, count(*) AS flags FROM ch WHERE outlier GROUP BY 1"),
        "seasonal_share": q(DEV, "SELECT cal_quarter, round(median(s),6) AS median, round(quantile_cont(s,0.25),6) AS q25, round(quantile_cont(s,0.75),6) AS q75, count(*) AS entity_years FROM (SELECT cal_quarter, value/t AS s FROM (SELECT *, count(value) OVER w AS n, sum(value) OVER w AS t FROM dev WINDOW w AS (PARTITION BY entity, cal_year)) WHERE n=4 AND t>0) GROUP BY 1"),
        "concentration": q(DEV, "SELECT quarter, min(period) AS period, round(sum(value),6) AS total, count(DISTINCT entity) AS entities, round(sum(value) FILTER (WHERE r<=5)/nullif(sum(value),0),6) AS top_share, round(sum(value*value)/nullif(sum(value)*sum(value),0),6) AS hhi FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY value DESC, entity) AS r FROM dev WHERE value IS NOT NULL) GROUP BY quarter"),
        "origin_eligibility": q(PANEL + eligibility(quarters("1997Q1", "1998Q4"), "p", "el"), "SELECT * FROM el"),
        "eligible_counts": q(PANEL + eligibility(quarters("1997Q1", "1998Q4"), "p", "el"), "SELECT origin, origin_date, count(*) FILTER (WHERE eligible) AS eligible FROM el GROUP BY 1,2"),
        "eligibility_transitions": q(PANEL + eligibility(quarters("1997Q1", "1998Q4"), "p", "el"), "SELECT origin, origin_date, entity, CASE WHEN eligible THEN 'entered' ELSE 'exited' END AS transition, history, recent FROM (SELECT *, lag(eligible) OVER (PARTITION BY entity ORDER BY origin_date) AS was FROM el) WHERE was IS NOT NULL AND eligible<>was"),
        "seasonal_scale": q(DEV + scale("dev", "sc"), "SELECT *" + _r("scale") + " FROM sc"),
        "forecast_cells": q(F, "SELECT *" + _r("scale") + " FROM cells"),
        "baseline_forecasts": q(F, "SELECT *" + _r("scale") + " FROM f"),
        "error_columns": q(F, "SELECT model, entity, origin_date, horizon, round(error,6) AS error, round(abs_error,6) AS abs_error, squared_error, round(scaled_error,6) AS scaled_error FROM e"),
        "state_metrics": q(ENTITY_METRICS, "SELECT *" + _r("mase, actual_volume, wape, mae, rmse, mean_error") + " FROM em"),
        "overall_metrics": q(OVERALL, "SELECT *" + _r(_rec + ", mean_entity_mase, median_entity_mase") + " FROM om"),
        "origin_metrics": q(F, f"SELECT *{_r(_rec)} FROM (SELECT model, horizon, origin, origin_date, {RECORD} FROM e GROUP BY 1,2,3,4)"),
        "volume_bands": q(BANDS, "SELECT * FROM bands"),
        "volume_metrics": q(BANDS, f"SELECT *{_r(_rec)} FROM (SELECT model, horizon, volume_band, {RECORD} FROM e JOIN bands USING (entity, origin_date, horizon) WHERE scored GROUP BY 1,2,3)"),
        "mase_by_model": q(ENTITY_METRICS, "SELECT entity, round(avg(mase) FILTER (WHERE model='persistence'),6) AS persistence, round(avg(mase) FILTER (WHERE model='seasonal_naive'),6) AS seasonal_naive FROM em GROUP BY entity"),
        "comparator_table": q(OVERALL, "SELECT horizon, round(p,6) AS persistence, round(s,6) AS seasonal_naive, round(abs(p-s)*10000,6) AS gap_bp, CASE WHEN horizon=3 THEN 'seasonal_naive' ELSE 'persistence' END AS comparator_model, round(CASE WHEN horizon=3 THEN s ELSE p END,6) AS comparator_wape FROM (SELECT horizon, max(wape) FILTER (WHERE model='persistence') AS p, max(wape) FILTER (WHERE model='seasonal_naive') AS s FROM om GROUP BY horizon)"),
        "h4_pivot_check": q(F, "SELECT *, persistence IS NOT DISTINCT FROM seasonal_naive AS agree FROM (SELECT entity, origin_date, max(forecast) FILTER (WHERE model='persistence') AS persistence, max(forecast) FILTER (WHERE model='seasonal_naive') AS seasonal_naive FROM f WHERE horizon=4 GROUP BY 1,2)"),
        "final_selection": q(FINAL, f"SELECT * {_drop_e}" + _r("scale") + " FROM fin"),
        "calibration_quantiles": q(QUANT, "SELECT *" + _r("scaled_quantile, plain_quantile") + " FROM qs"),
        "frozen_intervals": q(HELD, "SELECT *" + _r(_err + ", " + _ints) + " FROM frh"),
        "interval_metrics": q(IM, "SELECT *" + _r("empirical_coverage, mean_width, median_width, mean_relative_width, mean_winkler") + " FROM im"),
        "interval_guardrails": q(IM, "SELECT coverage, round(empirical_coverage,6) AS empirical_coverage, CASE WHEN coverage=0.8 THEN empirical_coverage BETWEEN 0.75 AND 0.85 ELSE empirical_coverage BETWEEN 0.9 AND 0.98 END AS within FROM im WHERE scope='pooled'"),
        "prequential_intervals": q(PREQ, "SELECT entity, origin_date, horizon, round(CASE WHEN m80 IS NOT NULL THEN greatest(0,forecast-m80) END,6) AS lower_80, round(forecast+m80,6) AS upper_80, round(CASE WHEN m95 IS NOT NULL THEN greatest(0,forecast-m95) END,6) AS lower_95, round(forecast+m95,6) AS upper_95, m80 IS NOT NULL AS interval_available_80, CASE WHEN m80 IS NULL THEN '' WHEN coalesce(scale>0,false) THEN 'entity_scale' ELSE 'pooled_plain' END AS interval_source FROM pm"),
        "latest_forecasts": q(NOW, "SELECT *" + _r(_err + ", " + _ints) + ", 'tables' AS source_snapshot, 'revisable' AS revision_status FROM frn"),
        "planning_summary": q(NOW, "SELECT *, rank() OVER (ORDER BY nm DESC)::INT AS priority, round(nm,6) AS near_mean, round(nw,6) AS near_width_80 FROM (SELECT entity, "
            + ", ".join(f"max({c if c == 'target_period' else f'round({c},6)'}) FILTER (WHERE horizon={h}) AS h{h}_{c}" for h in (1, 2) for c in ("target_period", "forecast", "lower_80", "upper_80")) + ", avg(forecast) AS nm, avg(upper_80-lower_80) AS nw FROM frn WHERE horizon IN (1,2) GROUP BY entity)").replace("SELECT *, rank()", "SELECT * EXCLUDE (nm, nw), rank()"),
        "training_examples_log": q(FEAT, f"SELECT {_pick}, {_log}, target_quarter, ln(1+label)-log_level_t AS response FROM tr").replace("SELECT entity, year(o", "SELECT *" + _r("log_level_t, log_change_1, log_change_2, log_change_3, response") + " FROM (SELECT entity, year(o") + ")",
        "training_examples_delta": q(FEAT, f"SELECT *{_r('raw_change_1, raw_change_2, raw_change_3, response')} FROM (SELECT {_pick}, {_delta}, target_quarter, label-level_t AS response FROM tr)"),
        "prediction_features": q(FEAT, f"SELECT *{_r('log_level_t, log_change_1, log_change_2, log_change_3')} FROM (SELECT c.entity, c.origin_date, c.horizon, {_log}, target_quarter FROM cells c LEFT JOIN ft ON ft.entity=c.entity AND ft.origin_date=c.origin_date AND ft.horizon=c.horizon)"),
        "comparator_pairs": q(F, f"SELECT a.entity, a.origin_date, a.target_date, a.horizon, a.actual, a.forecast AS candidate_forecast, b.forecast AS comparator_forecast FROM (SELECT * FROM f WHERE model='seasonal_naive') a LEFT JOIN (SELECT * FROM f WHERE model={CHOSEN}) b USING (entity, origin_date, target_date, horizon)"),
        "residual_acf": q(ACF, "SELECT *" + _r("correlation") + " FROM acf"),
        "acf_summary": q(ACF, "SELECT horizon, lag, count(correlation) AS defined, round(median(correlation),6) AS median, round(avg(abs(correlation)),6) AS mean_abs FROM acf GROUP BY 1,2"),
        "binned_residuals": q(F, "SELECT horizon, bin, count(*) AS rows, round(avg(error),6) AS mean_error, round(avg(abs_error),6) AS mean_abs_error, min(forecast) AS diagnostic_min, max(forecast) AS diagnostic_max, 'forecast' AS diagnostic FROM (SELECT *, least(10, ceil(row_number() OVER (PARTITION BY horizon ORDER BY forecast, origin_date, entity)::DOUBLE/count(*) OVER (PARTITION BY horizon)*10))::INT AS bin FROM e WHERE model='persistence' AND scored) GROUP BY 1,2"),
        "ridge_log": _ridge_forecasts("log", LOG_ALPHAS),
        "ridge_delta": _ridge_forecasts("delta", DELTA_ALPHAS),
        "ridge_coefficients": _ridge_coefficients(LOG_ALPHAS),
        "ridge_training_diagnostics": _ridge_diagnostics(LOG_ALPHAS),
        "ridge_diagnostic_summary": f"WITH RECURSIVE {ridge('log', (1.0,))}\nSELECT horizon, count(*) AS forecast_rows, count(*) FILTER (WHERE scored) AS scored_cells, round(sum(error) FILTER (WHERE scored)/sum(actual) FILTER (WHERE scored),6) AS bias, round(avg(abs_error) FILTER (WHERE scored),{PLACES}) AS mae, round(avg(scaled_error) FILTER (WHERE scored),6) AS mean_scaled_error, round(avg(floored::INT::DOUBLE),6) AS floor_rate, count(*) FILTER (WHERE NOT seen) AS unseen_rows FROM rf GROUP BY 1",
        "alpha_selection": f"WITH RECURSIVE {_alpha_ctes(LOG_ALPHAS)}\nSELECT alpha, round(mean_skill,6) AS mean_skill, min_coverage, horizons, eligible, selected FROM asel",
        "bootstrap_skill": f"WITH RECURSIVE {_alpha_ctes(LOG_ALPHAS)}, " + bootstrap(f"SELECT a.horizon, a.origin_date, a.actual, a.forecast AS a, b.forecast AS b FROM (SELECT * FROM rf WHERE alpha=(SELECT alpha FROM asel WHERE selected)) a JOIN {_COMPARED}", **BOOTSTRAP),
        "bootstrap_baselines": q(F + ",\n", bootstrap(f"SELECT a.horizon, a.origin_date, a.actual, a.forecast AS a, b.forecast AS b FROM (SELECT * FROM f WHERE model='seasonal_naive') a JOIN {_COMPARED}", **BOOTSTRAP)),
        "top_contributors": q(CHANGES, "SELECT * REPLACE (round(share,6) AS share) FROM (SELECT entity, period, unit_id, value, CASE WHEN sum(value) OVER w>0 THEN value/sum(value) OVER w END AS share, row_number() OVER (PARTITION BY entity, period ORDER BY value DESC, unit_id)::INT AS rank FROM drill WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity, period)) WHERE rank<=3"),
        "drilldown": q(CHANGES, "SELECT entity, period, count(*) AS unit_rows, count(value) AS observed_units, round(sum(value),6) AS value, max(value) AS largest FROM drill GROUP BY 1,2"),
    }
