"""Pooled ridge candidates, refitted at each origin and horizon for all penalties, from sums alone.

The design has a constant (log response only), standardised numbers, and one-hot columns for the target's quarter and for the entity.
The entities' block of the normal equations is diagonal, so it is eliminated: for a penalty, an entity with n rows, sums s of
the other columns and t of the response has the coefficient (t - s.c) / (n + penalty), and takes s s' / (n + penalty) from
the equations for c.  What is left is eleven equations, whatever the number of entities and rows.

Spark makes all sums: cross products by target date, of which origins take prefixes in time; and one running sum for each
(entity, horizon), read off at each origin.  Training rows are never copied for an origin and never meet in one task.  The eleven
equations of each (origin, horizon, penalty), of which the calendar bounds the number, are arrays that expressions eliminate row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.errors import PanelError, SelectionError
from lattiq.functions.periods import day, shift
from lattiq.operators.cells import flags
from lattiq.operators.features import DELTA, LOG, prediction_features, supervised
from lattiq.sources.sinks import cut

QUARTERS = (1, 2, 3, 4)
#: An eigenvalue of so small a share of the largest one is zero, as far as doubles can tell.
SINGULAR = 1e-12


def _each(n: int, value: Callable[[Column], Column]) -> Column:
    """The array of ``value`` at 0 to n - 1."""
    return F.transform(F.array(*map(F.lit, range(n))), value)


def _square(upper: Column, size: int) -> Column:
    """A symmetric matrix, as an array of rows, from its upper triangle."""
    at = lambda i, j: (i * (2 * size - 1 - i) / 2).cast("int") + j
    return _each(size, lambda i: _each(size, lambda j: F.get(upper, at(F.least(i, j), F.greatest(i, j)))))


def _at(m: Column, i, j) -> Column:
    return F.get(F.get(m, i if isinstance(i, Column) else F.lit(i)), j if isinstance(j, Column) else F.lit(j))


def _inverse_times(m: Column, n: int) -> Column:
    """The solution of n equations, from an array of rows with the right side last, by elimination row by row.

    The systems are positive definite, so every pivot is positive and none has to be searched for.
    """
    def step(a: Column, k: Column) -> Column:
        pivot = F.transform(F.get(a, k), lambda x: x / _at(a, k, k))
        return F.transform(a, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - F.get(row, k) * y)))

    done = F.aggregate(F.array(*map(F.lit, range(n))), m, step)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))


def _extreme_eigenvalues(m: Column, n: int, sweeps: int = 8) -> Column:
    """An array of a symmetric matrix's eigenvalues, by rotations that make one pair of entries zero after the other."""
    def step(a: Column, pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        off = _at(a, p, q)
        tau = (_at(a, q, q) - _at(a, p, p)) / (2 * off)
        t = F.when(off == 0, F.lit(0.0)).otherwise(F.when(tau < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / (F.abs(tau) + F.sqrt(1 + tau * tau)))
        # One rotation as (cosine, sine), made once and used in rows and columns.
        turn = F.transform(F.array(t), lambda x: F.struct((1 / F.sqrt(1 + x * x)).alias("c"), (x / F.sqrt(1 + x * x)).alias("s")))

        def rotated(x: Column) -> Column:
            c, s = x["c"], x["s"]
            rows = F.transform(a, lambda row, i: F.when(i == p, F.zip_with(F.get(a, p), F.get(a, q), lambda u, v: c * u - s * v)).when(
                i == q, F.zip_with(F.get(a, p), F.get(a, q), lambda u, v: s * u + c * v)).otherwise(row))
            return F.transform(rows, lambda row: F.transform(row, lambda u, j: F.when(j == p, c * F.get(row, p) - s * F.get(row, q)).when(j == q, s * F.get(row, p) + c * F.get(row, q)).otherwise(u)))

        return F.get(F.transform(turn, rotated), F.lit(0))

    pairs = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(sweeps) for p in range(n) for q in range(p + 1, n)]
    done = F.aggregate(F.array(*pairs), m, step)
    return F.transform(done, lambda row, i: F.get(row, i))


def _fits(systems: DataFrame, size: int, k: int, intercept: bool) -> DataFrame:
    """``systems`` (gram, taken, low, high by outer, horizon and alpha) with ``w`` (coefficients of standardised columns, the constant first), ``raw``
    (the same for raw columns) and ``held`` (columns that training has).

    ``gram`` has the cross products of constant, numbers, quarters and response; ``taken`` what the entities take from them.
    """
    n, last = size - 1, size - 1
    d = systems.withColumns({"g": _square(F.col("gram"), size), "t": _square(F.col("taken"), size)})
    number = lambda i: (i >= 1) & (i <= k)
    d = d.withColumn("mean", _each(size, lambda i: F.when(number(i), _at(F.col("g"), 0, i) / _at(F.col("g"), 0, 0)).otherwise(0.0)))
    variance = lambda i: F.greatest(_at(F.col("g"), i, i) / _at(F.col("g"), 0, 0) - F.get("mean", i) * F.get("mean", i), F.lit(0.0))
    varied = lambda i: F.get("low", i - 1) < F.get("high", i - 1)
    d = d.withColumn("spread", _each(size, lambda i: F.when(number(i) & varied(i) & (variance(i) > 0), F.sqrt(variance(i))).otherwise(1.0)))  # constant columns stay
    d = d.withColumn("left", _each(size, lambda i: F.zip_with(F.get("g", i), F.get("t", i), lambda x, y: x - y)))
    left = lambda i, j: _at(F.col("left"), i, j)
    centred = lambda i, j: left(i, j) - F.get("mean", j) * left(i, F.lit(0)) - F.get("mean", i) * left(F.lit(0), j) + F.get("mean", i) * F.get("mean", j) * left(F.lit(0), F.lit(0))
    entry = lambda i, j: centred(i, j) / (F.get("spread", i) * F.get("spread", j)) + F.when((i == j) & (i > 0), F.col("alpha")).otherwise(0.0)
    if not intercept:  # the constant's equation says zero
        inner, entry = entry, lambda i, j: F.when((i == 0) | (j == 0), (i == j).cast("double")).otherwise(inner(i, j))
    equations = _each(n, lambda i: _each(size, lambda j: entry(i, j)))
    d = d.withColumn("equations", equations).withColumn("w", _inverse_times(F.col("equations"), n))
    shifted = F.aggregate(F.array(*map(F.lit, range(1, k + 1))), F.get("w", F.lit(0)), lambda acc, i: acc - F.get("mean", i) / F.get("spread", i) * F.get("w", i))
    raw = F.transform("w", lambda x, i: F.when(i == 0, shifted).otherwise(x / F.get("spread", i)))
    held = _each(n, lambda i: (i <= k) | (_at(F.col("g"), i, i) > 0))
    return d.select("outer", "horizon", "alpha", "w", held.alias("held"), raw.alias("raw"), F.round(_at(F.col("g"), 0, 0)).cast("long").alias("rows"))


def _diagnostics(grown: DataFrame, size: int, k: int) -> DataFrame:
    """(outer, horizon, training_rows, condition, correlation): the condition number of the standardised numbers, and their largest absolute correlation."""
    d = grown.select("outer", "horizon", "low", "high", _square(F.col("gram"), size).alias("g"))
    g = lambda i, j: _at(F.col("g"), i, j)
    varied = lambda i: F.get("low", i) < F.get("high", i)
    cov = lambda i, j: g(i + 1, j + 1) / g(0, 0) - g(0, i + 1) / g(0, 0) * (g(0, j + 1) / g(0, 0))
    # A constant column stands alone with 1, which lies between the others' extremes.
    entry = lambda i, j: F.when(i == j, F.lit(1.0)).when(varied(i) & varied(j), cov(i, j) / F.sqrt(cov(i, i) * cov(j, j))).otherwise(0.0)
    d = d.withColumn("r", _each(k, lambda i: _each(k, lambda j: entry(i, j))))
    d = d.withColumn("values", F.array_sort(_extreme_eigenvalues(F.col("r"), k)))
    least, most = F.get("values", F.lit(0)), F.get("values", F.lit(k - 1))
    n_varied = F.aggregate(F.zip_with("low", "high", lambda a, b: (a < b).cast("int")), F.lit(0), lambda a, x: a + x)
    off = F.array_max(F.flatten(F.transform("r", lambda row, i: F.transform(row, lambda x, j: F.when(i < j, F.abs(x)).otherwise(0.0)))))
    return d.select("outer", "horizon", F.round(g(0, 0)).cast("long").alias("training_rows"),
                    F.when(n_varied > 0, F.when(least > SINGULAR * most, F.sqrt(most / least)).otherwise(float("inf"))).alias("condition"), F.when(n_varied > 0, off).alias("correlation"))


def _products(cols: list[str], over=None) -> list:
    """Sums of products of all pairs of columns, in the order of an upper triangle."""
    each = [F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]]
    return [F.sum(x / over if over is not None else x) for x in each]


def _grown(rows: DataFrame, outers: list, cols: list[str], numeric: list[str]) -> DataFrame:
    """(outer, horizon, gram, low, high) of all training rows: an upper triangle as an array, and the numbers' extremes."""
    many = len(cols) * (len(cols) + 1) // 2
    by_date = rows.groupBy("horizon", "target_date").agg(*[x.alias(f"g{i}") for i, x in enumerate(_products(cols))], *[f(c).alias(f"{n}_{c}") for c in numeric for f, n in ((F.min, "low"), (F.max, "high"))])
    at = F.explode(F.array(*[F.lit(o) for o in outers])).alias("outer")
    return by_date.select("*", at).where("target_date <= outer").groupBy("outer", "horizon").agg(  # a row for each two dates and horizon
        F.array(*[F.sum(f"g{i}") for i in range(many)]).alias("gram"), F.array(*[F.min(f"low_{c}").cast("double") for c in numeric]).alias("low"), F.array(*[F.max(f"high_{c}").cast("double") for c in numeric]).alias("high"))


def _taken(sums: DataFrame, alphas: list[float], cols: list[str]) -> DataFrame:
    """(outer, horizon, alpha, taken): what the entities take from the equations."""
    penalties = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    return sums.select("*", penalties).groupBy("outer", "horizon", "alpha").agg(F.array(*_products(cols, F.col("one") + F.col("alpha"))).alias("taken"))


def candidate_rows(features: DataFrame, outers: list, *, modeling_start: str) -> DataFrame:
    """(outer, horizon, candidate_rows): rows of the panel that a fit could learn from if no lag and no label were missing."""
    d = features.where(F.col("origin_date") >= day(shift(modeling_start, 3))).groupBy("horizon", "target_date").agg(F.count("*").alias("n"))
    d = d.select("*", F.explode(F.array(*[F.lit(o) for o in outers])).alias("outer")).where("target_date <= outer")
    return d.groupBy("outer", "horizon").agg(F.sum("n").alias("candidate_rows"))


def rolling_candidates(features: DataFrame, cells: DataFrame, *, alphas: Iterable[float], modeling_start: str, response: str = "log", check: bool = True) -> dict[str, DataFrame]:
    """Forecasts, coefficients and training diagnostics for every (penalty, origin, horizon)."""
    alphas, numeric, intercept = [float(a) for a in alphas], LOG if response == "log" else DELTA, response == "log"
    if not alphas or not all(math.isfinite(a) and a > 0 for a in alphas):
        raise PanelError("a penalty is positive and finite")
    outers = [r[0] for r in cells.select("origin_date").distinct().orderBy("origin_date").collect()]  # quarters
    if not outers:
        raise PanelError("no cells")
    cols = ["one", *numeric, *[f"quarter_{q}" for q in QUARTERS], "response"]
    rows = supervised(features, modeling_start=modeling_start, response=response)
    rows = rows.select("entity", "horizon", "target_date", F.lit(1.0).alias("one"), *[F.col(c).cast("double").alias(c) for c in numeric],
                       *[(F.col("target_quarter") == q).cast("double").alias(f"quarter_{q}") for q in QUARTERS], "response")
    # An entity's rows up to each origin: origins stand among its rows as rows of nulls, where the running sums are read off.
    stops = rows.select("entity", "horizon").distinct().select("entity", "horizon", F.explode(F.array(*[F.lit(o) for o in outers])).alias("target_date"), *[F.lit(None).cast("double").alias(c) for c in cols])
    upto = Window.partitionBy("entity", "horizon").orderBy(F.col("target_date")).rangeBetween(Window.unboundedPreceding, 0)
    sums = rows.unionByName(stops).select("entity", "horizon", F.col("target_date").alias("outer"), F.col("one").isNull().alias("stop"), *[F.sum(c).over(upto).alias(c) for c in cols])
    sums = cut(sums.where("stop and one is not null").drop("stop"))
    names = [*[f"numeric__{c}" for c in numeric], *[f"categorical__target_quarter_{q}" for q in QUARTERS]]

    grown = cut(_grown(rows, outers, cols, numeric))
    fits = cut(_fits(grown.join(_taken(sums, alphas, cols), ["outer", "horizon"]), len(cols), len(numeric), intercept))
    few = F.broadcast(fits)  # a row for each origin, horizon and penalty: the calendar bounds them
    own = (F.col("response") - sum(F.col(c) * F.get("raw", F.lit(i)) for i, c in enumerate(cols[:-1]))) / (F.col("one") + F.col("alpha"))
    entities = sums.join(few, ["outer", "horizon"]).select("outer", "horizon", "alpha", "entity", own.alias("own"))

    ask = prediction_features(features, cells, response=response, check=check).withColumn("outer", F.col("origin_date"))
    ask = ask.select(*[F.col(c).alias(c) for c in ("entity", "outer", "horizon", *numeric, "target_quarter")])  # new columns: both sides stem from one panel
    d = ask.join(few.select("outer", "horizon", "alpha", "raw", "rows"), ["outer", "horizon"], "left").join(entities, ["outer", "horizon", "alpha", "entity"], "left")
    quarter = F.coalesce(*[F.when(F.col("target_quarter") == q, F.get("raw", F.lit(len(numeric) + q))) for q in QUARTERS])
    level = F.col(numeric[0]) + F.get("raw", F.lit(0)) + sum(F.col(c) * F.get("raw", F.lit(i + 1)) for i, c in enumerate(numeric)) + quarter + F.coalesce("own", F.lit(0.0))
    d = d.withColumn("level", F.when(F.col("alpha").isNull(), F.raise_error(F.lit("no training rows")).cast("double")).otherwise(level))
    floor = F.greatest(F.col("level"), F.lit(0.0))
    forecast = F.expm1(floor) if response == "log" else floor
    sound = F.col("level").isNotNull() & ~F.isnan(forecast) & (forecast < float("inf"))
    f = d.select("alpha", F.col("outer").alias("origin_date"), "horizon", "entity", F.when(sound, forecast).otherwise(F.raise_error(F.lit("a forecast is not finite")).cast("double")).alias("forecast"),
                 (F.col("level") < 0).alias("floored"), F.col("own").isNotNull().alias("seen"), "rows")
    forecasts = flags(cells.join(f, ["entity", "origin_date", "horizon"]).withColumn("model", F.lit("pooled_ridge_" + response)))
    key = [F.col("alpha"), F.col("outer").alias("origin_date"), F.col("horizon")]
    constant = F.get("w", F.lit(0))
    shared = fits.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.get("w", F.lit(i + 1)).alias("coefficient"), F.get("held", F.lit(i + 1)).alias("held")) for i, n in enumerate(names)])).alias("x"), constant.alias("intercept"))
    shared = shared.where("x.held").select("alpha", "origin_date", "horizon", "x.feature", "x.coefficient", "intercept")
    each = entities.join(few.select("outer", "horizon", "alpha", constant.alias("intercept")), ["outer", "horizon", "alpha"])
    each = each.select(*key, F.concat(F.lit("categorical__entity_"), "entity").alias("feature"), F.col("own").alias("coefficient"), "intercept")
    seen = _diagnostics(grown, len(cols), len(numeric)).join(candidate_rows(features, outers, modeling_start=modeling_start), ["outer", "horizon"])
    seen = seen.select(F.col("outer").alias("origin_date"), "horizon", "training_rows", F.col("candidate_rows").alias("candidate_training_rows"), (F.col("candidate_rows") - F.col("training_rows")).alias("excluded_training_rows"), "condition", "correlation")
    return {"forecasts": forecasts, "coefficients": shared.unionByName(each), "diagnostics": seen}


def alpha_summary(metrics: DataFrame) -> DataFrame:
    """By penalty: mean WAPE skill over horizons (alpha, horizon, wape, comparator_wape, prediction_coverage)."""
    return metrics.groupBy("alpha").agg(F.avg(1 - F.col("wape") / F.col("comparator_wape")).alias("mean_skill"), F.min("prediction_coverage").alias("min_coverage"), F.count_distinct("horizon").alias("horizons"))


def select_alpha(metrics: DataFrame, tolerance: float = 1e-4, *, check: bool = True) -> DataFrame:
    """The summary with ``eligible`` and ``selected``: the largest penalty within ``tolerance`` of the best."""
    if check:
        from lattiq.operators.panel import unique

        unique(metrics, "alpha", "horizon")
        if not metrics.where("comparator_wape <= 0").isEmpty():
            raise SelectionError("the comparator's WAPE is positive")
    d = alpha_summary(metrics).withColumn("eligible", F.col("min_coverage") == 1)
    best = d.where("eligible").agg(F.max("mean_skill").alias("best"))
    if check and best.first()[0] is None:
        raise SelectionError("no penalty covers all cells")
    near = d.join(best, F.lit(True)).where("eligible").where(F.col("mean_skill") >= F.col("best") - tolerance).agg(F.max("alpha").alias("chosen"))
    return d.join(near, F.lit(True)).withColumn("selected", F.coalesce(F.col("alpha") == F.col("chosen"), F.lit(False))).drop("chosen")


def pair_with_comparator(candidate: DataFrame, baseline: DataFrame, mapping: dict[int, str], *, check: bool = True) -> DataFrame:
    """Candidate and comparator forecasts of the same cell; a cell without comparator is an error."""
    from lattiq.operators.cells import by_horizon

    keys = ["entity", "origin_date", "target_date", "horizon"]
    b = baseline.where(F.col("model") == by_horizon(mapping)).select(*keys, F.col("forecast").alias("comparator_forecast"))
    d = candidate.select(*keys, "actual", F.col("forecast").alias("candidate_forecast")).join(b, keys, "left")
    if check and not d.where("comparator_forecast is null").isEmpty():
        raise SelectionError("a candidate's cell has no comparator")
    return d


def diagnostic_summary(forecasts: DataFrame) -> DataFrame:
    from lattiq.operators.metrics import with_errors

    on = lambda c: F.when(F.col("scored"), F.col(c))
    v = F.coalesce(F.sum(on("actual")), F.lit(0.0))
    return with_errors(forecasts).groupBy("horizon").agg(
        F.count("*").alias("forecast_rows"), F.count_if("scored").alias("scored_cells"), F.when(v > 0, F.sum(on("error")) / v).alias("bias"), F.avg(on("abs_error")).alias("mae"),
        F.avg(on("scaled_error")).alias("mean_scaled_error"), F.avg(F.col("floored").cast("double")).alias("floor_rate"), F.count_if(~F.col("seen")).alias("unseen_rows"))


def promotion(spark, overall: dict[str, float], gates: dict[str, tuple[float, float]]) -> DataFrame:
    """A row for each gate: its value, bounds, and whether it is met."""
    met = lambda v, a, b: v is not None and a <= v <= b
    rows = [(k, overall.get(k), float(a), float(b), met(overall.get(k), a, b)) for k, (a, b) in gates.items()]
    return spark.createDataFrame(rows, "gate string, value double, low double, high double, met boolean")
