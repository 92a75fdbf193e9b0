"""Conformal intervals, their metrics, and the paired moving-block bootstrap."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.errors import DiagnosticError, HoldoutError, PanelError
from lattiq.functions.periods import index, period_start
from lattiq.functions.ranks import running_sum, with_quantiles
from lattiq.operators.metrics import with_errors
from lattiq.operators.panel import unique
from lattiq.sources.sinks import cut

COVERAGES = (0.80, 0.95)


def suffix(coverage: float) -> str:
    return str(round(coverage * 100))


def conformal_rank(n: Column, coverage: float) -> Column:
    """The place, from 1, of the finite-sample quantile among n sorted values."""
    if not 0 < coverage < 1:
        raise PanelError("coverage lies between 0 and 1")
    return F.least(n, F.ceil((n + 1) * F.lit(coverage))).cast("int")


def finite_sample_quantile(values: list[float], coverage: float) -> float:
    """The same on the driver."""
    if not 0 < coverage < 1:
        raise PanelError("coverage lies between 0 and 1")
    ordered = sorted(v for v in values if math.isfinite(v))
    if not ordered:
        raise PanelError("no values to take a quantile of")
    return ordered[min(len(ordered), math.ceil((len(ordered) + 1) * coverage)) - 1]


def order_statistics(rows: DataFrame, value: str, keys: list[str], coverages=COVERAGES) -> DataFrame:
    """(keys, coverage, quantile, cells): conformal quantiles by group, without gathering a group.

    Rows with equal finite values become one count first; a running sum over the distinct values, made range by
    range, finds the one that holds the rank.
    """
    d = running_sum(finite(rows, value).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, [value])
    hit = [F.min(F.when(F.col("upto") >= conformal_rank(F.col("cells"), c), F.col(value))) for c in coverages]
    return _exploded(d.groupBy(*keys, "cells").agg(*[h.alias(f"q{i}") for i, h in enumerate(hit)]), keys, coverages)


def finite(rows: DataFrame, value: str) -> DataFrame:
    """The rows whose value is a finite number; null, NaN and infinity have no place in an order of errors."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def _exploded(d: DataFrame, keys: list[str], coverages) -> DataFrame:
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(f"q{i}").alias("quantile")) for i, c in enumerate(coverages)])).alias("x")
    return d.select(*keys, "cells", x).select(*keys, "x.coverage", "x.quantile", "cells")


def calibration_quantiles(forecasts: DataFrame, *, development_end: str, coverages=COVERAGES, check: bool = True) -> DataFrame:
    """Frozen quantiles by horizon and coverage, of scaled and of plain absolute errors."""
    if check and not forecasts.where(F.col("origin_date") > F.lit(period_start(development_end))).isEmpty():
        raise HoldoutError("calibration reaches past the development origins")
    d = cut(with_errors(forecasts).select("horizon", "origin_date", "scored", "scaled_error", "abs_error"))
    both = d.where("scored").select("horizon", F.explode(F.create_map(F.lit("scaled"), F.col("scaled_error"), F.lit("plain"), F.col("abs_error"))).alias("kind", "v"))
    q = cut(order_statistics(both, "v", ["kind", "horizon"], coverages))  # both errors in one pass
    scaled, plain = (q.where(F.col("kind") == k).select("horizon", "coverage", F.col("quantile").alias(f"{k}_quantile"), F.col("cells").alias(f"{k}_cells")) for k in ("scaled", "plain"))
    span = d.groupBy("horizon").agg(F.lit(1).alias("one")).join(d.agg(F.min("origin_date").alias("calibration_start"), F.max("origin_date").alias("calibration_end")), F.lit(True))
    return scaled.join(plain, ["horizon", "coverage"]).join(span.drop("one"), "horizon")


def _interval(d: DataFrame, margins: dict[float, Column]) -> DataFrame:
    for c, m in margins.items():
        s = suffix(c)
        d = d.withColumn("_m", m).withColumns({
            f"lower_{s}": F.when(F.col("_m").isNotNull(), F.greatest(F.lit(0.0), F.col("forecast") - F.col("_m"))),  # greatest() would make a bound of null
            f"upper_{s}": F.col("forecast") + F.col("_m"), f"interval_available_{s}": F.col("_m").isNotNull(),
        }).drop("_m")
    return d


def frozen_intervals(forecasts: DataFrame, quantiles: DataFrame, coverages=COVERAGES, *, check: bool = True) -> DataFrame:
    """Fixed quantiles times the scale (or alone, where there is none); actuals are not looked at."""
    if check:
        unique(quantiles, "horizon", "coverage")
    wide = quantiles.groupBy("horizon").agg(*[
        F.max(F.when(F.col("coverage") == c, F.col(k))).alias(f"{k}_{suffix(c)}") for c in coverages for k in ("scaled_quantile", "plain_quantile")])
    d = forecasts.join(wide, "horizon", "left")  # a row a horizon
    lacking = [f"{k}_{suffix(c)}" for c in coverages for k in ("scaled_quantile", "plain_quantile")]
    if check and not d.where(" or ".join(f"{c} is null" for c in lacking)).isEmpty():
        raise PanelError("a horizon has no frozen quantile")
    scaled = F.coalesce(F.col("scale") > 0, F.lit(False))
    d = _interval(d, {c: F.when(scaled, F.col(f"scaled_quantile_{suffix(c)}") * F.col("scale")).otherwise(F.col(f"plain_quantile_{suffix(c)}")) for c in coverages})
    return d.withColumn("interval_source", F.when(scaled, "entity_scale").otherwise("pooled_plain")).drop(*lacking)


def pool_quantiles(errors: DataFrame, keys: list[str], value: str, later: list[int], coverages) -> DataFrame:
    """(keys, at, q_<coverage>...): for each origin ``at`` in ``later``, conformal quantiles of the values (keys, nth, value) with nth < at.

    Values are put in order once, range by range, and counted by range and origin.  A pool's rank lies in one range; only that range's
    rows meet the pool, so rows met are the pools (as many as the calendar has) times a range's share of all rows.
    """
    n = int(errors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = errors.groupBy(*keys, "nth", value).agg(F.count("*").alias("n"))
    d = cut(d.repartitionByRange(n, *keys, value).withColumn("r", F.spark_partition_id()))  # equal values share a range
    pools = F.array(*[F.struct(F.lit(at).alias("at"), F.coalesce(F.sum(F.when(F.col("nth") < at, F.col("n"))), F.lit(0)).alias("own")) for at in later]) if later else F.array().cast("array<struct<at int, own bigint>>")
    sums = d.groupBy(*keys, "r").agg(pools.alias("pools")).select(*keys, "r", F.inline("pools")).where("own > 0")  # a row for each range and origin at most
    by = Window.partitionBy(*keys, "at")
    sums = sums.withColumns({"before": F.coalesce(F.sum("own").over(by.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "cells": F.sum("own").over(by)})
    ranks = F.array(*[F.struct(F.lit(suffix(c)).alias("c"), conformal_rank(F.col("cells"), c).alias("rank")) for c in coverages])
    hit = sums.select(*keys, "at", "r", "before", "own", F.inline(ranks)).where("rank > before and rank <= before + own")
    met = d.join(F.broadcast(hit.drop("own")), [*keys, "r"]).where("nth < at")  # a row for each pool and coverage: the calendar bounds them
    met = met.groupBy(*keys, "at", "c", "before", "rank", value).agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "at", "c").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = met.withColumn("upto", upto).where("upto >= rank")
    return found.groupBy(*keys, "at").agg(*[F.min(F.when(F.col("c") == suffix(c), F.col(value))).alias(f"q_{suffix(c)}") for c in coverages])


def prequential_intervals(forecasts: DataFrame, *, warmup_origins: int = 8, coverages=COVERAGES) -> DataFrame:
    """Intervals from the scored errors of strictly earlier origins of the same horizon.

    The pools of all origins are counted over one order of the errors (``pool_quantiles``), of both kinds in one pass.  Rows then
    look up their origin's quantiles; a row never meets the errors before it one by one.
    """
    if warmup_origins < 1:
        raise PanelError("warm-up takes an origin at least")
    e = cut(with_errors(forecasts))
    origins = cut(e.select("origin_date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("origin_date"))))
    later = [r.nth for r in origins.where(F.col("nth") > warmup_origins).select("nth").orderBy("nth").collect()]  # as many as there are origins
    out = e.join(origins, "origin_date")
    kinds = F.explode(F.create_map(F.lit("scaled"), F.col("scaled_error"), F.lit("plain"), F.col("abs_error"))).alias("kind", "v")
    past = finite(out.where("scored").select("horizon", "nth", kinds), "v")
    q = cut(pool_quantiles(past, ["kind", "horizon"], "v", later, coverages))
    for kind in ("scaled", "plain"):
        own = q.where(F.col("kind") == kind).select("horizon", F.col("at").alias("nth"), *[F.col(f"q_{suffix(c)}").alias(f"{kind}_{suffix(c)}") for c in coverages])
        out = out.join(own, ["horizon", "nth"], "left")
    scaled = F.coalesce(F.col("scale") > 0, F.lit(False))
    out = _interval(out, {c: F.when(scaled, F.col(f"scaled_{suffix(c)}") * F.col("scale")).otherwise(F.col(f"plain_{suffix(c)}")) for c in coverages})
    some = F.col(f"interval_available_{suffix(coverages[0])}")
    source = F.when(some & scaled, "entity_scale").when(some, "pooled_plain").otherwise("")
    return out.withColumn("interval_source", source).drop("nth", *[f"{n}_{suffix(c)}" for n in ("scaled", "plain") for c in coverages])


def interval_metrics(forecasts: DataFrame, coverages=COVERAGES, *, pooled: bool = False) -> DataFrame:
    """By coverage and horizon (with ``pooled``, also over all horizons, horizon null): coverage, widths, Winkler score."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(f"lower_{suffix(c)}").alias("lo"), F.col(f"upper_{suffix(c)}").alias("hi"), F.col(f"interval_available_{suffix(c)}").alias("ok")) for c in coverages]))
    d = forecasts.select("horizon", "actual", x.alias("x")).select("horizon", "actual", "x.*")
    d = d.withColumn("ok", F.col("ok") & F.col("actual").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull())
    a, lo, hi, width = F.col("actual"), F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo")
    winkler = width + 2 / (1 - F.col("coverage")) * F.when(a < lo, lo - a).when(a > hi, a - hi).otherwise(0.0)
    on = lambda c: F.when(F.col("ok"), c)
    d = cut(d.select("coverage", "horizon", "ok", "actual", "lo", "hi", on(width).alias("width")))
    aggs = [F.count_if("ok").alias("interval_cells"), F.avg(on(a.between(lo, hi).cast("double"))).alias("empirical_coverage"), F.avg(on(width)).alias("mean_width"),
            F.avg(on(F.when(a > 0, width / a))).alias("mean_relative_width"), F.avg(on(winkler)).alias("mean_winkler")]
    own, keys = d.groupBy("coverage", "horizon").agg(*aggs).withColumn("scope", F.lit("horizon")), ["scope", "coverage", "horizon"]
    widths = d.select(F.lit("horizon").alias("scope"), "coverage", "horizon", "width")
    if pooled:
        every = {"horizon": F.lit(None).cast("int"), "scope": F.lit("pooled")}
        own = own.unionByName(d.groupBy("coverage").agg(*aggs).withColumns(every))
        widths = widths.unionByName(d.select("coverage", "width").withColumns(every))
    return with_quantiles(own, widths, keys, "width", {"median_width": 0.5})


def guardrails(pooled: DataFrame, bounds: dict[float, tuple[float, float]]) -> DataFrame:
    ok = F.coalesce(*[F.when(F.col("coverage") == c, F.col("empirical_coverage").between(a, b)) for c, (a, b) in bounds.items()])
    return pooled.where("scope = 'pooled'").select("coverage", "empirical_coverage", ok.alias("within"))


def block_starts(n_origins: int, *, block_length: int, replications: int, seed: int) -> np.ndarray:
    """Origin numbers (replications, n_origins) of moving blocks; draws come one at a time, as the seed defines."""
    if not 1 <= block_length <= n_origins:
        raise PanelError("a block has 1 to all origins")
    if replications < 1:
        raise PanelError("replications are positive")
    rng, starts = np.random.default_rng(seed), np.arange(n_origins - block_length + 1)
    per = -(-n_origins // block_length)
    first = np.array([int(rng.choice(starts)) for _ in range(replications * per)]).reshape(replications, per)
    return (first[:, :, None] + np.arange(block_length)).reshape(replications, -1)[:, :n_origins]


def drawn_blocks(spark: SparkSession, n_origins: int, *, block_length: int, replications: int, seed: int) -> DataFrame:
    """(replication, nth, w): how often a replication takes the nth origin (from 1), its blocks' starts drawn by a hash of seed, replication and block.

    Any task can make any replication's draws, so they are rows like others and nothing is drawn on the driver.
    """
    if not 1 <= block_length <= n_origins:
        raise PanelError("a block has 1 to all origins")
    if replications < 1:
        raise PanelError("replications are positive")
    each = spark.range(replications).select(F.col("id").cast("int").alias("replication"), F.explode(F.sequence(F.lit(0), F.lit(-(-n_origins // block_length) - 1))).alias("block"))
    # 52 bits of the hash as a fraction of one.
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replication", "block").cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    each = each.withColumn("start", F.floor(u * (n_origins - block_length + 1)).cast("int"))
    at = each.select("replication", "start", F.col("block") * block_length, F.explode(F.sequence(F.lit(0), F.lit(block_length - 1))).alias("k")).toDF("replication", "start", "before", "k")
    return at.where(F.col("before") + F.col("k") < n_origins).groupBy("replication", (F.col("start") + F.col("k") + 1).alias("nth")).agg(F.count("*").cast("int").alias("w"))


def seeded_blocks(spark: SparkSession, n_origins: int, **how: int) -> DataFrame:
    """The same from numpy's generator, one draw after the other as its seed defines: for figures that were published so."""
    draws = block_starts(n_origins, **how)
    rows = [(r, int(o) + 1, int(n)) for r, own in enumerate(draws) for o, n in zip(*np.unique(own, return_counts=True), strict=True)]
    return spark.createDataFrame(rows, "replication int, nth int, w int")


def bootstrap_skill(pairs: DataFrame, *, block_length: int, replications: int, seed: int, generator: str = "hash") -> DataFrame:
    """WAPE skill of candidate over comparator: point value and 95 % bootstrap bounds by horizon, and their equal-weight mean.

    Errors are summed by (horizon, origin) once; a replication only reweights those sums.
    The weights are (replication, origin) rows, few whatever the panel's size; ``generator`` is "hash" or "numpy".
    """
    spark = pairs.sparkSession
    d = pairs.where("actual is not null and candidate_forecast is not null and comparator_forecast is not null")
    sums = cut(d.groupBy("horizon", "origin_date").agg(F.sum(F.abs(F.col("candidate_forecast") - F.col("actual"))).alias("a"), F.sum(F.abs(F.col("comparator_forecast") - F.col("actual"))).alias("b"), F.sum("actual").alias("v")))
    origins = sums.select("origin_date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("origin_date")))  # quarters
    draw = {"hash": drawn_blocks, "numpy": seeded_blocks}[generator]
    w = draw(spark, origins.count(), block_length=block_length, replications=replications, seed=seed)
    skill = lambda a, b, v: F.when((v > 0) & (b > 0), 1 - a / b)
    point = sums.groupBy("horizon").agg(skill(F.sum("a"), F.sum("b"), F.sum("v")).alias("point_skill"))
    s = [F.sum(F.col(c) * F.col("w")) for c in ("a", "b", "v")]
    boot = cut(sums.join(origins, "origin_date").join(w, "nth").groupBy("replication", "horizon").agg(skill(*s).alias("skill")))
    bounds = {"lower_95": 0.025, "upper_95": 0.975}
    own = with_quantiles(point, boot, ["horizon"], "skill", bounds).withColumn("summary", F.concat(F.lit("horizon_"), F.col("horizon").cast("string")))
    every = boot.groupBy("replication").agg(F.avg("skill").alias("skill")).withColumn("summary", F.lit("equal_weight_mean"))
    mean = point.agg(F.avg("point_skill").alias("point_skill")).withColumns({"horizon": F.lit(None).cast("int"), "summary": F.lit("equal_weight_mean")})
    mean = with_quantiles(mean, every, ["summary"], "skill", bounds)
    return own.unionByName(mean).withColumn("replications", F.lit(replications))


def selection_only(forecasts: DataFrame, selection_end: str) -> DataFrame:
    """The forecasts, once it is sure that none is of an origin after the selection's last one."""
    if not forecasts.where(F.col("origin_date") > F.lit(period_start(selection_end))).isEmpty():
        raise DiagnosticError(f"diagnostics of the selection were given origins after {selection_end}")
    return forecasts


def residual_acf(forecasts: DataFrame, *, lags=(1, 4), minimum_pairs: int = 12) -> DataFrame:
    """Correlation of a (entity, horizon)'s errors with those so many quarters before; null with few pairs or a constant side."""
    d = forecasts.where("scored").select("entity", "horizon", "origin_date", (F.col("forecast") - F.col("actual")).alias("x"))
    w = Window.partitionBy("entity", "horizon").orderBy(index(F.col("origin_date")))
    d = d.select("entity", "horizon", "x", *[F.first("x").over(w.rangeBetween(-k, -k)).alias(f"y{k}") for k in lags])
    before = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in lags]))
    d = d.select("entity", "horizon", "x", before.alias("b")).select("entity", "horizon", "b.lag", F.when(F.col("b.y").isNotNull(), F.col("x")).alias("x"), "b.y")
    n = F.count("y")
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y")) & (n >= minimum_pairs)
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop(F.when(F.col("y").isNotNull(), F.col("x"))) * F.stddev_pop("y"))
    return d.groupBy("entity", "horizon", "lag").agg(n.alias("pairs"), F.when(varied, r).alias("correlation"))


def acf_summary(acf: DataFrame) -> DataFrame:
    acf = cut(acf.select("horizon", "lag", "correlation"))
    own = acf.groupBy("horizon", "lag").agg(F.count("correlation").alias("defined"), F.avg(F.abs("correlation")).alias("mean_abs"))
    return with_quantiles(own, acf, ["horizon", "lag"], "correlation", {"median": 0.5})


def binned_residuals(forecasts: DataFrame, *, column: str, bins: int = 10) -> DataFrame:
    """Errors by rank bins of ``column`` within a horizon; ties rank in the order of origin and entity."""
    if bins < 2:
        raise PanelError("two bins at least")
    d = forecasts.where("scored").where(F.col(column).isNotNull()).withColumn("error", F.col("forecast") - F.col("actual"))
    place = running_sum(d.withColumn("one", F.lit(1)), ["horizon"], [column, "origin_date", "entity"], "one")
    d = place.withColumn("bin", F.least(F.lit(bins), F.ceil(F.col("upto") / F.col("cells") * bins)).cast("int"))
    return d.groupBy("horizon", "bin").agg(F.count("*").alias("rows"), F.avg("error").alias("mean_error"), F.avg(F.abs("error")).alias("mean_abs_error"),
                                           F.min(column).alias("diagnostic_min"), F.max(column).alias("diagnostic_max")).withColumn("diagnostic", F.lit(column))
