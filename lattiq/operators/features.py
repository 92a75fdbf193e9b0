"""Origin-safe features and supervised rows for the pooled linear candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.errors import FeatureError
from lattiq.functions.periods import at_offset, day, index, label, moved, shift

HORIZONS = (1, 2, 3, 4)
LOG = ["log_level_t", "log_change_1", "log_change_2", "log_change_3", "recent_zero_count", "origin_index"]
DELTA = ["level_t", "raw_change_1", "raw_change_2", "raw_change_3", "recent_zero_count", "origin_index"]


def panel_features(panel: DataFrame, *, modeling_start: str, horizons=HORIZONS) -> DataFrame:
    """Every panel row as a possible origin: four lags, what follows from them, and the labels ``horizons`` quarters on.

    Lags and labels are range frames over one sort by entity, so this is one shuffle, made
    once for all origins, horizons and penalties.
    """
    v = F.col("value")
    d = panel.select("entity", F.col("quarter").alias("origin_date"), *[at_offset(v, -k, "entity").alias(f"lag{k}") for k in range(4)],
                     *[at_offset(v, h, "entity").alias(f"label{h}") for h in horizons])
    g = [F.log1p(f"lag{k}") for k in range(4)]
    d = d.withColumns({
        "log_level_t": g[0], **{f"log_change_{k}": g[k - 1] - g[k] for k in (1, 2, 3)},
        "level_t": F.col("lag0"), **{f"raw_change_{k}": F.col(f"lag{k - 1}") - F.col(f"lag{k}") for k in (1, 2, 3)},
        "recent_zero_count": sum(F.coalesce((F.col(f"lag{k}") == 0).cast("int"), F.lit(0)) for k in range(4)),
        "origin_index": index(F.col("origin_date"), modeling_start),
        "complete": F.coalesce(*[F.when(F.col(f"lag{k}").isNull(), F.lit(False)) for k in range(4)], F.lit(True)),
    })
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"label{h}").alias("label")) for h in horizons]))
    d = d.select("*", rows.alias("x")).select("entity", "origin_date", *LOG, *[c for c in DELTA if c not in LOG], "complete", "x.horizon", "x.label")
    d = d.withColumn("target_date", moved(F.col("origin_date"), F.col("horizon")))
    return d.withColumn("target_quarter", F.quarter("target_date"))


def supervised(features: DataFrame, *, modeling_start: str, response: str = "log") -> DataFrame:
    """Rows that can be learned from once their target is known: complete lags, a label, and lags within the model's time."""
    d = features.where("complete and label is not null").where(F.col("origin_date") >= day(shift(modeling_start, 3)))
    y = F.log1p("label") - F.col("log_level_t") if response == "log" else F.col("label") - F.col("level_t")
    return d.withColumn("response", y)


def training_examples(features: DataFrame, *, outer_origin: str, horizon: int, modeling_start: str, response: str = "log") -> DataFrame:
    """The supervised rows of one fit: targets no later than the outer origin."""
    if horizon not in HORIZONS:
        raise FeatureError("horizons are one to four")
    d = supervised(features, modeling_start=modeling_start, response=response).where((F.col("horizon") == horizon) & (F.col("target_date") <= day(outer_origin)))
    return d.select("entity", label(F.col("origin_date")).alias("pseudo_origin"), F.col("origin_date").alias("pseudo_origin_date"), "target_date", "horizon", *(LOG if response == "log" else DELTA), "target_quarter", "response")


def prediction_features(features: DataFrame, cells: DataFrame, *, response: str = "log", check: bool = True) -> DataFrame:
    """The cells with their features; an eligible cell that lacks a lag is an error."""
    f = features.select("entity", "origin_date", "horizon", *(LOG if response == "log" else DELTA), "complete", "target_quarter")
    d = cells.join(f, ["entity", "origin_date", "horizon"], "left")
    if check and not d.where("not coalesce(complete, false)").isEmpty():
        raise FeatureError("an eligible cell lacks a lag")
    return d.drop("complete")
