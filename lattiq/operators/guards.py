"""Guards that are watched while a table is made, instead of in jobs of their own.

``watch`` puts counts of bad rows into a table's plan; they are made when the table is written.  ``settle`` then reads
them and raises on the first that is not zero: call it after the table stands and before anybody uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lattiq.errors import EvaluationError, PanelError
from lattiq.functions.periods import day, label


class Guards:
    def __init__(self) -> None:
        self._watched: list[tuple[Observation, type[Exception], list[str]]] = []

    def watch(self, df: DataFrame, error: type[Exception], bad: dict[str, Column]) -> DataFrame:
        """``df`` with a count of the rows for which each condition of ``bad`` (by message) holds."""
        return self.watch_sums(df, error, {what: F.coalesce(c, F.lit(False)).cast("long") for what, c in bad.items()})

    def watch_sums(self, df: DataFrame, error: type[Exception], zero: dict[str, Column]) -> DataFrame:
        """``df`` with sums that must come out as zero."""
        seen = Observation()
        self._watched.append((seen, error, list(zero)))
        return df.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(f"g{i}") for i, c in enumerate(zero.values())])

    def settle(self) -> None:
        """Raise what was found.  Every watched table must have been written."""
        watched, self._watched = self._watched, []
        for seen, error, names in watched:
            found = seen.get
            for i, what in enumerate(names):
                if found[f"g{i}"]:
                    raise error(f"{what}: {found[f'g{i}']}")


def watched_panel(panel: DataFrame, guards: Guards, last: str) -> DataFrame:
    """The panel, watched for repeated keys, dates, signs, labels and quarters after ``last``.

    A repeated key is a row whose quarter is that of the row before it: the order by entity and quarter that lags and labels need, too.
    """
    date, value = F.col("quarter"), F.col("value")
    again = F.lag("quarter").over(Window.partitionBy("entity").orderBy("quarter")) == date
    start = (F.dayofmonth(date) == 1) & F.month(date).isin(1, 4, 7, 10)
    d = panel.withColumn("_again", again)
    d = guards.watch(d, EvaluationError, {f"values after {last}": date > day(last)})
    return guards.watch(d, PanelError, {
        "panel has repeated entity-quarter keys": F.col("_again"), "panel has dates that start no quarter": ~F.coalesce(start, F.lit(False)), "panel has negative values": value < 0,
        "panel has labels that disagree with dates": ~F.coalesce(label(date) == F.col("period"), F.lit(False)),
    }).drop("_again")


def watched_baselines(forecasts: DataFrame, guards: Guards, *, equal_at: int | None) -> DataFrame:
    """Baseline forecasts, watched for sources after their origins, missing forecasts, and models that disagree ``equal_at`` quarters ahead."""
    d = guards.watch(forecasts, PanelError, {
        "only eligible cells are forecast": ~F.col("eligible"), "forecasts use what came after their origin": F.col("source_date") > F.col("origin_date"),
        "forecasts are missing": ~F.col("prediction_available"),
    })
    if equal_at is None:
        return d
    # One model's hashes are added and the other's taken off: what is left is of cells on which they differ.
    h = F.pmod(F.xxhash64("entity", "origin_date", "forecast"), F.lit(1 << 40))
    signed = F.when(F.col("horizon") == equal_at, F.when(F.col("model") == "persistence", h).otherwise(-h)).otherwise(0)
    return guards.watch_sums(d, PanelError, {f"the baselines disagree {equal_at} quarters ahead": signed})
