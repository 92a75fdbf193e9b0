"""Guards watched while tables are made: bad rows block, and no job is a guard's alone."""

import pytest
from pyspark.sql import functions as F

from lattiq.errors import EvaluationError, PanelError
from lattiq.operators.guards import Guards, watched_baselines
from lattiq.operators.rollup import RAW, entity_quarters, typed_records, unit_quarters
from lattiq.plans import runs
from lattiq.sources.sinks import cut
from tests.test_runs import series


@pytest.fixture
def case(spark, tmp_path):
    rows, _, config = series(tmp_path)
    panel = entity_quarters(unit_quarters(typed_records(spark.createDataFrame([tuple(map(str, r)) for r in rows], list(RAW)))))
    return panel.where("quarter <= date'2021-01-01'").persist(), config


def test_development_tables_run_no_guard_only_job(case, monkeypatch):
    panel, config = case
    from pyspark.sql.classic.dataframe import DataFrame

    asked = []
    for name in ("collect", "first", "count", "isEmpty", "toPandas", "take", "head"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=getattr(DataFrame, name), n=name: asked.append(n) or f(self, *a))
    tables = runs.development_tables(panel, config)
    assert asked == []
    assert tables["forecasts"].where("horizon = 4").count() == 2 * 2 * 6


@pytest.mark.parametrize(("change", "error", "message"), [
    (lambda d: d.unionByName(d.where("entity = 'AA'").limit(1)), PanelError, "repeated"),
    (lambda d: d.withColumn("value", F.when(F.col("period") == "2019Q1", -1.0).otherwise(F.col("value"))), PanelError, "negative"),
    (lambda d: d.withColumn("period", F.when(F.col("period") == "2019Q1", "2019Q2").otherwise(F.col("period"))), PanelError, "labels"),
    (lambda d: d.withColumn("quarter", F.when(F.col("period") == "2019Q1", F.date_add("quarter", 1)).otherwise(F.col("quarter"))), PanelError, "dates"),
    (lambda d: d.withColumn("quarter", F.when(F.col("period") == "2019Q1", F.lit(None).cast("date")).otherwise(F.col("quarter"))), PanelError, "dates"),
    (lambda d: d.unionByName(d.where("period = '2020Q4'").withColumns({"period": F.lit("2022Q1"), "quarter": F.lit("2022-01-01").cast("date")})), EvaluationError, "after"),
])
def test_a_bad_row_blocks(case, change, error, message):
    panel, config = case
    with pytest.raises(error, match=message):
        runs.development_tables(change(panel), config)


def test_baselines_that_break_their_rules(case):
    panel, config = case
    f = runs.development_tables(panel, config)["forecasts"].persist()
    at = (F.col("entity") == "AA") & (F.col("horizon") == 4) & (F.col("model") == "persistence")
    broken = {
        "disagree": f.withColumn("forecast", F.when(at, F.col("forecast") + 1).otherwise(F.col("forecast"))),
        "missing": f.withColumn("prediction_available", ~at), "after their origin": f.withColumn("source_date", F.when(at, F.col("target_date")).otherwise(F.col("source_date"))),
    }
    for message, d in broken.items():
        guards = Guards()
        cut(watched_baselines(d, guards, equal_at=4))
        with pytest.raises(PanelError, match=message):
            guards.settle()
    guards = Guards()
    cut(watched_baselines(f.limit(0), guards, equal_at=4))
    guards.settle()
