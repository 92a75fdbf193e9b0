"""The drill-down stays above the rollup, and the largest contributors need no whole group in one task."""

import datetime as dt
import re

from lattiq.operators import panel as P
from lattiq.operators.rollup import RAW, typed_records, unit_quarters

ROWS = "entity string, period string, unit_id string, value double"


def record(unit, entity, quarter, value):
    return (f'"{unit}"', "Unit", f" {entity}", "s", "2020", quarter, "1", "2", value, "C")


def test_drilldown_joins_rolled_up_units(spark):
    raw = [record("u", "aa", "1", "1"), record("u", "aa", "1", "2"), record("v", "aa", "1", ""), record("u", "aa", "2", "4"), record("w", "bb", "1", "8"), record("w", "", "1", "9"), record("w", "bb", "7", "16")]
    units = unit_quarters(typed_records(spark.createDataFrame(raw, RAW)))
    first, second = dt.date(2020, 1, 1), dt.date(2020, 4, 1)
    flags = [("AA", first, True), ("AA", first, True), ("AA", second, False), ("BB", second, True), (None, first, True), ("BB", None, True)]
    d = P.drilldown(spark.createDataFrame(flags, "entity string, quarter date, outlier boolean"), units)
    assert sorted(d.columns) == sorted(units.columns)
    assert sorted((r.unit_id, r.entity, r.quarter, r.value, r.source_rows) for r in d.collect()) == [("u", "AA", first, 3.0, 2), ("v", "AA", first, None, 1)]
    s = P.drilldown_summary(d).first()
    assert (s.entity, s.period, s.unit_rows, s.observed_units, s.value, s.largest) == ("AA", "2020Q1", 2, 1, 3.0, 3.0)
    # below the rollup, the join or its conditions would parse the records' text again and again
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join Inner") < plan.find("Aggregate [unit_id") and "LeftSemi" not in plan


def test_drilldown_sums_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("AA", "2020Q1", str(i), 0.1) for i in range(10)] + [("AA", "2020Q2", "a", None)], ROWS).coalesce(1)  # ten times 0.1 are 0.9999999999999999 in doubles
    assert {r.period: r.value for r in P.drilldown_summary(rows).collect()} == {"2020Q1": 1.0, "2020Q2": None}


def test_top_contributors_limits_each_task(spark):
    rows = [("AA", "2020Q1", u, v) for u, v in (("d", 1.0), ("c", 2.0), ("b", 2.0), ("a", 2.0), ("e", 3.0), ("f", None))]
    rows += [("BB", "2020Q1", "a", 0.0), ("BB", "2020Q2", "a", None), (None, "2020Q1", "a", 4.0), (None, "2020Q1", "b", 12.0), ("CC", None, "a", 5.0)]
    d = P.top_contributors(spark.createDataFrame(rows, ROWS))
    assert d.columns == ["entity", "period", "unit_id", "value", "share", "rank"]
    assert sorted(map(tuple, d.collect()), key=lambda r: (str(r[0]), r[5])) == [
        ("AA", "2020Q1", "e", 3.0, 0.3, 1), ("AA", "2020Q1", "a", 2.0, 0.2, 2), ("AA", "2020Q1", "b", 2.0, 0.2, 3), ("BB", "2020Q1", "a", 0.0, None, 1),
        ("CC", None, "a", 5.0, 1.0, 1), (None, "2020Q1", "b", 12.0, 0.75, 1), (None, "2020Q1", "a", 4.0, 0.25, 2)]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(entity[^\n]*\n[^\n]*WindowGroupLimit [^\n]*Partial", plan)
    assert not re.search(r"Window \[[^\n]*sum\(", plan)
