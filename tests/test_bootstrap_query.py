"""The registered bootstrap: 2,000 replications on the forecasts of the selected penalty."""

import os

import pytest

from lattiq.operators.final import MAPPING
from lattiq.plans.queries import _alpha, _baseline, _candidates, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_bootstrap_takes_the_selected_penalty(spark):
    got = {r.horizon: r for r in queries()["bootstrap_skill"](spark, SF).collect()}
    assert {r.replications for r in got.values()} == {2000}
    f = _candidates(spark, SF)["forecasts"].persist()
    alpha = [r.alpha for r in _alpha(spark, SF, f).where("selected").collect()]
    assert len(alpha) == 1
    base = {(r.entity, r.origin_date, r.horizon): r.forecast for r in _baseline(spark, SF).collect() if r.model == MAPPING[r.horizon]}
    sums = {}
    for r in f.where(f["alpha"] == alpha[0]).collect():
        b = base[r.entity, r.origin_date, r.horizon]
        if None not in (r.actual, r.forecast, b):
            s = sums.setdefault(r.horizon, [0.0, 0.0])
            s[0] += abs(r.forecast - r.actual)
            s[1] += abs(b - r.actual)
    assert sums
    for h, (a, b) in sums.items():
        assert abs(got[h].point_skill - (1 - a / b)) < 1e-5
