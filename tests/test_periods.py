"""Metrics by period and shares of costs against plain arithmetic."""

from datetime import date, timedelta

import numpy as np
import pytest

from paneltide.operators import robustness as rb


def test_each_period_by_itself(spark):
    rng = np.random.default_rng(4)
    days = [date(2026, 1, 1) + timedelta(days=k) for k in range(60)]
    paths = {k: 100 * np.exp(rng.normal(0, 0.02, 60).cumsum()) for k in ("a", "b")}
    e = spark.createDataFrame([(k, i, d, float(v[i]), 1.0) for k, v in paths.items() for i, d in enumerate(days)] + [("c", 0, days[50], 1.0, 1.0)], "run_id string, i bigint, d date, equity double, cash_level double")
    spans = {"early": (None, days[29]), "late": (days[30], None), "all": (None, None), "never": (date(2030, 1, 1), None)}
    p = spark.createDataFrame([(k, *v) for k, v in spans.items()], "period string, first date, last date")
    got = {(r["period"], r["run_id"]): r for r in rb.by_period(e, p).collect()}
    assert set(got) == {(p, k) for p in ("early", "late", "all") for k in "ab"} | {("late", "c"), ("all", "c")}
    for name, part in (("early", slice(0, 30)), ("late", slice(30, 60)), ("all", slice(0, 60))):
        for k, path in paths.items():
            v, row = path[part], got[name, k]
            steps = np.diff(np.log(v))
            assert row["n"] == len(steps) and row["mdd"] == pytest.approx((1 - v / np.maximum.accumulate(v)).max())
            assert row["cagr"] == pytest.approx((v[-1] / v[0]) ** (252 / len(steps)) - 1) and row["vol"] == pytest.approx(steps.std(ddof=1) * 252**0.5)
    assert got["late", "c"]["n"] == 0 and got["late", "c"]["vol"] is None


def test_cost_shares(spark):
    e = spark.createDataFrame([("a", i, v) for i, v in enumerate([100.0, 110.0, 125.0])] + [("one", 0, 50.0), ("idle", 0, 1.0), ("idle", 1, 2.0), ("broke", 0, 1.0), ("broke", 1, 0.0)], "run_id string, i bigint, equity double")
    f = spark.createDataFrame([("a", 100.0, 2.0, 1.0), ("a", 26.0, 3.0, None), ("one", 5.0, 1.0, 0.0), ("broke", 1.0, 1.0, 1.0), ("x", 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "run_id string, gross double, tax double, fee double")
    got = {r[0]: tuple(r)[1:] for r in rb.cost_shares(e, f).collect()}
    assert got["a"] == pytest.approx((126 * 126, 0.04, 0.008)) and got["idle"] == (0.0, 0.0, 0.0)
    assert got["one"] == (None, 0.02, 0.0) and got["broke"] == (252.0, None, None) and set(got) == {"a", "one", "idle", "broke"}
