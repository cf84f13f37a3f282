"""Seeded suspensions: a fork of the saved state equals a full replay with the same suspension."""

import numpy as np
import pandas as pd
import pytest

from paneltide.operators import ledger as lg, strategies as st

FOUNDERS = {"A": "x", "B": "x", "C": "y", "D": None, "E": "z"}


def market(seed=1, days=160):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 0.02, (days, 5))
    r[60:75] -= 0.02  # a fall that forces the exposure down between two scheduled decisions
    prices = np.exp(r.cumsum(0))
    score = rng.normal(size=(days, 5))
    rows = [(i, c, prices[i, k], score[i, k], 0.0003, 0.1, 1, 2) for i in range(days) for k, c in enumerate("ABCDE")]
    return pd.DataFrame(rows, columns=["i", "code", "price", "score", "cash", "tax_rate", "buy_lag", "sell_lag"])


@pytest.mark.parametrize("make", [lambda: lg.top_n(2), lambda: st.momentum_hrp(3, 20, refresh=2, smooth=0.5)], ids=["top", "stateful"])
def test_fork_equals_full_replay(make):
    rows, rules = market(), lg.Rules(every=8, haircut=0.3, warm_up=21)
    known = {c: f for c, f in FOUNDERS.items() if f}
    got = lg.suspensions(rows, make(), rules, known, 6, 40)
    base = got[got["seed"] == -1].drop(columns=["seed", "founder", "funds", "first"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(base, lg.replay(rows, make(), rules))
    assert base["events"].str.contains("drawdown").any()
    seeds = sorted(set(got["seed"]) - {-1})
    assert len(seeds) >= 4
    for seed in seeds:
        part = got[got["seed"] == seed].reset_index(drop=True)
        founder, first = part["founder"][0], part["first"][0]
        group = [c for c in "ABCDE" if (FOUNDERS[c] or c) == founder]
        assert part["funds"][0] == len(group)
        marked = rows.assign(suspended=rows["code"].isin(group) & rows["i"].between(first, first + 39))
        full = lg.replay(marked, make(), rules)
        pd.testing.assert_frame_equal(part[full.columns], full)
        before = part["i"] < first
        assert (part["equity"] == base["equity"])[before].all() and (part["stressed"] == part["equity"])[before].all()
        assert (part["stressed"] <= part["equity"] + 1e-9).all()
    assert any((got["stressed"] < got["equity"] - 1e-6) & (got["seed"] >= 0))


def test_runs_and_seeds_by_spark(spark):
    rows = market(2, 90).assign(founder=lambda x: x["code"].map(FOUNDERS)).drop(columns="tax_rate")
    panel = spark.createDataFrame(rows)
    runs = spark.createDataFrame([("a", "top", 2, 8, 10, 0.1, 0.3), ("b", "cash", 0, 8, 10, 0.1, 0.3)], "run_id string, strategy string, n int, every int, start bigint, tax double, haircut double")
    got = lg.run_suspended(panel, runs, 3, 20).toPandas()
    a, b = got[got["run_id"] == "a"], got[got["run_id"] == "b"]
    assert set(a["seed"]) <= {-1, 0, 1, 2} and len(set(a["seed"])) > 2
    assert set(b["seed"]) == {-1}  # no fund held: nothing to suspend
    whole = lg.run_all(panel.drop("founder"), runs).toPandas().sort_values(["run_id", "i"])
    mine = got[got["seed"] == -1].sort_values(["run_id", "i"])
    assert np.allclose(mine["equity"], whole["equity"])


def test_no_decisions_and_no_rows_after_the_start():
    got = lg.suspensions(market(3, 12), lg.top_n(2), lg.Rules(every=8, warm_up=50), {}, 3, 5)
    assert set(got["seed"]) == {-1} and len(got) == 12
