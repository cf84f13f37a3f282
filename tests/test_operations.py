"""Incremental builds, step control and paper trading."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from paneltide.functions import calendars
from paneltide.operators import paper, relational as rel
from paneltide.operators.ledger import Ledger
from paneltide.plans import incremental as inc

D = inc.Derived("feat", ["code", "d"], "d", ["y"], overlap=3)


def source(spark, days, bump=None):
    rows = [(c, date(2026, 1, 1 + i), float(i + (5 if (c, i) == bump else 0))) for c in "AB" for i in range(days)]
    return spark.createDataFrame(rows, "code string, d date, v double")


def compute(src):
    last = src.agg(F.max("d")).first()[0]
    full = src.withColumn("y", F.when(F.datediff(F.lit(last), "d") >= 2, F.col("v") * 2))
    return lambda cutoff: full if cutoff is None else full.filter(F.col("d") >= F.lit(cutoff))


def run(spark, root, src):
    return inc.build(spark, str(root), D, calendars.trading_calendar(src), compute(src), src.agg(F.max("d")).first()[0])


def test_incremental_equals_full(spark, tmp_path):
    assert run(spark, tmp_path, source(spark, 8)) == "full"
    assert run(spark, tmp_path, source(spark, 8)) == "unchanged"
    assert run(spark, tmp_path, source(spark, 11)) == "appended"
    assert rel.differences(inc.read(spark, str(tmp_path), D), compute(source(spark, 11))(None)).count() == 0


def test_restated_history_fails_closed(spark, tmp_path):
    run(spark, tmp_path, source(spark, 8))
    before = inc.read(spark, str(tmp_path), D).collect()
    with pytest.raises(inc.PrefixChanged):
        run(spark, tmp_path, source(spark, 9, bump=("A", 6)))
    with pytest.raises(inc.StaleInput):
        run(spark, tmp_path, source(spark, 5))
    assert sorted(inc.read(spark, str(tmp_path), D).collect()) == sorted(before)


def test_guard_and_steps(spark):
    cal = calendars.business_days(spark, date(2026, 1, 1), date(2026, 1, 9))
    with pytest.raises(ValueError, match="2026-01-03"):
        inc.business_day_guard(source(spark, 3), cal)

    def fail():
        raise RuntimeError("no")

    status, out = inc.run_steps([("a", [], lambda: None), ("b", [], fail), ("c", ["b"], lambda: None), ("d", ["a"], lambda: "partial")])
    assert status == "failed" and [out[k]["status"] for k in "abcd"] == ["ok", "failed", "skipped", "partial"]


def test_propose_fill_reconcile(spark):
    book = Ledger(100.0)
    prices, founders = {"A": 10.0, "B": 20.0, "C": 5.0}, {"A": "x", "B": "y", "C": None}
    made, skipped = paper.orders(book, {"A": 0.25, "B": 0.25, "C": 0.2}, prices, 0, founders)
    assert [(o.fund_code, o.side, round(o.value, 9)) for o in made] == [("A", "buy", 25), ("B", "buy", 25)] and not skipped
    p, new = paper.propose([], date(2026, 1, 5), made, datetime(2026, 1, 5, 9), ["A"])
    assert new and p["proposal_id"] == "20260105-01" and paper.propose([p], date(2026, 1, 5), [], datetime(2026, 1, 5), [])[1] is False
    meta = {c: {"can_buy": True, "can_sell": True, "buy_lag": 1} for c in "AB"}
    with pytest.raises(ValueError):
        paper.fill(book, p, prices, meta, 1, date(2026, 1, 5))
    done, results = paper.fill(book, p, prices, meta, 1, date(2026, 1, 6))
    assert [r["outcome"] for r in results] == ["filled", "filled"] and paper.fill(book, done, prices, meta, 2, date(2026, 1, 7))[1] == []
    again = paper.load(*paper.save(spark, book))
    assert again.value(prices) == pytest.approx(100) and again.sellable("A", 1) == 0 and again.sellable("A", 2) == pytest.approx(2.5)
    assert paper.identity(again, prices, 100.0)["identity_ok"]
    _, skipped = paper.orders(again, {"B": 0.25}, prices, 5, founders, bought={"A": 1, "B": 1})
    assert skipped == {"A": "min_hold"}


def test_ingest_modes_and_carry_forward(spark, tmp_path):
    from paneltide.sources import ingest as ing
    from paneltide.sources.store import Store

    s = Store(spark, str(tmp_path), read_only=False)
    first = ing.ingest(s, ing.Synthetic(4, 10), datetime(2026, 2, 3, 20), "initial")
    assert first["status"] == "ok" and s.table("fund_nav").count() == 40
    second = ing.ingest(s, ing.Synthetic(4, 12, fail={"S01"}), datetime(2026, 2, 4, 20))
    assert second["status"] == "partial" and second["failed_profiles"] == ["S01"]
    assert s.table("fund_nav").count() == 48
    today = {r.fund_code: r for r in s.table("fund_master").filter("snapshot_date = DATE '2026-02-04'").collect()}
    assert len(today) == 4 and today["S01"].info_fetched is False and today["S01"].last_success_at == datetime(2026, 2, 3, 20) and today["S00"].info_fetched
    assert today["S00"].founder == "Kurucu0 Portföy" and today["S00"].can_buy
    assert [r.status for r in s.table("runs").orderBy("started_at").collect()] == ["ok", "partial"]
    assert ing.wanted(["a", "b"], "incremental", {"b"}, 2) == ["a"] and ing.wanted(["a", "b"], "incremental", {"b"}, 0) == ["a", "b"]


def test_change_plan(spark):
    from paneltide.operators import change_plan as cp

    empty = spark.createDataFrame([], cp.PLAN)
    sel = spark.createDataFrame([("A", 0.01, 0.1, 0.2), ("B", 0.02, 0.1, 0.2)], "fund_code string, p_value double, lower double, q50 double")
    one = cp.make(empty, sel, {"A": "x", "B": None}, date(2026, 3, 2))
    assert {r.fund_code: round(r.target_weight, 9) for r in one.collect()} == {"A": 0.25, "CASH": 0.75}
    assert cp.make(one, sel, {"A": "x"}, date(2026, 3, 20)).count() == 2
    assert cp.next_change(one, 2026) == "2026-02" and cp.next_change(one, 2026, 1) is None


def test_suite(spark):
    import numpy as np

    from paneltide.plans import suites

    rng = np.random.default_rng(0)
    panel = spark.createDataFrame([(f"F{c}", i, float(10 * np.exp(0.001 * c * i + rng.normal(0, 0.01))), 0.0002, float(c)) for c in range(4) for i in range(60)], "code string, i bigint, price double, cash double, score double")
    runs = suites.runs_table(spark, [("top", 1), ("top", 2)], [5], [0], [0.0, 0.2])
    text = suites.report(panel, runs, "Suite")
    assert text.count("top1") == 2 and "| pbo |" in text
    assert suites.friction(panel, runs.filter("tax > 0")).filter("drag < 0").count() == 0


def test_shadow_snapshot_isolates_errors_and_repeats(spark):
    import numpy as np

    from paneltide.operators import ledger as lg, strategies as st

    rng = np.random.default_rng(3)
    panel = spark.createDataFrame(
        [(f"F{c}", i, float(10 * np.exp(0.002 * c * i + rng.normal(0, 0.01))), 0.0002, 0.01 * (c - 1), c > 0, False, float(c), f"x{c}") for c in range(4) for i in range(40)],
        "code string, i bigint, price double, cash double, lower double, selected_q20 boolean, stop boolean, score double, founder string",
    )

    def broken(view):
        raise RuntimeError("no data")

    makers = {"conformal": lambda run: st.conformal_hrp(3, 20), "fdr": lambda run: st.selected_hrp(3, 20), "broken": lambda run: broken}
    runs = spark.createDataFrame([(k, k, 3, 5, 0, 0.1, 0.0) for k in [*makers, "cash"]], "run_id string, strategy string, n int, every int, start bigint, tax double, haircut double")
    out = lg.run_isolated(panel, runs, makers)
    days = spark.createDataFrame([(i, date(2026, 1, 1 + i % 28)) for i in range(40)], "i bigint, d date")
    status, equity = paper.shadow_snapshot(out, days, date(2026, 3, 2))
    got = {r.portfolio: (r.status, r.error, r.n_rows) for r in status.collect()}
    assert got["broken"] == ("failed", "RuntimeError: no data", 0) and got["cash"] == got["fdr"] == ("ok", None, 40)
    assert paper.overall(status) == "partial" and {r.portfolio for r in equity.collect()} == {"conformal", "fdr", "cash"}
    last = {r.portfolio: r.equity for r in equity.collect()}
    # Lower ends of F0 and F1 are not positive: the conformal run holds F2 and F3 alone, each capped.
    assert last["conformal"] > last["cash"] and last["fdr"] > last["cash"] and last["conformal"] != last["fdr"]
    once = paper.store_shadows((status.limit(0), equity.limit(0)), (status, equity))
    twice = paper.store_shadows(once, (status, equity))
    assert [sorted(map(str, a.collect())) for a in once] == [sorted(map(str, b.collect())) for b in twice]


def test_conformal_ranks_and_stop():
    import numpy as np
    import pandas as pd

    from paneltide.operators import ledger as lg, strategies as st

    rng = np.random.default_rng(1)
    prices = pd.DataFrame(np.exp(rng.normal(0, 0.01, (60, 4)).cumsum(0)), columns=list("ABCD"))
    known = pd.DataFrame({"code": list("ABCD"), "lower": [0.02, -0.01, 0.01, np.nan], "score": [1.0, 2.0, 3.0, 4.0], "stop": False, "selected_q20": [False, True, False, None], "founder": list("wxyz"), "tax": [0.9, 0.0, 0.0, 0.0], "calm": 0.35})
    held = lambda strategy, k=known: set(strategy(lg.View(k, prices, {}))[0])
    assert held(st.conformal_hrp(2, 50)) == {"A", "C"} and held(st.conformal_hrp(1, 50)) == {"A"}
    assert held(st.conformal_hrp(1, 50, taxed="tax")) == {"C"}
    assert held(st.conformal_hrp(2, 50), known.assign(stop=True)) == {"C", "D"}
    assert held(st.selected_hrp(3, 50)) == {"B"} and held(st.selected_hrp(3, 50), known.assign(selected_q20=False)) == set()
    assert held(st.conformal_hrp(2, 50), known.assign(lower=-1.0)) == set()
    assert st.gated(st.conformal_hrp(2, 50), "calm")(lg.View(known, prices, {}))[1] == 0.35


def test_selected_weights():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    prices = pd.DataFrame(np.exp(rng.normal(0, 0.01, (80, 5)).cumsum(0)), columns=list("ABCDE"))
    sel = pd.DataFrame({"code": list("ABCDX"), "lower": [0.1, 0.2, 0.3, 0.4, 0.5], "selected": [True, True, True, None, True]})
    founders = pd.Series({"A": "p", "B": "p", "C": "q", "D": "q"})
    w = paper.selected_weights(sel, prices, founders)
    assert set(w.index) == {"A", "B", "C", paper.SLOT} and w.sum() == pytest.approx(1) and w.drop(paper.SLOT).sum() == pytest.approx(0.30)
    assert paper.selected_weights(sel, prices, founders, drawdown=0.2, fallen=0.1)[paper.SLOT] == pytest.approx(0.9)
    assert set(paper.selected_weights(sel, prices, founders, per_founder=1).index) == {"B", "C", paper.SLOT}
    for none in (sel.assign(selected=False), sel[sel.code == "X"], sel.iloc[:0]):
        assert paper.selected_weights(none, prices, founders).to_dict() == {paper.SLOT: 1.0}


def test_proxy_basket_and_reports(spark):
    from paneltide.operators import ops, universe as un

    rows = [
        ("A", "Para Piyasası Şemsiye Fonu", "Bir", "t1", 1.0, 1.0, "İşlem Görüyor", datetime(2026, 10, 1, 8), date(2026, 10, 1), "YAT", "Emeklilik Katkı", "c"),
        ("B", "PARA PİYASASI", "İki", None, 1.0, 1.0, "İşlem Görüyor", datetime(2026, 9, 1, 8), date(2026, 10, 1), "EMK", "Devlet Katkısı", "c"),
        ("C", "Para Piyasası", "  ", "t1", 1.0, 1.0, "İşlem Görüyor", datetime(2026, 10, 1, 8), date(2026, 10, 1), "EMK", "x", None),
        ("D", "Para Piyasası", "Üç", "t2", 1.0, 1.0, "İşlem Görüyor", datetime(2026, 10, 1, 8), date(2026, 10, 1), None, None, None),
        ("E", "Para Piyasası", "Kara Liste", "t1", 1.0, 1.0, "İşlem Görüyor", datetime(2026, 10, 1, 8), date(2026, 10, 1), "emk", None, "DEVLET KATKISI"),
        ("F", "Para Piyasası", "Dört", "t1", 0.5, 1.0, "İşlem Görüyor", datetime(2026, 10, 1, 8), date(2026, 10, 1), "YAT", "devlet katkısı", "c"),
        ("G", "Hisse", "Beş", "t1", 1.0, 1.0, "İşlem Görüyor", datetime(2026, 10, 1, 8), date(2026, 10, 1), "YAT", "y", "c"),
    ]
    m = spark.createDataFrame(rows, "fund_code string, umbrella_type string, founder string, tax_category string, buy_valor double, sell_valor double, tefas_status string, last_success_at timestamp_ntz, snapshot_date date, fund_class string, name string, category string")
    cov = spark.createDataFrame([(c, 1.0 if c != "F" else 0.995, 100 + (c == "F")) for c in "ABCDEFG"], "fund_code string, share double, n_nav int")
    ranks = lambda df: [x.fund_code for x in df.orderBy("rank").collect()]
    assert ranks(un.proxy_basket(m, cov, "Para Piyasası", ("kara",))) == ["F", "A", "B"]
    now = {"asof": F.lit(datetime(2026, 10, 2, 9, 15)).cast("timestamp_ntz")}
    assert ranks(un.proxy_basket(m, cov, "Para Piyasası", ("kara",), **now)) == ["A"]
    assert ranks(un.proxy_basket(m, cov, "Para Piyasası", ("kara",), first_day="2026-10-02", **now)) == []
    assert sorted(x.fund_code for x in un.state_excluded(m, ("devlet katkısı",)).collect()) == ["B", "E"]
    assert un.state_excluded(m, ()).count() == 0
    eq = spark.createDataFrame([("base", date(2026, 1, d), 100.0) for d in (1, 2, 3, 5)] + [("p", date(2026, 1, d), 100.0 + d) for d in (1, 3, 4, 5)] + [("q", date(2026, 1, 4), 9.0)], "portfolio string, d date, equity double")
    [x] = ops.weekly_excess(eq, "base", F.lit(date(2026, 1, 2))).collect()
    assert (x.portfolio, x.n, x.latest) == ("p", 2, 105.0) and x.ret == pytest.approx(x.excess)
    [x] = ops.trailing_basket(spark.createDataFrame([(i, 0.01) for i in range(30)], "i int, r double")).collect()
    assert x.ret_63 is None and x.ret_21 == pytest.approx(0.20895693)


def test_named_suites(spark):
    import numpy as np

    from paneltide.plans import suites

    rng = np.random.default_rng(4)
    rows = [(f"F{c}", i, float(10 * np.exp(0.002 * c * i + rng.normal(0, 0.01))), 0.0002, 0.01 * (c - 1), c > 0, float(c), f"x{c}", 0.35) for c in range(4) for i in range(40)]
    panel = spark.createDataFrame(rows, "code string, i bigint, price double, cash double, lower double, selected_q20 boolean, score double, founder string, spread double")
    out = suites.run_suite(panel, "baseline", 3, 5, 20, also=("selected_q20", "momentum_hrp@spread", "nosuch")).toPandas()
    failed = out[out.events.str.startswith("failed")]
    assert list(failed.run_id) == ["nosuch"] and "ValueError" in failed.events.iloc[0] and len(out) == 5 * 40 + 1
    cash = out[out.i == 30].set_index("run_id")["cash"]
    assert cash["momentum_hrp"] < cash["momentum_hrp@spread"] < cash["cash"]
    with pytest.raises(KeyError):
        suites.run_suite(panel, "other")


def test_tracking_catalog_and_weekly_report(spark, tmp_path):
    from paneltide.plans import reports
    from paneltide.sources import tracking as tr
    from paneltide.sources.store import Store

    assert tr.config_hash({"a": 1, "b": date(2026, 1, 1)}) == tr.config_hash({"b": date(2026, 1, 1), "a": 1}) != tr.config_hash({"a": 2})
    assert tr.revision(str(tmp_path)) == "nogit"
    path = str(tmp_path / "log")
    assert tr.log_runs(spark, path, [{"strategy": "s", "cagr": 0.5, "vol": float("nan"), "note": "x" * 300, "none": None}], {}, "e", "2026-01-01", str(tmp_path))
    [x] = tr.read_log(spark, path).collect()
    assert x.run == "s" and x.metrics == {"cagr": 0.5} and len(x.params["note"]) == 200 and x.tags["data_asof"] == "2026-01-01"
    (tmp_path / "file").write_text("")
    assert not tr.log_runs(spark, str(tmp_path / "file" / "log"), [{}], {}, "e")
    got = Store(spark, str(tmp_path / "store"), read_only=False).catalog()
    assert {r.table for r in got.collect()} == {"fund_master", "fund_nav", "macro", "runs"}
    assert got.groupBy("table", "position").count().filter("count > 1").count() == 0

    assert reports.gate([True, None], 40) is reports.gate([True], 27) is reports.gate([True], None) is None
    assert reports.gate([True, True], 28) is True and reports.gate([True, False], 28) is False
    excess = spark.createDataFrame([("b<1>", 5, 0.02, 0.01, 103.0), ("a", 5, -0.01, -0.02, 99.0)], "portfolio string, n int, ret double, excess double, latest double")
    text, message = reports.weekly(date(2026, 3, 2), excess, {"episodes": 3, "rate": 0.75, "ready": True}, None, 4, {"status": "ok", "n": 5, "difference": 0.004})
    assert text.index("| a | -1.00 | -2.00 | 99.00 |") < text.index("| b<1> | 2.00 | +1.00 | 103.00 |") and "+0.40 pp over 5 days (met)" in text
    assert "real capital" in text and "operations gate: no data" in text and "b&lt;1&gt;" in message
    text, _ = reports.weekly(date(2026, 3, 2), excess.limit(0), None, False, 0, None)
    assert "not assessed (no data)" in text and "gate: not met" in text and "real capital" not in text
