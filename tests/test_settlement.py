"""Settlement stress in closed form against a ledger moved day by day, and each reason why a basket is not evaluable."""

from random import Random

import pytest

from paneltide.operators import settlement as se
from paneltide.operators.ledger import Ledger

PROFILE = "code string, i bigint, buy_valor double, sell_valor double, can_buy boolean, can_sell boolean, tax_category string, tax_rate double"
LAST, MID = 19, 9


def world(rng, codes):
    prices = {c: [round(rng.uniform(0.8, 1.3), 6) for _ in range(LAST + 1)] for c in codes}
    rates = [round(rng.uniform(-0.01, 0.02), 6) for _ in range(LAST + 1)]
    lags = {c: (rng.randrange(0, 3), rng.randrange(0, 4)) for c in codes}
    taxes = {c: rng.choice([0.0, 0.1, None]) for c in codes}
    return prices, rates, lags, taxes


def frames(spark, prices, rates, lags, taxes, start=0):
    p = spark.createDataFrame([(c, start + i, v) for c, vs in prices.items() for i, v in enumerate(vs)], "code string, i bigint, price double")
    f = spark.createDataFrame([(c, start + i, float(lags[c][0]), float(lags[c][1]), True, True, "A", taxes[c]) for c in prices for i in (0, MID, LAST)], PROFILE)
    k = spark.createDataFrame([(start + i, r) for i, r in enumerate(rates)], "i bigint, rate double")
    return p, f, k


def by_ledger(members, prices, rates, lags, taxes, extra, sold):
    """(ending equity, cash, under way, taxes, last settlement) of a ledger that lives every day."""
    book = Ledger(100.0)
    for c in members:
        book.buy(c, min(100.0 / len(members), book.cash), prices[c][0], 0, lags[c][0], 0.0, 0.175 if taxes[c] is None else taxes[c])
    last = sold
    for t in range(1, LAST + 1):
        got = book.settle(t)
        if t == sold:
            for c in members:
                book.sell(c, book.units(c), prices[c][t], t, lags[c][1] + extra)
            last = max(book.due, default=sold)
        if t > sold and got <= 0:
            book.accrue(rates[t], 0.175)
    return book.value({c: prices[c][LAST] for c in members}), book.cash, sum(book.due.values()), book.taxes, last


@pytest.mark.parametrize("start", [0, 40])
def test_equal_to_a_ledger_day_by_day(spark, start):
    rng = Random(start)
    codes = [f"C{k}" for k in range(14)]
    prices, rates, lags, taxes = world(rng, codes)
    lags["C13"] = (0, 30)  # never settles inside the period
    baskets = {f"b{k}": rng.sample(codes, k + 1) for k in range(6)} | {"late": ["C13"], "mixed": ["C12", "C13"]}
    b = spark.createDataFrame([(n, c) for n, cs in baskets.items() for c in cs] + [(None, "C1"), ("b0", None)], "basket string, code string")
    got = {tuple(r)[:4]: r for r in se.settlement_stress(b, *frames(spark, prices, rates, lags, taxes, start), liquidation=start + MID).collect()}
    assert len(got) == len(baskets) * 2 * 2 * 3
    for name, members in baskets.items():
        for mode, sold in ((se.FIXED, LAST), (se.REINVESTED, MID)):
            for scenario, extra in zip(se.SCENARIOS, (0, 1)):
                row = got[name, mode, scenario, "full"]
                value, cash, due, tax, last = by_ledger(members, prices, rates, lags, taxes, extra, sold)
                assert row["status"] == "ok" and row["settle_i"] == start + last
                assert [row["ending_equity"], row["settled_cash"], row["receivables"], row["taxes_paid"]] == pytest.approx([value, cash, due, tax], abs=1e-9)
                assert row["cagr"] == pytest.approx((value / 100) ** (252 / LAST) - 1) and row["identity_gap"] < 1e-9
                for period in ("select", "external"):
                    part = got[name, mode, scenario, period]
                    assert part["status"] == se.NO_ACCOUNTS and part["cagr"] is None and part["ending_equity"] == row["ending_equity"]


def test_reasons(spark):
    rng = Random(5)
    codes = ["good", "gap", "nan", "short", "twice", "mute", "half", "blank", "nobuy", "nosell", "young", "unsure"]
    prices, rates, lags, taxes = world(rng, codes)
    lags = dict.fromkeys(codes, (1, 1)) | {"young": (MID + 1, 1)}
    prices["gap"][4], prices["nan"][LAST] = None, float("nan")
    prices["short"].pop()
    p, f, k = frames(spark, prices, rates, lags, taxes)
    f = f.filter("code <> 'mute' OR i = 0").selectExpr(
        "code", "i", "if(code = 'half', 0.5, buy_valor) AS buy_valor", "sell_valor", "if(code = 'unsure' AND i = 0, NULL, code <> 'nobuy' OR i > 0) AS can_buy",
        "code <> 'nosell' OR i < 10 AS can_sell", "if(code = 'blank', ' ', tax_category) AS tax_category", "tax_rate",
    )
    b = spark.createDataFrame([(c, x) for c in codes + ["absent"] for x in {c, "good"}] + [("twice", "twice")], "basket string, code string")
    got = {(r["basket"], r["mode"]): (r["status"].replace("not evaluable: ", ""), r["ending_equity"]) for r in se.settlement_stress(b, p, f, k, liquidation=MID).filter("period = 'full' AND scenario = 'base'").collect()}
    why = lambda c, mode=se.FIXED: got[c, mode][0]
    assert why("good") == "ok" and why("twice") == "member listed twice"
    assert {why(c) for c in ("gap", "nan", "short", "absent")} == {"prices incomplete"}
    assert why("mute") == "no whole profile on the day of sale" == why("mute", se.REINVESTED)
    assert {why(c) for c in ("half", "blank", "unsure")} == {"no whole profile on the first day"}
    assert why("nobuy") == "closed for purchase on the first day"
    assert why("nosell") == "closed for sale on the day of sale" and why("nosell", se.REINVESTED) == "ok"
    assert why("young") == "ok" and why("young", se.REINVESTED) == "lots not yet to be sold"
    assert all((value is None) == (status != "ok") for status, value in got.values())
    odd = k.selectExpr("i", "if(i = 12, -1.5, rate) AS rate")
    odd = {r["mode"]: r["status"] for r in se.settlement_stress(b.filter("basket = 'good'"), p, f, odd, liquidation=MID).filter("period = 'full'").collect()}
    assert odd == {se.FIXED: "ok", se.REINVESTED: "not evaluable: cash returns incomplete"}
    assert se.settlement_stress(b.limit(0), p, f, k, liquidation=MID).count() == 0
    assert se.settlement_stress(b, p.limit(0), f, k, liquidation=MID).filter("status = 'ok'").count() == 0
    for day in (0, LAST, 99):
        assert se.settlement_stress(b, p, f, k, liquidation=day).filter(f"mode = '{se.REINVESTED}' AND status = 'ok'").count() == 0


def test_source_stale_of_every_moment_equals_a_replay(spark):
    from datetime import date, datetime, timedelta

    from paneltide.functions import calendars
    from paneltide.operators import quality

    rng, first = Random(3), date(2026, 1, 1)
    days = [first + timedelta(days=k) for k in range(60)]
    holidays = [date(2026, 1, 1), date(2026, 2, 4)]
    busy = [d for d in days if d.weekday() < 5 and d not in holidays]
    prices = [(f"F{k}", d, rng.choice([1.0, 1.0, 1.0, None, float("nan")])) for k in range(6) for d in days[3 + 4 * k :] if rng.random() < (0.9 if d.day % 9 > 3 else 0.2)]
    prices += prices[:20] + [(None, days[50], 1.0), ("F1", None, 1.0)]
    taken = [days[9], days[20], None]
    asked = [datetime.combine(d, datetime.min.time()) + timedelta(hours=rng.choice([0, 9, 10, 23])) for d in days] + [None]
    a = spark.createDataFrame([(x,) for x in asked], "at timestamp_ntz")
    p = spark.createDataFrame(prices, "code string, d date, price double")
    s = spark.createDataFrame([(x,) for x in taken], "snapshot_date date")
    cal = calendars.business_days(spark, days[0], days[-1], holidays)
    got = {r["at"]: r for r in quality.source_stale(a, p, s, cal, 2, 0.7).collect()}
    assert len(got) == 60
    good = {(c, d) for c, d, v in prices if c and d and v == v and v is not None}
    between = lambda x, y: sum(x <= d < y for d in busy)
    reasons = set()
    for at in asked[:-1]:
        r, day = got[at], at.date()
        due = [d for d in busy if d < day or (d == day and at.hour >= 10)]
        last = {c: max(d for x, d in good if x == c and d <= day) for c in {c for c, d in good if d <= day}}
        newest = max(last.values(), default=None)
        behind = between(newest, due[-1]) - between(due[-1], newest) if newest and due else None
        ratio = sum(between(d, newest) <= 0 for d in last.values()) / len(last) if last else None
        reason = "no_snapshot" if not any(t and t <= day for t in taken) else "no_price" if not newest else "behind" if behind is None or behind >= 2 else "few_fresh" if ratio < 0.7 else "ok"
        reasons.add(reason)
        assert (r["expected"], r["newest"], r["behind"], r["reason"], r["stale"]) == (due[-1] if due else None, newest, behind, reason, reason != "ok")
        assert r["fresh_ratio"] == (pytest.approx(ratio) if last else None)
    assert {"no_snapshot", "few_fresh", "ok"} <= reasons
    none = quality.source_stale(a, p.limit(0), s, cal).collect()
    assert len(none) == 60 and {r["reason"] for r in none} == {"no_snapshot", "no_price"}
    assert quality.source_stale(a.limit(0), p, s, cal).count() == 0


def test_withholding_classes(spark):
    from paneltide.operators.execution import withholding_classes

    rows = [(1, "HİSSE fon", None), (2, None, "x IRAQ"), (3, "", ""), (4, "tahvil", "kısa"), (5, "tahvil", "uzun")]
    f = spark.createDataFrame(rows, "k int, category string, name string").selectExpr("*", "DATE '2026-01-05' AS day", "1 AS rate")
    rules = [("equity", ["hisse"], []), ("abroad", [], ["ıraq"]), ("short", ["tahvil"], ["KISA"])]
    schedule = [("2026-02-01", {"default": 0.9}), ("2026-01-01", {"equity": 0.0, "default": 0.1})]
    got = {r["k"]: (r["tax_category"], r["withholding_rate"]) for r in withholding_classes(f, rules, schedule, "day").collect()}
    assert got == {1: ("equity", 0.0), 2: ("abroad", 0.1), 3: (None, None), 4: ("short", 0.1), 5: (None, None)}
    assert {tuple(r)[-2:] for r in withholding_classes(f, None, schedule, "day").collect()} == {(None, None)}
    assert {r["withholding_rate"] for r in withholding_classes(f, rules, schedule[:1], "day").collect()} == {None}
