"""The live basket against a day-by-day replay, and the parts of a coverage gap against plain arithmetic."""

from datetime import date, datetime, timedelta
from random import Random

import numpy as np
import pandas as pd
import pytest

from paneltide.operators import attribution as at, live_basket as lb

MASTER = "fund_code string, snapshot_date date, source_published_at timestamp_ntz, umbrella_type string, name string, founder string, tax_category string, tefas_status string, buy_valor double, sell_valor double, last_success_at timestamp_ntz"
DAYS = [date(2026, 1, 1) + timedelta(days=3 * k) for k in range(20)]


def snapshots(rng, founders):
    out = []
    for k in range(12):
        for day in sorted(rng.sample(DAYS, 5)):
            published = rng.choice([None, datetime.combine(day, datetime.min.time()) + timedelta(hours=rng.choice([9, 10, 30, 100]), minutes=15)])
            out.append((f"F{k:02d}", day, published, rng.choice(["Para Piyasası", "PARA PİYASASI fonu", "Hisse"]), f"n{k}", rng.choice(founders), rng.choice("AAB"), "TEFAS'ta işlem görüyor",
                        rng.choice([0.0, 1.0, 1.0, 0.5, None]), 1.0, datetime.combine(day, datetime.min.time())))
    return out


def replay(rows, prices, day, top, cap, funds, fresh):
    """The basket of one day, straight from the rule: (code, weight, n_nav, last day)."""
    moment = datetime.combine(day, datetime.min.time()) + timedelta(hours=9, minutes=15)
    newest = {}
    for r in sorted(rows, key=lambda r: r[1]):
        if r[1] <= day and (r[2] is None or r[2] <= moment):
            newest[r[0]] = r
    seen = {c: [d for x, d, v in prices if x == c and d <= day and v is not None] for c in newest}
    n_days = len({d for _, d, v in prices if d <= day and v is not None})
    pool = [r for c, r in newest.items() if r[3] != "Hisse" and "KARA" not in (r[5] or "") and seen[c] and len(seen[c]) >= 0.6 * n_days]
    count = pd.Series([r[6] for r in pool]).value_counts()
    usual = min((c for c in count.index if count[c] == count.max()), default=None)
    good = [r for r in pool if r[6] == usual and (r[5] or "").strip() and r[8] is not None and r[8] == int(r[8]) and moment - timedelta(days=fresh) <= r[10] <= moment]
    good = sorted(good, key=lambda r: (-len(seen[r[0]]), r[0]))[:top]
    weights, used = [], {}
    for r in good:
        used[r[5].strip()] = used.get(r[5].strip(), 0) + 1
        weights.append(1 / len(good) if used[r[5].strip()] <= funds else 0.0)
    whole = {f: sum(w for w, r in zip(weights, good) if r[5].strip() == f) for f in used}
    return [(r[0], round(w * min(1, cap / whole[r[5].strip()]), 9), len(seen[r[0]]), max(seen[r[0]])) for w, r in zip(weights, good)]


@pytest.mark.parametrize("seed", [1, 2])
def test_baskets_of_all_days_equal_a_replay_of_each(spark, seed):
    rng = Random(seed)
    rows = snapshots(rng, ["A", "A ", "B", "", None, "KARA"])
    prices = [(f"F{k:02d}", d, rng.choice([1.0, 1.0, 1.0, None])) for k in range(12) for d in DAYS]
    days = spark.createDataFrame([(d,) for d in DAYS[3:]], "at date")
    got = lb.live_baskets(days, spark.createDataFrame(rows, MASTER), spark.createDataFrame(prices, "fund_code string, d date, price double"), "para piyasası", ("kara",), 0.6, 4, None, 20, 0.3, 2)
    by_day = {}
    for r in got.orderBy("at", "rank").collect():
        by_day.setdefault(r["at"], []).append((r["fund_code"], round(r["weight"], 9), r["n_nav"], r["last_nav_date"]))
    expected = {d: b for d in DAYS[3:] if (b := replay(rows, prices, d, 4, 0.3, 2, 20))}
    assert len(expected) > 5 and by_day == expected
    assert all(sum(w for _, w, _, _ in b) <= 1 + 1e-9 for b in by_day.values())


def test_basket_of_empty_tables(spark):
    none = spark.createDataFrame([], MASTER)
    days, prices = spark.createDataFrame([(DAYS[0],)], "at date"), spark.createDataFrame([], "fund_code string, d date, price double")
    assert lb.live_baskets(days, none, prices, "x").count() == 0
    rows = snapshots(Random(3), ["A"]) + [(None, DAYS[0], *[None] * 9), ("F00", None, *[None] * 9)]
    assert lb.live_baskets(days, spark.createDataFrame(rows, MASTER), prices, "para").count() == 0


def intervals(rng, wide):
    rows = []
    for k in range(150):
        for c in "ABCDEF":
            low = rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.gauss(0, 1)
            rows.append((c, date(2025, 1, 1) + timedelta(days=2 * k), None if rng.random() < 0.1 else rng.gauss(0.3, 1), low, None if low is None else low + wide))
    return rows


def plain(rows, end, n, seed):
    """coverage by series and period: means of the months' means, with the draw of the operator."""
    from hashlib import md5

    df = pd.DataFrame(rows, columns=["code", "d", "y", "lower", "upper"]).astype({"lower": float, "y": float}).dropna(subset=["lower"])
    pool = df[df["lower"] > 0].copy()
    pool["draw"] = [md5(f"{seed}|{c}|{d}".encode()).hexdigest() for c, d in zip(pool["code"], pool["d"])]
    first = lambda by, up: pool.sort_values(by, ascending=up).groupby("d").head(n)
    out = {}
    for s, x in {"all": df, "positive": pool, "random": first(["draw", "code"], True), "top": first(["lower", "code"], [False, True])}.items():
        x = x.dropna(subset=["y"]).copy()
        x["in"] = ((x["lower"] <= x["y"]) & (x["y"] <= x["upper"])).astype(float)
        x["period"] = np.where(pd.to_datetime(x["d"]) <= pd.Timestamp(end), "selection", "outside")
        month = x.groupby(["period", pd.to_datetime(x["d"]).dt.to_period("M")])["in"].mean()
        out.update({(s, p): v for p, v in month.groupby(level=0).mean().items()})
        out[s, "both"] = month.mean()
    return out


def test_parts_add_up_to_the_gap(spark):
    issued, constant = intervals(Random(5), 1.0), intervals(Random(6), 1.6)
    frame = lambda rows: spark.createDataFrame(rows, "code string, d date, y double, lower double, upper double")
    end = "2025-05-20"
    a, b = plain(issued, end, 2, 0), plain(constant, end, 2, 0)
    means = at.by_period(at.monthly(frame(issued), end, 2)).collect()
    assert {(r["series"], r["period"]): round(r["coverage"], 10) for r in means} == {k: round(v, 10) for k, v in a.items()}
    parts = {r["period"]: r for r in at.gap_parts(frame(issued), frame(constant), 0.2, end, 2).collect()}
    assert set(parts) == {"selection", "outside", "both"}
    for p, r in parts.items():
        assert r["gap"] == pytest.approx(a["top", p] - 0.8) and r["gap"] == pytest.approx(r["base"] + r["pool"] + r["ranking"])
        assert r["level"] == pytest.approx(a["top", p] - b["top", p])
        assert r["dominant"] == max(("pool", "ranking", "level"), key=lambda c: abs(r[c]))
        assert r["few"] == (r["constant_months"] < 6)


def test_gap_without_candidates(spark):
    rows = [("A", date(2025, 1, 1), 0.0, -1.0, 1.0)]
    frame = spark.createDataFrame(rows, "code string, d date, y double, lower double, upper double")
    parts = {r["period"]: r for r in at.gap_parts(frame, frame, 0.2, "2025-05-20").collect()}
    assert set(parts) == {"selection", "both"}
    r = parts["both"]
    assert r["base"] == pytest.approx(0.2) and r["gap"] is None and r["pool"] is None and r["dominant"] is None and r["few"]
    assert at.gap_parts(frame.limit(0), frame.limit(0), 0.2, "2025-05-20").count() == 0
