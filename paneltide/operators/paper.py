"""Paper trading: orders from targets, proposals with expiry, next-day fills, ledger state as tables, reconciliation."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.operators import allocation
from paneltide.operators.allocation import founder_limits
from paneltide.operators.ledger import SLOT, Ledger, Lot

LOTS = "fund_code string, units double, cost_per_unit double, tax_rate double, available_idx bigint"
STATE = "cash double, due_json string"


def save(spark: SparkSession, book: Ledger) -> tuple[DataFrame, DataFrame]:
    """(lots, state) of a ledger; lots keep their order of purchase."""
    lots = [(c, x.units, x.cost, x.tax, x.available) for c, ls in sorted(book.lots.items()) for x in ls]
    return spark.createDataFrame(lots, LOTS), spark.createDataFrame([(book.cash, json.dumps({str(k): v for k, v in sorted(book.due.items())}))], STATE)


def load(lots: DataFrame, state: DataFrame) -> Ledger:
    s = state.first()
    book = Ledger(s["cash"], due={int(k): v for k, v in json.loads(s["due_json"]).items()})
    for r in lots.collect():  # one portfolio's lots
        book.lots.setdefault(r["fund_code"], deque()).append(Lot(r["units"], r["cost_per_unit"], r["tax_rate"], r["available_idx"]))
    return book


@dataclass(frozen=True)
class Order:
    fund_code: str
    side: str
    value: float


def orders(book: Ledger, target: dict[str, float], prices: dict[str, float], day: int, founders: dict[str, str | None], blocked: dict[str, str] | None = None, threshold: float = 0.03, bought: dict[str, int] | None = None, min_hold: int = 21) -> tuple[list[Order], dict[str, str]]:
    """Orders towards a target and the reasons of what was left out. Held weight uses founder room before any sale."""
    blocked, bought, skipped = blocked or {}, bought or {}, {}
    equity = book.value(prices)
    held = {c: book.units(c) * prices[c] / equity for c in book.lots if book.units(c) > 0 and c in prices}
    young = {c for c in held if day - bought.get(c, -(10**6)) < min_hold}
    locked = young | {c for c in held if c in blocked or book.sellable(c, day) < book.units(c) - 1e-9}
    limited = founder_limits(pd.Series(target, dtype=float), pd.Series(held, dtype=float), pd.Series(founders, dtype=object), locked=locked)
    out: list[Order] = []
    budget = book.cash + sum(v for k, v in book.due.items() if k <= day)
    for c, t in sorted(limited.items()):
        gap = t - held.get(c, 0.0)
        if c in locked and target.get(c, 0.0) < held[c] - 1e-12:
            skipped[c] = blocked.get(c) or ("min_hold" if c in young else "not_available")
        if abs(gap) < 1e-12:
            continue
        if c in blocked or c not in prices:
            skipped[c] = blocked.get(c, "no_price")
        elif abs(gap) < threshold and not (t <= 0 or held.get(c, 0.0) <= 0):
            skipped[c] = "below_threshold"
        else:
            out.append(Order(c, "buy" if gap > 0 else "sell", abs(gap) * equity))
    total = sum(o.value for o in out if o.side == "buy")
    scale = min(1.0, budget / total) if total > 0 else 1.0
    return [Order(o.fund_code, o.side, o.value * scale) if o.side == "buy" else o for o in out], skipped


def selected_weights(
    selection: pd.DataFrame, prices: pd.DataFrame, founders: pd.Series, drawdown: float = 0.0, cov_rows: int = 126,
    ceiling: float = 0.30, fall: float = 0.12, fallen: float = 0.65, **limits,
) -> pd.Series:
    """Target weights of the selected funds, the rest in the cash slot.

    ``selection``: code, lower, selected; ``prices``: days x codes. Risk parity of all selected funds with prices, best lower end first,
    over the days on which all of them have a return (``limits``: fields of ``allocation.Limits``), under a ceiling on all of them
    together, which is ``fallen`` at most beyond a drawdown of ``fall``. Nothing selected or no prices: all in the slot.
    """
    lower = selection[selection["selected"].eq(True) & selection["code"].isin(prices.columns)].set_index("code")["lower"]
    returns = np.log(prices[lower.index]).diff().dropna().tail(cov_rows)
    funds = allocation.risk_parity(returns, lower, founders, len(lower), allocation.Limits(**limits))
    room = min(ceiling, fallen) if drawdown > fall else ceiling
    invested = min(room, funds.sum())
    scaled = funds * (invested / funds.sum()) if len(funds) else funds
    return pd.concat([scaled, pd.Series({SLOT: 1.0 - invested})])


def propose(existing: list[dict], day: date, made: list[Order], now: datetime, evidence: list[str]) -> tuple[dict, bool]:
    """A proposal for a day and whether it is new: one for each day, valid until noon of the next."""
    for p in existing:
        if p["date"] == day and p["status"] in ("open", "filled"):
            return p, False
    n = 1 + max((int(p["proposal_id"].split("-")[1]) for p in existing if p["proposal_id"].startswith(f"{day:%Y%m%d}-")), default=0)
    expires = datetime.combine(day + timedelta(days=1), datetime.min.time()).replace(hour=12)
    return {"proposal_id": f"{day:%Y%m%d}-{n:02d}", "date": day, "created_at": now, "expires_at": expires, "status": "open", "orders_json": json.dumps([vars(o) for o in made]), "evidence_count": len(evidence), "evidence_codes": json.dumps(evidence)}, True


def fill(book: Ledger, proposal: dict, prices: dict[str, float], meta: dict[str, dict], day: int, when: date) -> tuple[dict, list[dict]]:
    """Fills an open proposal on the day after it; a repeat changes nothing. Each order ends filled, partial, pending or rejected."""
    if proposal["status"] != "open":
        return proposal, []
    if when <= proposal["date"]:
        raise ValueError("a proposal fills on a later day")
    if datetime.combine(when, datetime.min.time()) > proposal["expires_at"]:
        return {**proposal, "status": "expired"}, []
    results = []
    todo = sorted(json.loads(proposal["orders_json"]), key=lambda o: (o["side"] == "buy", o["fund_code"]))
    for n, o in enumerate(todo):
        c, m = o["fund_code"], meta.get(o["fund_code"], {})
        outcome, reason, units = "rejected", m.get("reason", "blocked"), 0.0
        if c not in prices:
            outcome, reason = "pending", "no_price"
        elif o["side"] == "sell" and m.get("can_sell"):
            want = o["value"] / prices[c]
            units = book.sell(c, want, prices[c], day, int(m.get("sell_lag", 0)), m.get("exit_fee", 0.0))[0]
            outcome, reason = ("filled", "ok") if units >= min(want, units + 1e-9) and units > 0 else ("rejected", "nothing_to_sell")
            outcome = "partial" if 0 < units < want - 1e-9 else outcome
        elif o["side"] == "buy" and m.get("can_buy"):
            amount = min(o["value"], book.cash)
            if amount > 1e-9:
                units = book.buy(c, amount, prices[c], day, int(m.get("buy_lag", 0)), m.get("entry_fee", 0.0), m.get("tax_rate", 0.0))
                outcome, reason = ("filled", "ok") if amount >= o["value"] - 1e-9 else ("partial", "cash")
            else:
                reason = "cash"
        results.append({"proposal_id": proposal["proposal_id"], "order_index": n, "fund_code": c, "side": o["side"], "requested_value": o["value"], "outcome": outcome, "reason": reason, "units": units, "fill_date": when})
    return {**proposal, "status": "filled"}, results


def identity(book: Ledger, prices: dict[str, float], reported: float, tolerance: float = 1e-6) -> dict:
    """Whether value = cash + receivables + units x price holds against a reported figure."""
    value = book.value(prices)
    return {"value": value, "difference": value - reported, "identity_ok": abs(value - reported) <= tolerance, "liquidation_value": book.liquidation(prices)}


def pilot_window(runs: DataFrame, moment: datetime, days: int, epoch: datetime | None) -> DataFrame:
    """Runs since the later of the window's start and the epoch."""
    start = max(moment - timedelta(days=days), epoch) if epoch else moment - timedelta(days=days)
    return runs.filter((F.col("started_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("started_at") < F.lit(moment).cast("timestamp_ntz")))


def shadow_snapshot(results: DataFrame, days: DataFrame, asof: date) -> tuple[DataFrame, DataFrame]:
    """(status, equity) of the runs of ``ledger.run_isolated``, as of a day. ``days``: i, d.

    A run has failed if it has an error, no equity, or one that is not a finite number; then it has no equity row. Otherwise its
    last equity is one row of that day.
    """
    value = F.col("equity")
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    error = F.max(F.when(F.col("events").startswith("failed: "), F.substring("events", 9, 10**6)))
    held = F.when(value.isNotNull(), F.col("i"))
    run = results.groupBy(F.col("run_id").alias("portfolio")).agg(
        F.count(value).alias("_n"), F.count_if(odd).alias("_odd"), error.alias("_error"), F.max_by(value, held).alias("equity"), F.max(held).alias("i")
    )
    reason = F.coalesce("_error", F.when(F.col("_n") == 0, "no equity"), F.when(F.col("_odd") > 0, "equity is not finite"))
    run = run.withColumn("error", reason).withColumn("asof", F.lit(asof))
    ok = F.col("error").isNull()
    status = run.select("portfolio", F.col("asof").alias("date"), F.when(ok, "ok").otherwise("failed").alias("status"), "error", F.when(ok, F.col("_n")).otherwise(0).alias("n_rows"))
    return status, run.filter(ok).join(days, "i").select("portfolio", F.col("d").alias("date"), "equity", F.col("asof").alias("nav_asof"))


def store_shadows(stored: tuple[DataFrame, DataFrame], made: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both tables after a snapshot; a repeat changes nothing. A failed portfolio loses what the same day's snapshot wrote before."""
    (old_status, old_equity), (status, equity) = stored, made
    failed = status.filter("status = 'failed'").select("portfolio", F.col("date").alias("nav_asof"))
    kept = old_equity.join(failed, ["portfolio", "nav_asof"], "left_anti").join(equity.select("portfolio", "date"), ["portfolio", "date"], "left_anti")
    keys = status.select("portfolio", "date")
    return old_status.join(keys, ["portfolio", "date"], "left_anti").unionByName(status), kept.select(*equity.columns).unionByName(equity)


def overall(status: DataFrame) -> str:
    """``ok``, ``partial`` or ``failed`` for a snapshot's statuses."""
    n, bad = status.agg(F.count("*"), F.count_if(F.col("status") == "failed")).first()
    return "failed" if n and bad == n else "partial" if bad else "ok"
