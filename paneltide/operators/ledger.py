"""Tax-lot ledger and day-by-day replay: sequential inside a run, many runs side by side.

State feeds back from day to day (cash, lots, settlement, drawdown), so a run is one grouped
function; runs (strategy, parameters, start, seed, stress) are the parallel axis.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from copy import copy, deepcopy
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass
class Lot:
    units: float
    cost: float
    tax: float
    available: int


@dataclass
class Ledger:
    """Cash, FIFO lots by fund, and proceeds under way."""

    cash: float
    lots: dict[str, deque] = field(default_factory=dict)
    due: dict[int, float] = field(default_factory=dict)
    taxes: float = 0.0
    turnover: float = 0.0
    fills: list[dict] = field(default_factory=list)

    def units(self, code: str) -> float:
        return sum(x.units for x in self.lots.get(code, ()))

    def sellable(self, code: str, day: int) -> float:
        return sum(x.units for x in self.lots.get(code, ()) if x.available <= day)

    def value(self, prices: dict[str, float], haircut: dict[str, float] | None = None) -> float:
        risky = sum(self.units(c) * prices.get(c, 0.0) * (1 - (haircut or {}).get(c, 0.0)) for c in self.lots)
        return self.cash + sum(self.due.values()) + risky

    def settle(self, day: int) -> float:
        got = sum(self.due.pop(k) for k in [k for k in self.due if k <= day])
        self.cash += got
        return got

    def accrue(self, rate: float, tax: float) -> None:
        """The day's return on cash, less tax; nothing on cash that is not positive or on a rate that is not a number."""
        if self.cash > 0 and np.isfinite(rate):
            gain = self.cash * rate
            self.cash += gain * (1 - tax)
            self.taxes += gain * tax

    def raise_cash(self, code: str, amount: float, price: float, day: int) -> float:
        """Sells as many units as bring ``amount`` after tax, or all there are."""
        units, missing = 0.0, amount
        for lot in self.lots.get(code, ()):
            if missing <= 0 or lot.available > day:
                continue
            net = price - lot.tax * max(price - lot.cost, 0.0)
            take = min(lot.units, missing / net) if net > 0 else 0.0
            units, missing = units + take, missing - take * net
        return self.sell(code, units, price, day)[0] if units > 0 else 0.0

    def buy(self, code: str, amount: float, price: float, day: int, lag: int = 0, fee: float = 0.0, tax: float = 0.0) -> float:
        """Spends ``amount``, fee included; the lot can be sold from ``day + lag`` on and keeps today's tax rate."""
        if amount > self.cash + 1e-9:
            raise ValueError(f"not enough cash for {code}: {amount} > {self.cash}")
        cost = price * (1 + fee)
        units = amount / cost
        self.lots.setdefault(code, deque()).append(Lot(units, cost, tax, day + lag))
        self.cash -= amount
        self.turnover += amount
        self.fills.append({"day": day, "code": code, "side": "buy", "units": units, "price": price, "gross": amount, "tax": 0.0, "gain": 0.0})
        return units

    def sell(self, code: str, units: float, price: float, day: int, lag: int = 0, fee: float = 0.0) -> tuple[float, float, float]:
        """(units, gain, tax). First in, first out, over lots that may be sold; losses do not offset tax."""
        left, gain, tax, gross = min(units, self.sellable(code, day)), 0.0, 0.0, 0.0
        sold = left
        keep: deque = deque()
        for lot in self.lots.get(code, ()):
            take = min(lot.units, left) if lot.available <= day else 0.0
            if take > 0:
                proceeds = take * price * (1 - fee)
                g = proceeds - take * lot.cost
                gross, gain, tax, left = gross + proceeds, gain + g, tax + lot.tax * max(g, 0.0), left - take
                lot.units -= take
            if lot.units > 1e-12:
                keep.append(lot)
        self.lots[code] = keep
        if sold <= 0:
            return 0.0, 0.0, 0.0
        net = gross - tax
        if lag <= 0:
            self.cash += net
        else:
            self.due[day + lag] = self.due.get(day + lag, 0.0) + net
        self.taxes += tax
        self.turnover += gross
        self.fills.append({"day": day, "code": code, "side": "sell", "units": sold, "price": price, "gross": gross, "tax": tax, "gain": gain})
        return sold, gain, tax

    def gain_share(self, code: str, price: float) -> float:
        """Share of units held at a gain."""
        total = self.units(code)
        return sum(x.units for x in self.lots.get(code, ()) if price > x.cost) / total if total else 0.0

    def liquidation(self, prices: dict[str, float]) -> float:
        tax = sum(x.tax * max(x.units * (prices.get(c, 0.0) - x.cost), 0.0) for c, ls in self.lots.items() for x in ls)
        return self.value(prices) - tax


@dataclass(frozen=True)
class Rules:
    capital: float = 100.0
    threshold: float = 0.03
    taxed_threshold: float = 0.06
    fall: float = 0.12
    recover: float = 0.06
    forced_exposure: float = 0.65
    warm_up: int = 0
    every: int = 21
    cash_tax: float = 0.175
    haircut: float = 0.0


#: The cash fund inside the ledger: bought with all free cash at the end of a day, sold on the day that purchases need cash.
SLOT = "@cash"


@dataclass(frozen=True)
class View:
    """What a strategy may know on a day: the day before and earlier. ``known``: that day's rows (none on the first day);
    ``prices``: all earlier days x codes; ``held``: weights at the last known prices."""

    known: pd.DataFrame
    prices: pd.DataFrame
    held: dict[str, float]

    def level(self, default: float) -> float:
        got = self.known["level"].iloc[0] if "level" in self.known and len(self.known) else None
        return float(got) if pd.notna(got) else default


Strategy = Callable[[View], tuple[dict[str, float], float]]


def rebalance(book: Ledger, target: dict[str, float], decision: dict[str, float], fill: dict[str, float], meta: dict[str, dict], day: int, rules: Rules, force: bool = False) -> None:
    """Trades towards target weights: sales first, then purchases scaled to the cash there is."""
    equity = book.value(decision)
    if equity <= 0:
        return
    now = {c: book.units(c) * decision.get(c, 0.0) / equity for c in book.lots if c != SLOT}
    for c in sorted(set(now) | set(target)):
        gap, m = target.get(c, 0.0) - now.get(c, 0.0), meta.get(c, {})
        if gap >= 0 or c not in fill or not m.get("can_sell", False):
            continue
        least = rules.taxed_threshold if book.gain_share(c, fill[c]) > 0.5 else rules.threshold
        if -gap < least and target.get(c, 0.0) > 0 and not force:
            continue
        units = book.units(c) if target.get(c, 0.0) <= 0 else min(-gap * equity / fill[c], book.units(c))
        book.sell(c, units, fill[c], day, int(m.get("sell_lag", 0)), m.get("exit_fee", 0.0))
    wants = {}
    for c, t in target.items():
        gap, m = t - now.get(c, 0.0), meta.get(c, {})
        if gap > 0 and c in fill and m.get("can_buy", False) and (gap >= rules.threshold or now.get(c, 0.0) <= 0):
            wants[c] = gap * equity
    total = sum(wants.values())
    if SLOT in book.lots and total > book.cash:
        book.raise_cash(SLOT, total - book.cash, fill[SLOT], day)
    scale = min(1.0, book.cash / total) if total > 0 else 0.0
    for c in sorted(wants):
        m = meta[c]
        amount = min(wants[c] * scale, book.cash)
        if amount > 1e-9:
            book.buy(c, amount, fill[c], day, int(m.get("buy_lag", 0)), m.get("entry_fee", 0.0), m.get("tax_rate", 0.0))


class Replay:
    """One run over a panel, a day at a time. ``rows``: i, code, price and, where there, cash, scheduled, suspended, can_buy, can_sell, lags,
    fees, tax_rate, slot_price and whatever the strategy reads.

    A day: settle, accrue, decide on what was known the day before, trade at the day's prices, value. With ``slot_price``
    cash earns nothing by itself but stands in the cash fund, taxed when sold. A run can be forked between two days or before a
    decision; a fork shares the panel and owns all that changes, the strategy's own state included.
    """

    def __init__(self, rows: pd.DataFrame, strategy: Strategy, rules: Rules):
        self.days = sorted(rows["i"].unique())
        self.by_day = dict(tuple(rows.sort_values(["i", "code"]).groupby("i")))
        self.wide = rows.pivot_table(index="i", columns="code", values="price", aggfunc="first", dropna=False).reindex(self.days)
        self.slot = "slot_price" in rows
        self.rules, self.strategy = rules, strategy
        self.book, self.peak, self.forced, self.filled = Ledger(rules.capital), rules.capital, False, {}
        self.halted: tuple[frozenset, int] = (frozenset(), -1)
        self.chosen: dict[str, float] | None = None
        self.events: list[str] = []

    def fork(self) -> Replay:
        twin = copy(self)
        twin.book, twin.filled, twin.strategy = deepcopy(self.book), dict(self.filled), deepcopy(self.strategy)
        twin.events = list(self.events)
        return twin

    def halt(self, codes: set[str], last: int) -> None:
        """No trade in these codes up to position ``last``, though their prices go on."""
        self.halted = (frozenset(codes), last)

    def begin(self, n: int) -> bool:
        """The day up to its decision; whether there is one."""
        i, today, rules = self.days[n], self.by_day[self.days[n]], self.rules
        self.events, self.chosen = [], None
        self.book.settle(int(i))
        if n and "cash" in today and not self.slot:
            self.book.accrue(float(today["cash"].iloc[0]), rules.cash_tax)
        self.prices = {c: float(p) for c, p in zip(today["code"], today["price"]) if pd.notna(p) and p > 0}
        if self.slot and pd.notna(p := today["slot_price"].iloc[0]):
            self.prices[SLOT] = float(p)
        self.last = dict(self.filled) or dict(self.prices)
        self.equity = self.book.value(self.last)
        down = 1 - self.equity / self.peak
        scheduled = bool(today["scheduled"].iloc[0]) if "scheduled" in today else n % rules.every == 0
        self.trigger = down > rules.fall and not self.forced
        if self.trigger:
            self.forced = True
            self.events.append("drawdown")
        elif self.forced and down < rules.recover and scheduled:
            self.forced = False
            self.events.append("release")
        return n >= rules.warm_up and (scheduled or self.trigger)

    def suspended(self, n: int) -> dict[str, bool]:
        """Which of the day's codes cannot be traded."""
        today, (codes, until) = self.by_day[self.days[n]], self.halted
        marked = today["suspended"] if "suspended" in today else [False] * len(today)
        return {c: bool(s) or (c in codes and self.days[n] <= until) for c, s in zip(today["code"], marked)}

    def decide(self, n: int) -> None:
        i, today, book, rules, decision, prices = int(self.days[n]), self.by_day[self.days[n]], self.book, self.rules, self.last, self.prices
        held = {c: book.units(c) * decision.get(c, 0.0) / self.equity for c in book.lots if c != SLOT and book.units(c) > 0} if self.equity > 0 else {}
        weights, exposure = self.strategy(View(self.by_day[self.days[n - 1]] if n else today.iloc[:0], self.wide.iloc[:n], held))
        exposure = min(exposure, rules.forced_exposure) if self.forced else exposure
        weights = {c: max(w, 0.0) for c, w in weights.items()}
        total = sum(weights.values())
        weights = {c: w / max(total, 1.0) * exposure for c, w in weights.items()}
        get = lambda c, d: dict(zip(today["code"], today[c])) if c in today else dict.fromkeys(today["code"], d)
        stop, buy, sell = self.suspended(n), get("can_buy", True), get("can_sell", True)
        fields = {k: get(k, d) for k, d in (("buy_lag", 0), ("sell_lag", 0), ("entry_fee", 0.0), ("exit_fee", 0.0), ("tax_rate", 0.0))}
        tradable = {c: c in prices and not stop[c] for c in today["code"]}
        meta = {c: {"can_buy": tradable[c] and bool(buy[c]), "can_sell": tradable[c] and bool(sell[c]), **{k: v[c] for k, v in fields.items()}} for c in today["code"]}
        self.events += [f"blocked:{c}" for c in sorted(weights) if weights[c] > 0 and not meta.get(c, {}).get("can_buy", False)]
        locked = {c: w for c, w in held.items() if not meta.get(c, {}).get("can_sell", False)}
        free = {c: w for c, w in weights.items() if c not in locked}
        room = max(0.0, 1 - sum(locked.values()))
        shrink = min(1.0, room / s) if (s := sum(free.values())) > 0 else 0.0
        self.chosen = {**{c: w * shrink for c, w in free.items()}, **locked}
        rebalance(book, self.chosen, decision, prices, meta, i, rules, force=self.trigger)

    def end(self, n: int) -> dict:
        """Values the day; its row."""
        i, book = int(self.days[n]), self.book
        self.filled.update(self.prices)
        if self.slot and book.cash > 1e-9 and SLOT in self.prices:
            book.buy(SLOT, book.cash, self.prices[SLOT], i, tax=self.rules.cash_tax)
        equity = book.value(self.filled)
        self.peak = max(self.peak, equity)
        cut = {c: self.rules.haircut for c, s in self.suspended(n).items() if s}
        return {"i": i, "equity": equity, "cash": book.cash, "receivables": sum(book.due.values()), "stressed": book.value(self.filled, cut), "taxes": book.taxes, "turnover": book.turnover, "events": ",".join(self.events)}


def replay(rows: pd.DataFrame, strategy: Strategy, rules: Rules) -> pd.DataFrame:
    """Equity by day of one run."""
    run, out = Replay(rows, strategy, rules), []
    for n in range(len(run.days)):
        if run.begin(n):
            run.decide(n)
        out.append(run.end(n))
    return pd.DataFrame(out)


def suspensions(rows: pd.DataFrame, strategy: Strategy, rules: Rules, founders: dict[str, str], seeds: int, length: int) -> pd.DataFrame:
    """The run (seed -1) and, for each seed, the run in which a founder's funds cannot be traded for ``length`` positions.

    A seed draws a decision day after the first quarter of them, and one of the funds with weight on that day; all funds of its founder
    (or the fund itself) are halted from then on. The decision days' states are kept, so a seed's run begins at its day; the days before are
    the base run's. A seed whose day has no fund with weight gives no rows; no decisions: the base alone.
    """
    run, base, saved = Replay(rows, strategy, rules), [], []
    for n in range(len(run.days)):
        if run.begin(n):
            saved.append((n, run.fork()))
            run.decide(n)
            saved[-1] += (sorted(c for c, w in run.chosen.items() if w > 0),)
        base.append(run.end(n))
    parts = [pd.DataFrame(base).assign(seed=-1, founder="", funds=0, first=-1)]
    codes = sorted(rows["code"].unique())
    for seed in range(seeds if saved else 0):
        draw = np.random.default_rng(seed)
        n, state, held = saved[int(draw.integers(len(saved) // 4, len(saved)))]
        if not held:
            continue
        code = str(draw.choice(held))
        founder = founders.get(code) or code
        group = {c for c in codes if (founders.get(c) or c) == founder}
        fork, tail = state.fork(), []
        fork.halt(group, int(fork.days[n]) + length - 1)
        fork.decide(n)
        tail.append(fork.end(n))
        for m in range(n + 1, len(fork.days)):
            if fork.begin(m):
                fork.decide(m)
            tail.append(fork.end(m))
        parts.append(pd.DataFrame(base[:n] + tail).assign(seed=seed, founder=founder, funds=len(group), first=int(fork.days[n])))
    return pd.concat(parts, ignore_index=True)


def top_n(n: int = 3, exposure: float = 1.0) -> Strategy:
    """Equal weights on the n best scores of the day before (ties by code)."""

    def choose(view: View) -> tuple[dict[str, float], float]:
        s = view.known.dropna(subset=["score"]).sort_values(["score", "code"], ascending=[False, True])["code"].head(n).tolist()
        return {c: 1.0 / n for c in s}, view.level(exposure)

    return choose


def cash_only(view: View) -> tuple[dict[str, float], float]:
    return {}, 0.0


class RunFailed(Exception):
    """A strategy's error, by type and text."""

    def __init__(self, cause: Exception):
        super().__init__(f"{type(cause).__name__}: {cause}")


EQUITY = "run_id string, i bigint, equity double, cash double, receivables double, stressed double, taxes double, turnover double, events string"


def run_all(panel: DataFrame, runs: DataFrame, strategies: dict[str, Callable[[pd.Series], Strategy]] | None = None, rules: Rules = Rules()) -> DataFrame:
    """Equity of every run. ``runs``: run_id, strategy, n, every, start, tax, haircut; the panel is dealt to each run.

    ``strategies`` makes a run's strategy from its row, by name; ``cash`` and top-n are there. ``tax`` holds for all lots
    unless the panel has a tax_rate of its own. One task holds one run's rows, which is the panel itself: bounded by entities x days, not by runs.
    """
    return _by_run(panel, runs, strategies, rules, replay, EQUITY)


def _by_run(panel: DataFrame, runs: DataFrame, strategies: dict[str, Callable[[pd.Series], Strategy]] | None, rules: Rules, play: Callable[[pd.DataFrame, Strategy, Rules], pd.DataFrame], schema: str) -> DataFrame:
    makers = {"cash": lambda run: cash_only, **(strategies or {})}
    columns = ["strategy", "n", "every", "start", "tax", "haircut"]
    names = [part.split()[0] for part in schema.split(", ")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        make = makers.get(first["strategy"], lambda run: top_n(int(run["n"])))
        own = replace(rules, every=int(first["every"]), haircut=float(first["haircut"]))
        rows = rows[rows["i"] >= first["start"]].drop(columns=columns)
        if "tax_rate" not in rows:
            rows = rows.assign(tax_rate=float(first["tax"]))
        try:
            got = play(rows, make(first), own)
        except RunFailed as failed:
            got = pd.DataFrame(columns=names[1:], index=[0]).assign(events=f"failed: {failed}")
        return got.assign(run_id=key[0])[names]

    return panel.crossJoin(F.broadcast(runs)).groupBy("run_id").applyInPandas(one, schema)


SUSPENDED = f"{EQUITY}, seed bigint, founder string, funds bigint, first bigint"


def run_suspended(panel: DataFrame, runs: DataFrame, seeds: int = 5, length: int = 126, strategies: dict[str, Callable[[pd.Series], Strategy]] | None = None, rules: Rules = Rules()) -> DataFrame:
    """:func:`suspensions` of every run, with the panel's column ``founder`` (null: a founder of its own). ``runs`` as in :func:`run_all`.

    ``stressed`` is the value with the run's haircut on funds that are halted on the day. One task holds one run and its seeds.
    """

    def play(rows: pd.DataFrame, strategy: Strategy, own: Rules) -> pd.DataFrame:
        founders = dict(rows.dropna(subset=["founder"])[["code", "founder"]].to_numpy())
        return suspensions(rows, strategy, own, founders, seeds, length)

    return _by_run(panel, runs, strategies, rules, play, SUSPENDED)


def run_isolated(panel: DataFrame, runs: DataFrame, strategies: dict[str, Callable[[pd.Series], Strategy]] | None = None, rules: Rules = Rules()) -> DataFrame:
    """``run_all`` where a strategy's error ends its own run only: that run is one row without figures, the error in ``events``."""

    def guarded(make: Callable[[pd.Series], Strategy]) -> Callable[[pd.Series], Strategy]:
        def safe(run: pd.Series) -> Strategy:
            try:
                inner = make(run)
            except Exception as failed:
                raise RunFailed(failed) from failed

            def choose(view: View) -> tuple[dict[str, float], float]:
                try:
                    return inner(view)
                except Exception as failed:
                    raise RunFailed(failed) from failed

            return choose

        return safe

    return run_all(panel, runs, {k: guarded(m) for k, m in (strategies or {}).items()}, rules)


def tax_rate_on(day: Column, category: Column, schedule: list[tuple[str, dict[str, float]]], fallback: Column) -> Column:
    """Tax rate of a lot bought on ``day``: of the last regime that has begun and knows the category or a default; else ``fallback``.

    ``schedule``: (first day, rates by category, ``default`` for the others). A few regimes, so they are one expression.
    """

    def of(rates: dict[str, float]) -> Column:
        default = F.lit(rates.get("default")).cast("double")
        named = [(c, r) for c, r in rates.items() if c != "default"]
        known = F.element_at(F.create_map(*[F.lit(x) for c, r in named for x in (c, float(r))]), category) if named else F.lit(None).cast("double")
        return F.coalesce(F.nanvl(known, default), default)

    begun = [F.when(day >= F.lit(start).cast("date"), of(rates)) for start, rates in sorted(schedule, reverse=True)]
    return F.coalesce(*begun, fallback)


def fifo_matches(buys: DataFrame, sells: DataFrame, key: str) -> DataFrame:
    """Units of each sale matched to each purchase, first in first out, by overlapping running sums.

    ``buys``: key, seq, units, price; ``sells`` alike. An equi-join by key with an interval condition.
    """
    run = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda d, p: d.select(key, F.col("seq").alias(f"{p}_seq"), F.col("price").alias(f"{p}_price"), (F.sum("units").over(run) - F.col("units")).alias(f"{p}_from"), F.sum("units").over(run).alias(f"{p}_to"))
    b, s = side(buys, "b"), side(sells, "s")
    hit = b.join(s, key).filter((F.col("b_from") < F.col("s_to")) & (F.col("s_from") < F.col("b_to")))
    units = F.least("b_to", "s_to") - F.greatest("b_from", "s_from")
    return hit.select(key, "b_seq", "s_seq", units.alias("units"), (units * (F.col("s_price") - F.col("b_price"))).alias("gain"))


def drawdown_states(equity: DataFrame, by: str, fall: float = 0.12, recover: float = 0.06) -> DataFrame:
    """Hysteresis over a given equity path: adds ``down`` and ``forced``, which the last row beyond either limit decides."""
    w = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    down = equity.withColumn("down", 1 - F.col("equity") / F.max("equity").over(w))
    turned = F.when(F.col("down") > fall, True).when(F.col("down") < recover, False)
    return down.select(by, "i", "down", F.coalesce(F.last(turned, ignorenulls=True).over(w), F.lit(False)).alias("forced"))


def turnover_per_year(fills: pd.DataFrame, equity: pd.DataFrame) -> float:
    years = len(equity) / 252
    return float(np.abs(fills["gross"]).sum() / equity["equity"].mean() / years) if years and len(fills) else 0.0
