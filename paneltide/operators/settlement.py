"""Settlement stress of fixed baskets: bought once in equal parts, sold on a given day, with proceeds under way until they settle.

Nothing feeds back from the market into the holdings, so no day is replayed: purchases, sales and settlements are rows, and cash
that earns a return between them grows by a ratio of prefix products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.stats import whole_days
from paneltide.functions.text import first_reason

#: What is asked of every basket; only the whole period has accounts of its own, as no lot is sold and bought again at the others' border.
SCENARIOS, PERIODS = ("base", "later_settlement"), ("full", "select", "external")
FIXED, REINVESTED = "fixed_terminal", "synthetic_reinvestment"
NO_ACCOUNTS = "not evaluable: no sale and no purchase at the border of the period"


def _members(baskets: DataFrame, prices: DataFrame, marks: DataFrame) -> DataFrame:
    """basket, code, copies, rows, good, p_first, p_mid, p_last: each member with what its prices say at the days that count."""
    at = lambda day: F.max(F.when(F.col("i") == F.col(day), F.col("price")))
    fine = F.coalesce((F.col("price") > 0) & ~F.isnan("price") & (F.col("price") < float("inf")), F.lit(False))
    seen = prices.join(F.broadcast(marks), F.col("i").between(F.col("first"), F.col("last")))
    ends = seen.groupBy("code").agg(F.count("*").alias("rows"), F.count_if(fine).alias("good"), at("first").alias("p_first"), at("mid").alias("p_mid"), at("last").alias("p_last"))
    held = baskets.filter("basket IS NOT NULL AND code IS NOT NULL").groupBy("basket", "code").agg(F.count("*").alias("copies"))
    return held.join(ends, "code", "left")


def _profiles(profiles: DataFrame, marks: DataFrame) -> DataFrame:
    """code, on_first, on_mid, on_last: each code's profile on the days that count; of several on a day the first by all its fields."""
    fields = F.struct("buy_valor", "sell_valor", "can_buy", "can_sell", "tax_category", "tax_rate")
    days = F.broadcast(marks.select(*[F.col(m).alias(f"_{m}") for m in ("first", "mid", "last")]))
    near = profiles.join(days, F.col("i").isin(F.col("_first"), F.col("_mid"), F.col("_last")))
    return near.groupBy("code").agg(*[F.min(F.when(F.col("i") == F.col(f"_{m}"), fields)).alias(f"on_{m}") for m in ("first", "mid", "last")])


def _usable(p: str) -> Column:
    f = lambda c: F.col(f"{p}.{c}")
    return F.coalesce(whole_days(f("buy_valor")) & whole_days(f("sell_valor")) & f("can_buy").isNotNull() & f("can_sell").isNotNull() & (F.trim(f("tax_category")) != ""), F.lit(False))


def settlement_stress(
    baskets: DataFrame, prices: DataFrame, profiles: DataFrame, cash: DataFrame, later: int = 1, liquidation: int | None = None,
    capital: float = 100.0, cash_tax: float = 0.175, unknown_tax: float = 0.175, days_a_year: int = 252,
) -> DataFrame:
    """A row for each basket, mode, scenario and period, with a status.

    ``baskets``: basket, code; ``prices``: code, i, price; ``profiles``: code, i, buy_valor, sell_valor, can_buy, can_sell, tax_category,
    tax_rate (null: ``unknown_tax``); ``cash``: i, rate. Positions run from the first to the last of ``prices``.

    ``fixed_terminal``: equal parts bought on the first day, all sold on the last; what has not settled is under way and part of
    ``ending_equity``. ``synthetic_reinvestment``: sold on position ``liquidation`` and, from the days after settlement on, kept as cash that
    earns ``rate`` less ``cash_tax``; a day on which proceeds settle earns nothing, as in a ledger that settles before it accrues.
    ``later_settlement`` adds ``later`` days to each sale. Gains are taxed at the lot's rate, losses do not offset. ``identity_gap`` is how far
    ending equity is from capital plus gains less taxes, each summed by itself.

    A basket is not evaluable, with figures null and the first reason as its status, if a member is listed twice, has not one positive price
    for every position, no whole profile on a day that counts, is closed for that day's trade, or holds lots that cannot be sold yet. Nothing
    missing means allowed. Null baskets and codes are left out. No baskets: no rows; no prices or profiles: no basket is evaluable. No
    ``liquidation``: the second mode has no rows.
    """
    marks = prices.agg(F.min("i").alias("first"), F.max("i").alias("last")).withColumn("mid", F.lit(liquidation).cast("bigint"))
    rows = _members(baskets, prices, marks).join(_profiles(profiles, marks), "code", "left")
    rows = rows.crossJoin(F.broadcast(marks)).withColumn("_span", F.col("last") - F.col("first") + 1)
    modes = [F.struct(F.lit(FIXED).alias("mode"), F.col("last").alias("sold_at"), F.col("p_last").alias("p_sold"), F.col("on_last").alias("on_sale"))]
    if liquidation is not None:
        modes.append(F.struct(F.lit(REINVESTED).alias("mode"), F.col("mid").alias("sold_at"), F.col("p_mid").alias("p_sold"), F.col("on_mid").alias("on_sale")))
    rows = rows.withColumn("_m", F.explode(F.array(*modes))).select("*", "_m.*")
    rows = rows.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(x).alias("extra")) for s, x in zip(SCENARIOS, (0, later))]))).select("*", "_s.*")
    once = F.coalesce((F.col("rows") == F.col("_span")) & (F.col("good") == F.col("_span")), F.lit(False))
    lots_free = F.coalesce(F.col("first") + F.col("on_first.buy_valor") <= F.col("sold_at"), F.lit(False))
    inside = (F.col("sold_at") > F.col("first")) & ((F.col("mode") == FIXED) | (F.col("sold_at") < F.col("last")))
    problem = first_reason(
        (F.col("copies") > 1, "1 member listed twice"),
        (~once, "2 prices incomplete"),
        (~inside, "3 no day of sale inside the period"),
        (~_usable("on_first"), "4 no whole profile on the first day"),
        (~_usable("on_sale"), "5 no whole profile on the day of sale"),
        (~F.coalesce(F.col("on_first.can_buy"), F.lit(False)), "6 closed for purchase on the first day"),
        (~F.coalesce(F.col("on_sale.can_sell"), F.lit(False)), "7 closed for sale on the day of sale"),
        (~lots_free, "8 lots not yet to be sold"),
    )
    run = ["basket", "mode", "scenario"]
    everyone = Window.partitionBy(*run)
    part = F.lit(float(capital)) / F.count("*").over(everyone)
    gain = part * (F.col("p_sold") / F.col("p_first") - 1)
    tax = F.coalesce("on_first.tax_rate", F.lit(unknown_tax)) * F.greatest(gain, F.lit(0.0))
    rows = rows.withColumn("problem", problem).withColumns({"part": part, "gain": gain, "tax": tax}).withColumn("net", part + gain - tax)
    rows = rows.withColumn("lag", (F.col("on_sale.sell_valor") + F.col("extra")).cast("bigint")).withColumn("settled_at", F.col("sold_at") + F.col("lag"))
    rows = _grown(rows, cash, marks, run, cash_tax)
    sums = rows.groupBy(*run).agg(
        F.min(F.when(F.col("problem") != "ok", F.col("problem"))).alias("problem"), F.max("settled_at").alias("settle_i"), F.min("calm").alias("calm"),
        F.sum("part").alias("paid"), F.sum("gain").alias("gains"), F.sum("tax").alias("sale_tax"), F.sum("cash_gain").alias("cash_gains"),
        F.sum(F.when(F.col("settled"), F.col("net") + F.col("cash_gain") * (1 - cash_tax)).otherwise(0.0)).alias("settled_cash"),
        F.sum(F.when(F.col("settled"), 0.0).otherwise(F.col("net"))).alias("receivables"), F.any_value("_span").alias("days"),
    )
    sums = sums.withColumn("problem", F.coalesce(F.col("problem"), F.when(~F.col("calm"), "9 cash returns incomplete")))
    ok = F.col("problem").isNull()
    status = F.when(ok, F.lit("ok")).otherwise(F.concat(F.lit("not evaluable: "), F.substring("problem", 3, 100)))
    end = F.col("settled_cash") + F.col("receivables")
    taxes = F.col("sale_tax") + F.col("cash_gains") * cash_tax
    cagr = F.pow(end / capital, F.lit(float(days_a_year)) / (F.col("days") - 1)) - 1
    figures = {
        "cagr": cagr, "settle_i": F.col("settle_i"), "taxes_paid": taxes, "settled_cash": F.col("settled_cash"), "receivables": F.col("receivables"), "ending_equity": end,
        "identity_gap": F.abs(end - (F.col("paid") + F.col("gains") + F.col("cash_gains") - taxes)),
    }
    out = sums.withColumn("period", F.explode(F.array(*[F.lit(p) for p in PERIODS])))
    own = F.col("period") == "full"
    shown = [F.when(ok & own if name in ("cagr", "identity_gap") else ok, value).alias(name) for name, value in figures.items()]
    return out.select(*run, "period", F.when(ok & ~own, F.lit(NO_ACCOUNTS)).otherwise(status).alias("status"), *shown)


def _grown(rows: DataFrame, cash: DataFrame, marks: DataFrame, run: list[str], cash_tax: float) -> DataFrame:
    """Adds settled, calm and cash_gain: what each member's proceeds earn, before tax, between their settlement and the end.

    The logarithm of a day's growth is summed along the calendar once; a run takes a difference of two such sums, less the days on which
    some of its own proceeds settle. Only distinct settlement days of a run are windowed, a few for each.
    """
    growth = F.lit(1.0) + F.col("rate") * (1 - cash_tax)
    sound = F.coalesce((F.col("rate") > -1) & ~F.isnan("rate") & (F.col("rate") < float("inf")), F.lit(False))
    days = marks.select(F.explode(F.sequence("first", "last")).alias("i")).join(cash.select("i", "rate"), "i", "left")
    path = days.select("i", F.when(sound, F.log(growth)).otherwise(0.0).alias("step"), F.when(sound, 0).otherwise(1).alias("odd"))
    path = path.groupBy("i").agg(F.max("step").alias("step"), F.max("odd").alias("odd"), F.count("*").alias("n")).withColumn("odd", F.when(F.col("n") > 1, 1).otherwise(F.col("odd")))
    along = Window.orderBy("i")  # the calendar alone: a few thousand rows at any size of the panel
    path = path.select("i", "step", F.sum("step").over(along).alias("sum"), F.sum("odd").over(Window.partitionBy()).alias("odd"))
    rows = rows.withColumn("settled", F.coalesce(F.col("settled_at") <= F.col("last"), F.lit(False)) & ((F.col("mode") == REINVESTED) | (F.col("lag") == 0)))
    at = path.select(F.col("i").alias("settled_at"), F.col("sum").alias("_from"), F.col("step").alias("_step"))
    total = path.agg(F.max_by("sum", "i").alias("_total"), (F.max("odd") == 0).alias("_calm"))
    rows = rows.join(F.broadcast(at), "settled_at", "left").crossJoin(F.broadcast(total))
    stops = rows.filter(F.col("settled") & (F.col("lag") > 0) & (F.col("mode") == REINVESTED)).select(*run, "settled_at", "_step").distinct()
    later = Window.partitionBy(*run).orderBy(F.col("settled_at").desc())
    stops = stops.select(*run, F.col("settled_at").alias("_stop"), F.sum("_step").over(later).alias("_lost"))
    lost = rows.select(*run, "settled_at").distinct().join(stops, run).filter(F.col("_stop") > F.col("settled_at"))
    lost = lost.groupBy(*run, "settled_at").agg(F.max_by("_lost", F.struct(-F.col("_stop"))).alias("_lost"))
    rows = rows.join(lost, [*run, "settled_at"], "left")
    earns = F.col("settled") & (F.col("mode") == REINVESTED)
    log = F.col("_total") - F.col("_from") - F.coalesce("_lost", F.lit(0.0))
    net_gain = F.when(earns, F.col("net") * (F.exp(log) - 1)).otherwise(0.0)
    return rows.withColumns({"cash_gain": net_gain / (1 - cash_tax), "calm": F.col("_calm") | (F.col("mode") == FIXED)})
