"""The live cash basket: the funds that stand for cash on every decision day at once, with weights under founder limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paneltide.functions.stats import whole_days
from paneltide.functions.text import mentions
from paneltide.operators import joins
from paneltide.operators.quality import execution_masks

#: Fixed value: minutes after midnight at which a day's decision is taken; a profile published later counts from the next day.
CUTOFF_MINUTES = 9 * 60 + 15


def profiles_on(days: DataFrame, snapshots: DataFrame, minutes: int = CUTOFF_MINUTES) -> DataFrame:
    """(at, the snapshot's columns): for each day and fund, the newest snapshot that was published by the day's decision.

    A snapshot is current from the day it can be seen until one of a later date can be; such a span meets the decision days
    by month, so it is an equi-join and no fund is compared with days outside its spans. ``days``: at; ``snapshots``: one row for a
    fund_code and snapshot_date, with source_published_at (null: known with its date). A null code or date is never current.
    """
    published = F.col("source_published_at") - F.make_dt_interval(mins=F.lit(minutes))
    next_day = F.date_add(published.cast("date"), F.when(published > published.cast("date").cast("timestamp_ntz"), 1).otherwise(0))
    after = Window.partitionBy("fund_code").orderBy("snapshot_date").rowsBetween(1, Window.unboundedFollowing)
    known = snapshots.filter("fund_code IS NOT NULL AND snapshot_date IS NOT NULL").withColumn("_from", F.greatest("snapshot_date", next_day))
    last = days.agg(F.max("at").alias("_last"))
    spans = known.withColumn("_until", F.min("_from").over(after)).crossJoin(F.broadcast(last))
    spans = spans.withColumn("_to", F.coalesce(F.least(F.date_sub("_until", 1), "_last"), F.col("_last"))).filter("_from <= _to")
    months = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("INTERVAL 1 MONTH"))
    met = spans.withColumn("_month", F.explode(months)).join(days.select("at", F.trunc("at", "month").alias("_month")).distinct(), "_month")
    return met.filter(F.col("at").between(F.col("_from"), F.col("_to"))).select("at", *snapshots.columns)


def observed_until(asked: DataFrame, prices: DataFrame) -> DataFrame:
    """``asked`` (at, fund_code, ...) with n_nav, share and last_nav_date: the fund's prices up to the day, and their share of the calendar's days.

    ``prices``: fund_code, d, price, one row for a fund and day; null prices are gaps, days without any price are no days of the calendar.
    """
    there = prices.filter(F.col("price").isNotNull() & ~F.isnan("price"))
    so_far = there.withColumn("n_nav", F.count("*").over(Window.partitionBy("fund_code").orderBy("d"))).select("fund_code", F.col("d").alias("last_nav_date"), "n_nav")
    out = joins.asof_last(asked, so_far, "fund_code", "at", "last_nav_date", ["n_nav"])
    calendar = there.select("d").distinct().withColumn("_days", F.row_number().over(Window.orderBy("d")))
    asked_days = asked.select("at").distinct().withColumn("_all", F.lit(1))
    days = joins.asof_last(asked_days, calendar.withColumn("_all", F.lit(1)), "_all", "at", "d", ["_days"]).select("at", "_days")
    return out.join(days, "at").withColumn("share", F.col("n_nav") / F.col("_days")).drop("_days")


def equal_weights(members: DataFrame, founder_cap: float = 0.30, founder_funds: int = 3) -> DataFrame:
    """``members`` (at, founder, rank, ...) with weight: equal shares, in closed form under the founder limits; the rest is cash.

    Of a founder's funds the first ``founder_funds`` by rank keep their share, scaled so that together they weigh the cap at most.
    """
    day, founder = Window.partitionBy("at"), Window.partitionBy("at", F.trim("founder"))
    place = F.row_number().over(founder.orderBy("rank"))
    share = F.lit(1.0) / F.count("*").over(day)
    kept = F.least(F.count("*").over(founder), F.lit(founder_funds))
    scale = F.least(F.lit(1.0), F.lit(founder_cap) / (share * kept))
    return members.withColumn("weight", F.when(place <= founder_funds, share * scale).otherwise(0.0))


def live_baskets(
    days: DataFrame, snapshots: DataFrame, prices: DataFrame, umbrella: str, blacklist: tuple[str, ...] = (), least: float = 0.99, top: int = 5,
    first_day: str | None = None, fresh_days: int = 7, founder_cap: float = 0.30, founder_funds: int = 3,
) -> DataFrame:
    """One row for each decision day and basket fund: at, fund_code, name, founder, rank, n_nav, weight, both lags, last_nav_date.

    Everything is as of the day: the profile by :func:`profiles_on`, the prices up to it. A fund's umbrella contains ``umbrella``, its
    founder is known and not listed, its prices cover ``least`` of the days so far, its tax category is the day's most frequent one
    (ties: the smallest), its lags are whole numbers, its status is open both ways and it was fetched in the ``fresh_days`` before
    the decision. Most prices first (ties by code), ``top`` of a day. A day without such a fund has no rows. Funds null in any of
    these are left out; empty tables give no rows.
    """
    buy, sell, _ = execution_masks()
    words = [umbrella]
    current = profiles_on(days, snapshots).filter(mentions(F.col("umbrella_type"), words) & ~F.coalesce(mentions(F.col("founder"), list(blacklist)), F.lit(False)))
    rows = observed_until(current, prices).filter(F.col("share") >= least)
    common = rows.filter("tax_category IS NOT NULL").groupBy("at", "tax_category").count()
    common = common.groupBy("at").agg(F.min_by("tax_category", F.struct(-F.col("count"), "tax_category")).alias("_mode"))
    rows = rows.join(common, "at").filter(F.col("tax_category") == F.col("_mode"))
    moment = F.col("at").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(CUTOFF_MINUTES))
    fresh = F.col("last_success_at").between(moment - F.make_dt_interval(F.lit(fresh_days)), moment)
    rows = rows.filter((F.trim("founder") != "") & (F.trim("tax_category") != "") & whole_days(F.col("buy_valor")) & whole_days(F.col("sell_valor")) & buy & sell & fresh)
    if first_day:
        rows = rows.filter((F.col("snapshot_date") >= F.lit(first_day).cast("date")) & (F.col("at") >= F.lit(first_day).cast("date")))
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.col("n_nav").desc(), "fund_code"))
    members = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return equal_weights(members, founder_cap, founder_funds).select("at", "fund_code", "name", "founder", "rank", "n_nav", "weight", "buy_valor", "sell_valor", "last_nav_date")
