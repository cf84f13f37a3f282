"""Operational statistics: runs, coverage of calendars, fill lags, reconciliation, weekly comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run of each kind and day, and how many there were."""
    day = F.to_date("started_at")
    w = Window.partitionBy("kind", day)
    ranked = runs.withColumn("day", day).withColumn("_k", F.row_number().over(w.orderBy(F.col("started_at").desc(), F.col("run_id").desc()))).withColumn("n", F.count("*").over(w))
    return ranked.filter("_k = 1").drop("_k")


def daily_coverage(last: DataFrame, calendar: DataFrame) -> DataFrame:
    """(kind, expected, observed, missing, ok_ratio) over the days of a calendar."""
    days = F.broadcast(calendar.select(F.col("d").alias("day")))
    expected = calendar.agg(F.count("*").alias("expected"))
    seen = last.join(days, "day").groupBy("kind").agg(F.countDistinct("day").alias("observed"), F.countDistinct(F.when(F.col("status") != "failed", F.col("day"))).alias("_ok"))
    return seen.crossJoin(expected).select("kind", "expected", "observed", (F.col("expected") - F.col("observed")).alias("missing"), (F.col("_ok") / F.col("expected")).alias("ok_ratio"))


def success_gate(coverage: DataFrame, least: float = 0.95, least_days: int = 28) -> DataFrame:
    """Adds ``ready``: null until enough days are expected, then whether the ratio reaches ``least``."""
    return coverage.withColumn("ready", F.when(F.col("expected") >= least_days, F.col("ok_ratio") >= least))


def summaries(runs: DataFrame, schema: str) -> DataFrame:
    return runs.withColumn("s", F.from_json("summary", schema))


def fill_lag(proposals: DataFrame, fills: DataFrame) -> DataFrame:
    """(median_lag, n): days from each proposal to its first fill."""
    first = fills.groupBy("id").agg(F.min("fill_day").alias("_f"))
    lag = proposals.join(first, "id").select(F.datediff("_f", "day").cast("double").alias("lag"))
    return lag.agg(F.percentile("lag", F.lit(0.5)).alias("median_lag"), F.count("*").alias("n"))


def late_training(rows: DataFrame, train_max: str, decision: str, delay: int = 23) -> DataFrame:
    """Rows whose newest training position is unknown or too close to their decision."""
    return rows.filter(F.col(train_max).isNull() | (F.col(train_max) > F.col(decision) - delay))


def tracking(rows: DataFrame, by: str) -> DataFrame:
    """Compounded return of both series, their difference, and whether the comparison is valid (both present on all rows, two at least)."""
    growth = lambda c: F.exp(F.sum(F.log1p(c))) - 1
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"), growth("a").alias("ret_a"), growth("b").alias("ret_b"))
    status = F.when(F.col("n") < 2, "too_short").when(F.col("missing") > 0, "missing").otherwise("ok")
    return out.select(by, "n", status.alias("status"), F.when(status == "ok", F.col("ret_a") - F.col("ret_b")).alias("difference"))


def reconcile(targets: DataFrame, actuals: DataFrame, key: str, weight: str, tolerance: float = 1e-6) -> DataFrame:
    """(max_diff, n, within): largest gap between target and actual weights over all keys of either side."""
    from paneltide.operators.joins import aligned

    both = aligned(targets, actuals, key, weight, ("t", "a"))
    gap = F.max(F.abs(F.col("t") - F.col("a")))
    return both.agg(gap.alias("max_diff"), F.count("*").alias("n"), (F.coalesce(gap, F.lit(0.0)) <= tolerance).alias("within"))


def episode_gate(rows: DataFrame, least: int = 3, share: float = 2 / 3) -> DataFrame:
    """(key, episodes, rate, ready): mean over episodes of the share of matured positive labels."""
    from paneltide.operators.windows import episodes

    e = episodes(rows).groupBy("code", "episode").agg(F.avg(F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("double"))).alias("hit"))
    out = e.filter(F.col("hit").isNotNull()).groupBy("code").agg(F.count("*").alias("episodes"), F.avg("hit").alias("rate"))
    return out.withColumn("ready", (F.col("episodes") >= least) & (F.col("rate") >= share))


def components_difference(before: DataFrame, after: DataFrame, key: str = "date") -> DataFrame:
    """Value, cash and receivables of two states side by side; internal moves change parts but not the sum."""
    total = lambda p: F.col(f"{p}.fund_value") + F.col(f"{p}.cash") + F.col(f"{p}.receivables")
    return before.alias("a").join(after.alias("b"), key).select(key, total("a").alias("before"), total("b").alias("after"), (total("b") - total("a")).alias("difference"))


def weekly_excess(equity: DataFrame, base: str, start) -> DataFrame:
    """(portfolio, n, ret, excess, latest): log return over the days since ``start`` that a portfolio shares with ``base``, and over its own.

    ``equity``: portfolio, d, equity, one row for each day. Portfolios with fewer than two shared days are left out; ``latest`` is the
    last equity of all days.
    """
    own = equity.filter(F.col("portfolio") != base)
    other = equity.filter(F.col("portfolio") == base).select("d", F.col("equity").alias("_b"))
    growth = lambda c: F.ln(F.max_by(c, "d") / F.min_by(c, "d"))
    shared = own.filter(F.col("d") >= start).join(other, "d").groupBy("portfolio").agg(F.count("*").alias("n"), growth("equity").alias("ret"), growth("_b").alias("_r"))
    latest = own.groupBy("portfolio").agg(F.max_by("equity", "d").alias("latest"))
    return shared.filter("n >= 2").join(latest, "portfolio").select("portfolio", "n", "ret", (F.col("ret") - F.col("_r")).alias("excess"), "latest")


def trailing_basket(returns: DataFrame, windows: tuple[int, ...] = (21, 63, 126)) -> DataFrame:
    """One row, ``ret_<rows>``: log return of the last rows of a daily basket (i, r); null where it has fewer rows."""
    back = returns.withColumn("_k", F.row_number().over(Window.orderBy(F.col("i").desc())))
    last = lambda n: F.when(F.count("*") >= n, F.sum(F.when(F.col("_k") <= n, F.log1p("r"))))
    return back.agg(*[last(n).alias(f"ret_{n}") for n in windows])
