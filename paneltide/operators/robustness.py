"""Performance and robustness statistics."""

from __future__ import annotations

from itertools import combinations
from math import e, sqrt

from pyspark.sql import DataFrame, Window, functions as F

from paneltide.functions.stats import normal_cdf, normal_quantile

EULER = 0.5772156649


def summary(equity: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, n, cagr, vol, sharpe, sortino, mdd, calmar, skew, kurt, cash_cagr, excess_cagr) of (by, i, equity, cash_level). A run of one row has n 0, mdd 0 and nulls."""
    w = Window.partitionBy(by).orderBy("i")
    r = F.ln("equity") - F.lag(F.ln("equity")).over(w)
    x = equity.withColumn("r", r).withColumn("ex", F.col("r") - (F.ln("cash_level") - F.lag(F.ln("cash_level")).over(w)))
    x = x.withColumn("dd", 1 - F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    years = F.count("r") / 252
    growth = lambda c: F.pow(F.max_by(c, "i") / F.min_by(c, "i"), F.try_divide(F.lit(1.0), years)) - 1
    out = x.groupBy(by).agg(
        F.count("r").alias("n"), growth("equity").alias("cagr"), (F.stddev_samp("r") * sqrt(252)).alias("vol"),
        (F.try_divide(F.avg("ex"), F.stddev_samp("ex")) * sqrt(252)).alias("sharpe"),
        (F.try_divide(F.avg("ex"), F.stddev_samp(F.when(F.col("ex") < 0, F.col("ex")))) * sqrt(252)).alias("sortino"),
        F.max("dd").alias("mdd"), F.when(F.count("ex") > 3, F.skewness("ex")).alias("skew"), F.when(F.count("ex") > 3, F.kurtosis("ex") + 3).alias("kurt"), growth("cash_level").alias("cash_cagr"),
    )
    return out.withColumn("calmar", F.try_divide("cagr", "mdd")).withColumn("excess_cagr", F.col("cagr") - F.col("cash_cagr"))


def by_period(equity: DataFrame, periods: DataFrame, by: str = "run_id") -> DataFrame:
    """:func:`summary` of each period by itself, with ``period``. ``periods``: period, first, last (days, both inside; null: open).

    A few rows of periods, which may overlap. A slice begins with its own first row: the return into it does not count, nor an earlier peak.
    A run without rows in a period, or with a null day, has none there.
    """
    inside = (F.col("d") >= F.coalesce("first", F.col("d"))) & (F.col("d") <= F.coalesce("last", F.col("d")))
    cut = equity.join(F.broadcast(periods), inside).withColumn("_slice", F.struct("period", by))
    return summary(cut, "_slice").select("_slice.*", "*").drop("_slice")


def cost_shares(equity: DataFrame, fills: DataFrame, by: str = "run_id", days_a_year: int = 252) -> DataFrame:
    """(by, turnover_per_year, taxes_share, fees_share): traded amount by year, and taxes and fees as shares of the last equity.

    ``equity``: by, i, equity; ``fills``: by, gross, tax, fee (null: 0). A run without fills has zeros; one of a single row no turnover by year;
    an equity of 0 at the end no shares. Fills of a run without equity are left out.
    """
    run = equity.groupBy(by).agg(F.count("equity").alias("_n"), F.max_by("equity", "i").alias("_end"))
    spent = fills.groupBy(by).agg(*[F.sum(c).alias(f"_{c}") for c in ("gross", "tax", "fee")])
    got = run.join(spent, by, "left").fillna(0.0, ["_gross", "_tax", "_fee"])
    years = (F.col("_n") - 1) / days_a_year
    return got.select(by, F.try_divide("_gross", years).alias("turnover_per_year"), F.try_divide("_tax", "_end").alias("taxes_share"), F.try_divide("_fee", "_end").alias("fees_share"))


def yearly(equity: DataFrame, by: str = "run_id") -> DataFrame:
    year = F.year("d").cast("bigint").alias("year")
    return equity.groupBy(by, year).agg((F.max_by("equity", "d") / F.min_by("equity", "d") - 1).alias("ret"))


def holdings_by_group(holdings: DataFrame, group: str = "grp") -> DataFrame:
    """Mean weight of each group over dates, and of cash as what is left."""
    day = holdings.groupBy("d", group).agg(F.sum("weight").alias("w"))
    n = holdings.agg(F.countDistinct("d").alias("n"))
    mean = day.groupBy(group).agg(F.sum("w").alias("s")).crossJoin(n).select(F.col(group).alias("grp"), (F.col("s") / F.col("n")).alias("mean_weight"))
    cash = mean.agg(F.lit("cash").alias("grp"), (1 - F.sum("mean_weight")).alias("mean_weight"))
    return mean.unionByName(cash)


def gain_by_taxed(fills: DataFrame) -> DataFrame:
    return fills.groupBy((F.col("tax") > 0).alias("taxed")).agg(F.sum("gain").alias("gain"), F.sum("tax").alias("tax"), F.count("*").alias("n"))


def start_positions(calendar: DataFrame, warm_up: int, n: int) -> DataFrame:
    """The first ``n`` month starts after the warm-up, one run each."""
    first = calendar.withColumn("_k", F.row_number().over(Window.partitionBy(F.trunc("d", "month")).orderBy("d"))).filter((F.col("_k") == 1) & (F.col("i") >= warm_up))
    return first.orderBy("i").limit(n).select(F.concat(F.lit("start-"), F.col("i").cast("string")).alias("run_id"), F.col("i").alias("start"))


def pbo(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """(splits, pbo): share of half splits of time in which the best run in sample ranks below the middle out of sample.

    Sums by (run, block) are all that splits need, so each of the C(blocks, blocks/2) splits works
    on runs x blocks numbers. ``returns``: run_id, i, r.
    """
    spark = returns.sparkSession
    ranked = returns.withColumn("b", F.ntile(blocks).over(Window.partitionBy("run_id").orderBy("i")))
    sums = ranked.groupBy("run_id", "b").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("r").alias("n"))
    combos = [(k, b) for k, c in enumerate(combinations(range(1, blocks + 1), blocks // 2)) for b in c]
    inside = spark.createDataFrame(combos, "split int, b int").withColumn("in_sample", F.lit(True))
    splits = inside.select("split").distinct()
    grid = sums.crossJoin(F.broadcast(splits)).join(F.broadcast(inside), ["split", "b"], "left").withColumn("in_sample", F.coalesce("in_sample", F.lit(False)))
    half = grid.groupBy("split", "run_id", "in_sample").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    half = half.withColumn("sr", F.round(mean / (F.sqrt(F.greatest(var, F.lit(0.0))) + 1e-12), 9))
    wide = half.groupBy("split", "run_id").agg(F.max(F.when(F.col("in_sample"), F.col("sr"))).alias("is_sr"), F.max(F.when(~F.col("in_sample"), F.col("sr"))).alias("oos_sr"))
    best = F.row_number().over(Window.partitionBy("split").orderBy(F.col("is_sr").desc(), "run_id"))
    rank = (F.rank().over(Window.partitionBy("split").orderBy("oos_sr")) - 1) / F.count("*").over(Window.partitionBy("split"))
    chosen = wide.withColumn("_best", best).withColumn("rank", rank).filter("_best = 1")
    return chosen.agg(F.count("*").alias("splits"), F.avg((F.col("rank") < 0.5).cast("double")).alias("pbo"), F.avg("rank").alias("mean_rank"))


def deflated_sharpe(sr: float, trials: int, variance: float, n: int, skew: float, kurt: float) -> float:
    """Probability that a Sharpe ratio (by period) is above what the best of so many trials would show by luck; one trial has no best."""
    if n < 2 or trials < 2:
        return float("nan")
    luck = sqrt(max(variance, 1e-12)) * ((1 - EULER) * normal_quantile(1 - 1 / trials) + EULER * normal_quantile(1 - 1 / (trials * e)))
    spread = max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)
    return normal_cdf((sr - luck) * sqrt(n - 1) / sqrt(spread))


def describe(results: DataFrame, columns: list[str]) -> DataFrame:
    """Least, median and largest value of each column over runs."""
    long = results.unpivot([], columns, "metric", "value")
    return long.groupBy("metric").agg(F.min("value").alias("least"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("largest"))


def suspended_panel(panel: DataFrame, codes: list[str], first: int, rows: int) -> DataFrame:
    """The panel with some entities without prices, and marked, for a stretch of positions."""
    hit = F.col("code").isin(codes) & F.col("i").between(first, first + rows - 1)
    return panel.withColumn("suspended", hit).withColumn("price", F.when(~hit, F.col("price")))
