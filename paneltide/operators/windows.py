"""Windowed operators on a dense grid of entity (``code``) and position (``i``), long form.

All frames count grid rows: a k-day return spans k rows, observed or not. Every function adds
columns, so several of them share one shuffle by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.stats import log

ANNUAL = 252.0


def by_entity() -> Window:
    return Window.partitionBy("code").orderBy("i")


def trailing(n: int) -> Window:
    return by_entity().rowsBetween(-(n - 1), 0)


def to_date() -> Window:
    return by_entity().rowsBetween(Window.unboundedPreceding, 0)


def dense_grid(observed: DataFrame, calendar: DataFrame, value: str = "price") -> DataFrame:
    """Every entity on every day of the calendar; days without an observation have null."""
    codes = observed.select("code").distinct()
    return codes.crossJoin(F.broadcast(calendar)).join(observed.select("code", "d", value), ["code", "d"], "left").select("code", "d", "i", value)


def fill_forward(c: str = "price") -> Column:
    return F.last(c, ignorenulls=True).over(to_date())


def since_last(c: str = "price") -> Column:
    """Rows since the last observation; null before the first."""
    return F.col("i") - F.max(F.when(F.col(c).isNotNull(), F.col("i"))).over(to_date())


def log_return(k: int, c: str = "price") -> Column:
    p = log(F.col(c))
    return p - F.lag(p, k).over(by_entity())


def full_window(n: int, value: Column, aggregate: Column, least: int | None = None) -> Column:
    """A trailing aggregate where at least ``least`` (all n by default) values are present."""
    return F.when(F.count(value).over(trailing(n)) >= (least or n), aggregate.over(trailing(n)))


def rolling_vol(n: int, r: str = "r", annual: bool = True) -> Column:
    return full_window(n, F.col(r), F.stddev_samp(r)) * F.lit(ANNUAL**0.5 if annual else 1.0)


def ewma_vol(r: str = "r", decay: float = 0.94, least: int = 21, block: int = 2048) -> Column:
    """Annual volatility from exponentially weighted squared returns. Missing returns age the weights and carry the value.

    Sums are prefix sums with weights that grow by row, within blocks of rows so that they stay finite, plus the block
    before, whose weights the block's length has aged. What is older weighs less than 1e-55 of it; where the rows of
    both blocks hold no return at all, the value is null.
    """
    at = F.floor(F.col("i") / block)
    weight = F.when(F.col(r).isNotNull(), F.pow(F.lit(1.0 / decay), (F.col("i") - at * block).cast("double")))
    here = Window.partitionBy("code", at).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code").orderBy(at).rangeBetween(-1, -1)
    total = lambda v: F.coalesce(F.sum(v).over(here), F.lit(0.0)) + F.coalesce(F.sum(v).over(before), F.lit(0.0)) * F.lit(decay**block)
    return F.when(F.count(r).over(to_date()) >= least, F.sqrt(F.try_divide(total(F.col(r) * F.col(r) * weight), total(weight)) * ANNUAL))


def below_peak(n: int, c: str = "price") -> Column:
    """Price over its trailing peak, less one, where the window is full."""
    return F.when(F.count(c).over(trailing(n)) >= n, F.col(c) / F.max(c).over(trailing(n)) - 1)


def worst_below_peak(n: int, c: str = "below") -> Column:
    return full_window(n, F.col(c), F.min(c))


def partial_mean(n: int, least: int, c: str) -> Column:
    return full_window(n, F.col(c), F.avg(c), least)


def percentile_rank(value: str, among: Column, day: str = "d") -> Column:
    """Average-tie rank over the number of values of the day, among the rows where ``among`` holds."""
    v = F.when(among, F.col(value))
    day_w, tie = Window.partitionBy(day), Window.partitionBy(day, v)
    rank = F.rank().over(day_w.orderBy(v.asc_nulls_last())) + (F.count(v).over(tie) - 1) / 2
    return F.when(v.isNotNull(), rank / F.count(v).over(day_w))


def average_rank(value: str, day: str = "d") -> Column:
    """Rank of the day with ties at their average; null for null."""
    v = F.col(value)
    rank = F.rank().over(Window.partitionBy(day).orderBy(v.asc_nulls_last())) + (F.count(v).over(Window.partitionBy(day, v)) - 1) / 2
    return F.when(v.isNotNull(), rank)


def running_log_growth(rate: str) -> Column:
    return F.sum(F.log1p(F.coalesce(F.col(rate), F.lit(0.0)))).over(to_date())


def forward_label(c: str = "price", cash: str = "cash_sum", horizon: int = 22, start: int = 1) -> Column:
    """Log return from ``start`` to ``horizon`` rows ahead over the cash return of the same rows."""
    w, p = by_entity(), log(F.col(c))
    return F.lead(p, horizon).over(w) - F.lead(p, start).over(w) - (F.lead(cash, horizon).over(w) - F.lead(cash, start).over(w))


def momentum(skip: int = 21, look: int = 252, share: float = 0.9, c: str = "price") -> Column:
    """Log return from ``look`` rows ago to ``skip`` rows ago, where enough of the window is present."""
    w, p = by_entity(), log(F.col(c))
    return F.when(F.count(c).over(trailing(look)) >= share * look, F.lag(p, skip).over(w) - F.lag(p, look).over(w))


def jumps(limit: float = 0.25, c: str = "price") -> Column:
    return F.coalesce(F.abs(log_return(1, c)) > limit, F.lit(False))


def running_peak(c: str) -> Column:
    return F.max(c).over(to_date())


def rolling_quantile(alpha: float, n: int, least: int, delay: int, c: str = "y") -> Column:
    """Exact trailing quantile (linear between order statistics), as it stood ``delay`` rows ago."""
    q = F.when(F.count(c).over(trailing(n)) >= least, F.percentile(c, F.lit(alpha)).over(trailing(n)))
    return q


def delayed(c: str, k: int) -> Column:
    return F.lag(c, k).over(by_entity())


def changes_only(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null counts as a value); the first row stays."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", F.lag(value).over(w)).filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def order_statistic(df: DataFrame, by: str, value: str, alpha: float, least: int) -> DataFrame:
    """The k-th smallest value of each group, k = ceil((n + 1)(1 - alpha)); null and a flag where there are too few."""
    ranked = df.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(value)))
    ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    k = F.ceil(F.round((F.col("_n") + 1) * F.lit(1 - alpha), 9)).cast("bigint")
    out = ranked.withColumn("_want", k).groupBy(by).agg(F.max("_n").alias("n"), F.max("_want").alias("k"), F.max(F.when(F.col("_k") == F.col("_want"), F.col(value))).alias("_s"))
    flag = F.when(F.col("n") < least, "insufficient_calibration").when(F.col("k") > F.col("n"), "k_gt_n").otherwise("ok")
    return out.select(by, "n", "k", F.when(flag == "ok", F.col("_s")).alias("s"), flag.alias("flag"))


def step_up(p: str, q: float, by: str = "d", tie: str = "code") -> Column:
    """Benjamini-Hochberg: whether a row's p-value is at or below the largest p(k) with p(k) <= k q / m of its day."""
    v = F.col(p)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(v.asc_nulls_last(), tie))
    m = F.count(v).over(Window.partitionBy(by))
    cut = F.max(F.when(v <= rank * F.lit(q) / m, rank)).over(Window.partitionBy(by))
    return F.coalesce(v.isNotNull() & (rank <= cut), F.lit(False))


def episodes(df: DataFrame, key: str = "code", position: str = "i") -> DataFrame:
    """Numbers runs of consecutive positions: adds ``episode``, constant within a run."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("episode", F.col(position) - F.row_number().over(w))
