"""The feature panel: macro and market series, entity windows, cross-sectional ranks, masks and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paneltide.functions.stats import clip, log
from paneltide.operators import joins, windows as w
from paneltide.operators.relational import all_present
from paneltide.schema import FEATURE_COLUMNS, RETURN_LAGS

HORIZON, START = 22, 1


def simple_returns(panel: DataFrame, fill: str = "pad", name: str = "ret", price: str = "price") -> DataFrame:
    """One-row simple returns. ``pad`` carries the last price over gaps first (a gap yields zero), ``none`` does not."""
    p = w.fill_forward(price) if fill == "pad" else F.col(price)
    out = panel.withColumn("_p", p)
    return out.withColumn(name, F.col("_p") / F.nullif(F.lag("_p").over(w.by_entity()), F.lit(0.0)) - 1).drop("_p")


def basket_return(panel: DataFrame, limit: float = 0.01) -> DataFrame:
    """(d, i, cash): equal-weight mean of clipped returns by day, null counted as zero."""
    r = simple_returns(panel)
    return r.groupBy("d", "i").agg(F.coalesce(F.avg(clip(F.col("ret"), -limit, limit)), F.lit(0.0)).alias("cash"))


def index_level(panel: DataFrame, limit: float = 0.2, breadth: float = 0.8) -> DataFrame:
    """(d, i, ret, level): equal-weight index; days on which too few entities have a return count zero."""
    r = simple_returns(panel)
    day = r.groupBy("d", "i").agg(F.avg(F.when(F.col("ret").isNotNull(), 1.0).otherwise(0.0)).alias("_b"), F.avg(clip(F.col("ret"), -limit, limit)).alias("_r"))
    day = day.withColumn("ret", F.when((F.col("_b") >= breadth) & F.col("_r").isNotNull(), F.col("_r")).otherwise(0.0))
    run = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("d", "i", "ret", F.exp(F.sum(F.log1p("ret")).over(run)).alias("level"))


def market_features(panel: DataFrame, equities: DataFrame | None = None, most_stale: int | None = None) -> DataFrame:
    """(d, i, eq_trend63, eq_trend252, eq_vol21, eq_vol63, breadth200, n_suspended) of the index, of entities over their 200-row
    mean, and of entities without a price for more than ``most_stale`` rows (by default without one on the day) that had one before.

    ``equities``: the codes (code) that make up index and breadth; all of them if not given.
    """
    part = panel if equities is None else panel.join(equities.select("code").distinct(), "code", "left_semi")
    s = index_level(part).withColumn("code", F.lit("index"))
    s = s.withColumn("_l", F.ln("level")).withColumn("r", F.col("_l") - F.lag("_l", 1).over(w.by_entity()))
    trend = lambda k: (F.col("_l") - F.lag("_l", k).over(w.by_entity())).alias(f"eq_trend{k}")
    s = s.select("d", "i", trend(63), trend(252), *[w.rolling_vol(k).alias(f"eq_vol{k}") for k in (21, 63)])
    filled = part.withColumn("_p", w.fill_forward())
    above = filled.withColumn("_m", w.partial_mean(200, 120, "_p")).withColumn("_a", F.when(F.col("_m").isNotNull() & F.col("_p").isNotNull(), (F.col("_p") > F.col("_m")).cast("double")))
    stopped = panel.withColumn("_s", w.since_last()).groupBy("d").agg(F.count_if(F.col("_s") > (most_stale or 0)).alias("n_suspended"))
    return s.join(above.groupBy("d").agg(F.avg("_a").alias("breadth200")), "d", "left").join(stopped, "d", "left")


def yearly_change(observed: DataFrame, visible: str, value: str, order: str, lag: int = 12) -> DataFrame:
    """Change over ``lag`` observations, each known from its own release."""
    run = Window.orderBy(order)
    return observed.withColumn("_y", F.col(value) / F.nullif(F.lag(value, lag).over(run), F.lit(0.0)) - 1).select(order, visible, F.col("_y").alias("yoy")).filter(F.col("yoy").isNotNull())


def macro_features(calendar: DataFrame, macro: DataFrame) -> DataFrame:
    """(d, i, policy_rate, d_policy_63, cpi_yoy, real_rate, usdtry_ret63, usdtry_vol21), each as known on the day."""
    of = lambda s: macro.filter(F.col("series") == s)
    step = lambda s, name: joins.step_function(calendar, of(s), "available_from", "value", "date").withColumnRenamed("value", name)
    yoy = joins.step_function(calendar, yearly_change(of("cpi_index"), "available_from", "value", "date"), "available_from", "yoy", "date")
    days = calendar.join(step("policy_rate", "_p"), "d").join(step("usdtry", "_x"), "d").join(yoy, "d").withColumn("code", F.lit("macro"))
    days = days.withColumn("policy_rate", F.col("_p") / 100).withColumn("_l", log(F.col("_x"))).withColumn("r", F.col("_l") - F.lag("_l").over(w.by_entity()))
    return days.select(
        "d", "i", "policy_rate", (F.col("policy_rate") - F.lag("policy_rate", 63).over(w.by_entity())).alias("d_policy_63"), F.col("yoy").alias("cpi_yoy"),
        (F.col("policy_rate") - F.col("yoy")).alias("real_rate"), (F.col("_l") - F.lag("_l", 63).over(w.by_entity())).alias("usdtry_ret63"), w.rolling_vol(21).alias("usdtry_vol21"),
    )


def entity_features(panel: DataFrame) -> DataFrame:
    """Window features and the label of every grid row (needs code, d, i, price, cash): one shuffle by entity."""
    p = panel.withColumn("cash_sum", w.running_log_growth("cash")).withColumn("r", w.log_return(1))
    out = p.select(
        "*",
        *[w.log_return(k).alias(f"log_ret_{k}") for k in RETURN_LAGS],
        *[(w.log_return(k) - (F.col("cash_sum") - F.lag("cash_sum", k).over(w.by_entity()))).alias(f"cash_excess_{k}") for k in (21, 63)],
        w.ewma_vol().alias("ewma_vol"),
        w.rolling_vol(63).alias("vol_63"),
        w.below_peak(126).alias("dd_from_peak_126"),
        w.below_peak(252).alias("dist_peak_252"),
        w.forward_label(horizon=HORIZON, start=START).alias("y"),
    )
    return out


def build(panel: DataFrame, cash: DataFrame, macro: DataFrame, market: DataFrame, attributes: DataFrame, least: int = 252, most_stale: int = 5) -> DataFrame:
    """The full panel: time, mask and feature columns and ``y``, one row for every entity and day.

    ``attributes``: code, umbrella_type_code, tax_rate, excluded. One shuffle by entity, one by day.
    """
    from paneltide.operators.universe import eligible

    f = entity_features(panel.join(F.broadcast(cash.select("d", "cash")), "d", "left"))
    f = f.withColumn("eligible_at_decision", eligible(least, most_stale))
    last = F.max("i").over(Window.partitionBy(F.lit(0)))
    cal = panel.select("d", "i").distinct().withColumn("_last", last)
    ahead = lambda k: F.lead("d", k).over(Window.orderBy("i"))
    following = F.expr("d + CASE weekday(d) WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END")
    cal = cal.select("d", F.coalesce(ahead(1), following).alias("decision_at"), ahead(HORIZON).alias("label_end"), ahead(HORIZON + 1).alias("_after"), F.max("d").over(Window.partitionBy(F.lit(0))).alias("_end"))
    terminal = F.expr("_end + CASE weekday(_end) WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END")
    cal = cal.select("d", "decision_at", "label_end", F.when(F.col("label_end").isNotNull(), F.coalesce("_after", terminal)).alias("label_available_at"))
    f = f.join(F.broadcast(cal), "d").join(F.broadcast(macro.drop("i")), "d", "left").join(F.broadcast(market.drop("i")), "d", "left").join(attributes, "code", "left")
    for k in (63, 252):
        f = f.withColumn(f"pct_rank_{k}", w.percentile_rank(f"log_ret_{k}", F.col("eligible_at_decision")))
    ready = all_present(FEATURE_COLUMNS)
    return f.select(
        F.col("d").alias("feature_asof"), F.col("code").alias("fund_code"), "decision_at", "label_end", "label_available_at",
        ready.alias("feature_ready"), F.col("label_end").isNotNull().alias("label_ready"), "eligible_at_decision",
        F.coalesce("excluded", F.lit(False)).alias("policy_today_excluded"), *FEATURE_COLUMNS, "y",
    )


def standardised(df: DataFrame, columns: list[str], train, limit: float = 3.0) -> DataFrame:
    """Columns less mean over standard deviation of the training rows, clipped, null as zero."""
    stats = df.filter(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    z = lambda c: F.coalesce(clip((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), -limit, limit), F.lit(0.0))
    return out.select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])
