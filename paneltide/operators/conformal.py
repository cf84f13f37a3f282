"""Conformal calibration, p-values and false-discovery-controlled selection over decision days.

Predictions carry (code, d, i): ``i`` is the feature position; the decision is at ``i + 1`` and a
label matures 23 positions after its features, so a decision at position D uses rows with
``D - 149 <= i <= D - 23``.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.functions.stats import ordered_ends, pinball
from paneltide.functions.text import join_flags
from paneltide.operators import joins, windows as w

DELAY, WINDOW, LEAST = 23, 126, 200


def matured_pairs(decisions: DataFrame, scored: DataFrame, delay: int = DELAY, window: int = WINDOW) -> DataFrame:
    """(decision position D) x (rows matured inside its window), by a block join: both ends inclusive."""
    rows = scored.select(F.col("i").alias("t"), *[F.col(c) for c in scored.columns if c != "i"])
    return joins.position_range(decisions, rows, "at", delay + window, delay, "t")


def baseline_quantile(panel: DataFrame, alpha: float = 0.5, n: int = 252, least: int = 63, delay: int = 22) -> DataFrame:
    """Trailing empirical quantile of the label as it could be known: the window ends ``delay`` rows back."""
    q = panel.withColumn("_q", w.rolling_quantile(alpha, n, least, delay))
    return q.withColumn("q", w.delayed("_q", delay)).drop("_q")


def score_cqr(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.greatest(F.col("q10") - F.col("y"), F.col("y") - F.col("q90")))


def fixed_alpha(predictions: DataFrame, alpha: float, least: int = LEAST) -> DataFrame:
    """Conformal intervals with a constant level: lower, upper, n_calib, quality_flag for every prediction."""
    scored = score_cqr(predictions).filter(F.col("score").isNotNull()).select("i", "score")
    days = predictions.select((F.col("i") + 1).alias("at")).distinct()
    pairs = matured_pairs(days, scored)
    stat = w.order_statistic(pairs, "at", "score", alpha, least)
    out = predictions.withColumn("at", F.col("i") + 1).join(F.broadcast(stat), "at", "left")
    return _interval(out, F.lit(alpha), least)


def _interval(out: DataFrame, alpha: Column, least: int) -> DataFrame:
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    crossing = F.coalesce(F.col("q10") > F.col("q90"), F.lit(False))
    few = n < least
    low, high = F.col("q10") - F.col("s"), F.col("q90") + F.col("s")
    a, b = ordered_ends(low, high)
    flag = join_flags((few, "insufficient_calibration"), (~few & (F.col("k") > F.col("n")), "k_gt_n"), (crossing, "crossing"))
    return out.select("code", "d", "i", "at", "q10", "q50", "q90", "y", F.when(crossing, a).otherwise(low).alias("lower"), F.when(crossing, b).otherwise(high).alias("upper"), alpha.alias("alpha_D"), n.alias("n_calib"), flag.alias("quality_flag"))


def adaptive(predictions: DataFrame, targets: dict[str, float], gamma: float, least: int = LEAST, window: int = WINDOW, delay: int = DELAY) -> DataFrame:
    """Intervals with the level moved by each day's matured misses: one sequential group for each ``config``.

    A configuration is sequential in time by nature (its errors feed its level), so configurations
    are the parallel axis. ``targets``: miss rate by config; ``predictions``: config, code, d, i, q10, q50, q90, y.
    """
    schema = "config string, code string, d date, i bigint, lower double, upper double, alpha_D double, n_calib bigint, quality_flag string"

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = g.sort_values(["i", "code"]).reset_index(drop=True)
        g["score"] = np.maximum(g["q10"] - g["y"], g["y"] - g["q90"])
        days = {int(i): rows.index.to_numpy() for i, rows in g.groupby("i")}
        scores = {i: np.sort(g["score"].to_numpy()[rows][~np.isnan(g["score"].to_numpy()[rows])]) for i, rows in days.items()}
        lower, upper = np.full(len(g), np.nan), np.full(len(g), np.nan)
        alphas, counts, flags = np.zeros(len(g)), np.zeros(len(g), np.int64), np.empty(len(g), object)
        alpha = target = targets[key[0]]
        q10, q90, y = (g[c].to_numpy() for c in ("q10", "q90", "y"))
        for i in sorted(days):
            D, rows = i + 1, days[i]
            past = [scores[t] for t in range(D - delay - window, D - delay + 1) if t in scores and len(scores[t])]
            have = np.sort(np.concatenate(past)) if past else np.zeros(0)
            n = len(have)
            k = int(np.ceil(round((n + 1) * (1 - alpha), 9)))
            problem = "insufficient_calibration" if n < least else "k_gt_n" if k > n else ""
            cross = q10[rows] > q90[rows]
            if not problem:
                a, b = q10[rows] - have[k - 1], q90[rows] + have[k - 1]
                swap = cross & (a > b)
                lower[rows], upper[rows] = np.where(swap, b, a), np.where(swap, a, b)
            alphas[rows], counts[rows] = alpha, n
            flags[rows] = ["+".join(x for x in (problem, "crossing" if c else "") if x) or "ok" for c in cross]
            old = days.get(D - delay)
            if old is not None:
                ok = ~np.isnan(lower[old]) & ~np.isnan(y[old])
                if ok.any():
                    missed = ((y[old][ok] < lower[old][ok]) | (y[old][ok] > upper[old][ok])).mean()
                    alpha = float(np.clip(alpha + gamma * (target - missed), 0.02, 0.5))
        out = g[["code", "d", "i"]].copy()
        out.insert(0, "config", key[0])
        return out.assign(lower=lower, upper=upper, alpha_D=alphas, n_calib=counts, quality_flag=flags)

    return predictions.groupBy("config").applyInPandas(run, schema)


def alpha_path(errors: DataFrame, target: float, gamma: float, by: str = "code", low: float = 0.02, high: float = 0.5) -> DataFrame:
    """(by, i, alpha): the clipped recursion over given daily errors, one step a day; a missing error leaves it as it is."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        alpha, path = float(target), []
        for err in g["err"].to_numpy(float):
            alpha = alpha if pd.isna(err) else min(max(alpha + gamma * (target - err), low), high)
            path.append(alpha)
        return pd.DataFrame({by: key[0], "i": g["i"].to_numpy(), "alpha": path})

    slim = errors.select(by, F.col("i").cast("bigint").alias("i"), F.col("err").cast("double").alias("err"))
    return slim.groupBy(by).applyInPandas(run, f"{by} {slim.schema[by].dataType.simpleString()}, i bigint, alpha double")


def p_values(predictions: DataFrame, clipped: bool = False, least: int = LEAST) -> DataFrame:
    """p = (1 + #{V <= -q50}) / (n + 1) over the matured residuals V = y - q50 of each decision day.

    The residuals of a day are one sorted array, so a prediction counts by its place in it: pairs
    of predictions and residuals are never made.
    """
    v = F.when(F.lit(clipped) & (F.col("y") > 0), F.lit(float("inf"))).otherwise(F.col("y") - F.col("q50"))
    residuals = predictions.withColumn("v", v).filter(F.col("y").isNotNull() & F.col("q50").isNotNull()).select("i", "v")
    days = predictions.select((F.col("i") + 1).alias("at")).distinct()
    # Ranks among residuals and thresholds together give the counts by one window over each day.
    marks = predictions.select((F.col("i") + 1).alias("at"), "code", (-F.col("q50")).alias("v"), F.lit(1).alias("mark")).filter(F.col("v").isNotNull())
    both = matured_pairs(days, residuals).select("at", F.lit(None).cast("string").alias("code"), "v", F.lit(0).alias("mark")).unionByName(marks)
    run = Window.partitionBy("at").orderBy("v", "mark").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("below", F.sum(F.lit(1) - F.col("mark")).over(run)).withColumn("n", F.sum(F.lit(1) - F.col("mark")).over(Window.partitionBy("at"))).filter("mark = 1").select("at", "code", "below", "n")
    totals = matured_pairs(days, residuals.groupBy("i").agg(F.count("*").alias("_n"))).groupBy("at").agg(F.sum("_n").alias("n_day"))
    out = predictions.withColumn("at", F.col("i") + 1).join(counted, ["at", "code"], "left").join(F.broadcast(totals), "at", "left")
    n = F.coalesce("n_day", F.lit(0)).cast("bigint")
    flag = F.when(n < least, "insufficient_calibration").when(F.col("q50").isNull(), "missing_q50").otherwise("ok")
    p = F.when(flag == "ok", (F.col("below") + 1) / (n + 1))
    return out.select("code", "d", "i", "at", "q50", p.alias("p_value"), n.alias("n_calib"), flag.alias("quality_flag"))


def select_bh(scored: DataFrame, levels: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    return scored.select("*", *[w.step_up("p_value", q, by="at").alias(f"selected_q{round(q * 100)}") for q in levels])


def coverage(intervals: DataFrame, period: str = "month") -> DataFrame:
    """(period, coverage, n, width) of rows with an interval and a label."""
    inside = F.when((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper")), 1.0).otherwise(0.0)
    rows = intervals.filter(F.col("y").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull())
    return rows.groupBy(F.trunc("d", period).alias("period")).agg(F.avg(inside).alias("coverage"), F.count("*").alias("n"), F.avg(F.col("upper") - F.col("lower")).alias("width"))


def coverage_series(intervals: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Coverage by series (all, positive lower end, top n by lower end of the day, random n of the day) and month, then the mean of months.

    A row joins all its series by one explode, so the four filters share one pass.
    """
    rows = intervals.filter(F.col("y").isNotNull() & F.col("lower").isNotNull())
    top = F.row_number().over(Window.partitionBy("d").orderBy(F.col("lower").desc(), "code"))
    rand = F.row_number().over(Window.partitionBy("d").orderBy(F.crc32(F.concat_ws("|", F.lit(seed), "code", F.col("d").cast("string"))), "code"))
    tagged = rows.withColumn("_t", top).withColumn("_r", rand)
    member = F.array_compact(F.array(F.lit("all"), F.when(F.col("lower") > 0, "positive"), F.when(F.col("_t") <= n, "top"), F.when(F.col("_r") <= n, "random")))
    inside = F.when((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper")), 1.0).otherwise(0.0)
    month = tagged.withColumn("series", F.explode(member)).groupBy("series", F.trunc("d", "month").alias("month")).agg(F.avg(inside).alias("c"), F.count("*").alias("m"), F.avg(F.col("upper") - F.col("lower")).alias("w"))
    return month.groupBy("series").agg(F.avg("c").alias("coverage"), F.avg("w").alias("width"), F.count("*").alias("months"), F.sum("m").alias("n"))


def diagnostics(intervals: DataFrame, target: float) -> DataFrame:
    """One row: coverage, gap to target, share of flagged rows, level range as issued and of (last, target)."""
    inside = F.when((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper")), 1.0).otherwise(0.0)
    have = F.col("y").isNotNull() & F.col("lower").isNotNull()
    last = F.max_by("alpha_D", "i")
    return intervals.agg(
        F.avg(F.when(have, inside)).alias("coverage"), (F.avg(F.when(have, inside)) - (1 - target)).alias("gap"), F.count_if(have).alias("n"), F.avg((F.col("quality_flag") != "ok").cast("double")).alias("flagged"),
        F.min("alpha_D").alias("path_min"), F.max("alpha_D").alias("path_max"), F.least(last, F.lit(target)).alias("ends_min"), F.greatest(last, F.lit(target)).alias("ends_max"),
    )


def kill_switch(predictions: DataFrame, model: dict[float, str], baseline: dict[float, str]) -> DataFrame:
    """(D, model_loss, baseline_loss, stop): mean pinball loss over matured rows, stop where the model is no better."""
    loss = lambda cols: sum((pinball(F.col("y"), F.col(c), a) for a, c in cols.items()), F.lit(0.0)) / len(cols)
    rows = predictions.filter(F.col("y").isNotNull()).select("i", loss(model).alias("_m"), loss(baseline).alias("_b")).filter(F.col("_m").isNotNull() & F.col("_b").isNotNull())
    days = predictions.select((F.col("i") + 1).alias("at")).distinct()
    # Days go to the decision days that they have matured for, not their rows.
    by_day = rows.groupBy("i").agg(F.sum("_m").alias("_m"), F.sum("_b").alias("_b"), F.count("*").alias("_n"))
    mean = lambda c: F.sum(c) / F.sum("_n")
    out = matured_pairs(days, by_day).groupBy("at").agg(mean("_m").alias("model_loss"), mean("_b").alias("baseline_loss"))
    return days.join(out, "at", "left").select("at", "model_loss", "baseline_loss", F.coalesce(F.col("model_loss") >= F.col("baseline_loss"), F.lit(False)).alias("stop"))


def rank_ic(df: DataFrame, score: str, y: str = "y", least: int = 5) -> DataFrame:
    """(d, n, ic): Spearman correlation by day; days with too few rows or without variance are left out."""
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("_a", w.average_rank(score)).withColumn("_b", w.average_rank(y))
    day = ranked.groupBy("d").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("ic"), F.stddev_pop("_a").alias("_u"), F.stddev_pop("_b").alias("_v"))
    return day.filter((F.col("n") >= least) & (F.col("_u") > 0) & (F.col("_v") > 0)).select("d", "n", "ic")


