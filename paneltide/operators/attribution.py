"""Where a coverage gap comes from: coverage by period and series, and the gap split into parts that add up to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SERIES = ("all", "positive", "random", "top")
INSIDE, OUTSIDE = "selection", "outside"


def _means(rows: DataFrame, keys: list[str]) -> DataFrame:
    covered = F.avg(((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double"))
    return rows.groupBy(*keys).agg(covered.alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"), F.count("*").alias("n"))


def monthly(intervals: DataFrame, select_end: str, n: int = 10, seed: int = 0) -> DataFrame:
    """(series, period, month, coverage, width, n) of the labelled intervals of each series.

    ``intervals``: code, d, y, lower, upper. Series: all; positive (lower end over zero: the candidates); of a day's candidates, labelled
    or not, the ``n`` of the largest lower ends (ties by code); ``n`` drawn by a hash of seed, code and day. Period: ``selection`` up to
    ``select_end``, ``outside`` after it. Null or NaN ends or labels count nowhere; a day without candidates is in ``all`` alone.
    One pass: a row goes to its series by an explode, and a day's ranks share one partitioning.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = intervals.select("code", "d", "y", "lower", "upper").filter(number("lower") & number("upper"))
    candidate = F.col("lower") > 0
    day = Window.partitionBy("d", "_candidate")
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "code", F.col("d").cast("string")))
    ranked = rows.withColumn("_candidate", candidate).withColumn("_drawn", drawn)
    ranked = ranked.withColumn("_top", F.row_number().over(day.orderBy(F.col("lower").desc(), "code"))).withColumn("_random", F.row_number().over(day.orderBy("_drawn", "code")))
    held = (F.lit(True), candidate, candidate & (F.col("_random") <= n), candidate & (F.col("_top") <= n))
    series = F.array_compact(F.array(*[F.when(h, F.lit(s)) for s, h in zip(SERIES, held)]))
    period = F.when(F.col("d") <= F.lit(select_end).cast("date"), INSIDE).otherwise(OUTSIDE)
    labelled = ranked.filter(number("y")).select(F.explode(series).alias("series"), period.alias("period"), F.trunc("d", "month").alias("month"), "y", "lower", "upper")
    return _means(labelled, ["series", "period", "month"])


def by_period(cells: DataFrame, *extra: str) -> DataFrame:
    """(series, period, coverage, width, months, n): means of the months' means by period and, as period ``both``, over all months.

    ``extra`` names further keys of the cells, such as the run.
    """
    keys = [*extra, "series"]
    sets = cells.groupingSets([[*keys, "period"], keys], *[F.col(c) for c in [*keys, "period"]])
    out = sets.agg(F.avg("coverage").alias("coverage"), F.avg("width").alias("width"), F.count("*").alias("months"), F.sum("n").alias("n"))
    return out.withColumn("period", F.coalesce("period", F.lit("both")))


def gap_parts(issued: DataFrame, constant: DataFrame, target: float, select_end: str, n: int = 10, seed: int = 0, least_months: int = 6) -> DataFrame:
    """One row for each period (selection, outside, both): the coverage gap of the top series and its parts.

    ``issued``: the intervals as they were given out; ``constant``: the same predictions with the level held at ``target`` (the rate of
    misses). ``gap`` = coverage of top - (1 - target) is the sum of ``base`` (all rows against the nominal coverage), ``pool`` (random
    candidates against all rows) and ``ranking`` (top against random candidates). ``level`` is what the moving level adds to the top
    series against the constant one; it is not a further summand. ``dominant`` names the largest of pool, ranking and level
    by size (the first of them on ties); null parts count as absent. ``few`` says that the constant run has fewer than ``least_months``
    months, so that the level part says little. A series without rows makes its parts null.
    """
    runs = [monthly(x, select_end, n, seed).withColumn("run", F.lit(name)) for name, x in (("issued", issued), ("constant", constant))]
    means = by_period(reduce(DataFrame.unionByName, runs), "run")
    at = lambda run, series, c: F.max(F.when((F.col("run") == run) & (F.col("series") == series), F.col(c)))
    wide = means.groupBy("period").agg(
        *[at("issued", s, "coverage").alias(f"_{s}") for s in ("all", "random", "top")], at("constant", "top", "coverage").alias("_constant"),
        at("issued", "top", "width").alias("width"), at("constant", "top", "width").alias("constant_width"), F.coalesce(at("constant", "top", "months"), F.lit(0)).alias("constant_months"),
    )
    nominal = F.lit(1 - target)
    parts = {"pool": F.col("_random") - F.col("_all"), "ranking": F.col("_top") - F.col("_random"), "level": F.col("_top") - F.col("_constant")}
    out = wide.select("period", (F.col("_top") - nominal).alias("gap"), (F.col("_all") - nominal).alias("base"), *[p.alias(k) for k, p in parts.items()], "width", "constant_width", "constant_months")
    return out.withColumn("dominant", _largest(list(parts))).withColumn("few", F.col("constant_months") < least_months)


def _largest(names: list[str]) -> Column:
    """Name of the column of the largest absolute value, compared to 12 decimal places, the first on ties; null where all are null."""
    size = {c: F.coalesce(F.round(F.abs(c), 12), F.lit(-1.0)) for c in names}
    most = F.greatest(*size.values())
    return F.coalesce(*[F.when((size[c] == most) & (most >= 0), F.lit(c)) for c in names])
