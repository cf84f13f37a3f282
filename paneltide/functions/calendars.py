"""Calendars: trading-day positions and configured business days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def trading_calendar(panel: DataFrame, day: str = "d") -> DataFrame:
    """(day, i): the panel's distinct days with their positions. A calendar has a few thousand rows at any panel size."""
    return panel.select(day).distinct().withColumn("i", (F.row_number().over(Window.orderBy(day)) - 1).cast("bigint"))


def business_days(spark: SparkSession, first: date, last: date, holidays: list[date] = ()) -> DataFrame:
    """(d, bd): Mondays to Fridays that are no holidays, with a running number from 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d")).filter(F.weekday("d") < 5)
    if holidays:
        days = days.filter(~F.col("d").isin(*holidays))
    return days.withColumn("bd", (F.row_number().over(Window.orderBy("d")) - 1).cast("bigint"))


def with_index(days: DataFrame, calendar: DataFrame, day: str, name: str) -> DataFrame:
    """Adds ``name``: how many business days lie before ``day``. Differences of it count business days between dates."""
    spine = calendar.agg(F.array_sort(F.collect_list("d")).alias("_all"))
    return days.crossJoin(F.broadcast(spine)).withColumn(name, F.size(F.filter("_all", lambda x: x < F.col(day))).cast("bigint")).drop("_all")


def next_business_day(days: DataFrame, calendar: DataFrame, day: str, name: str = "next_day") -> DataFrame:
    spine = calendar.agg(F.array_sort(F.collect_list("d")).alias("_all"))
    return days.crossJoin(F.broadcast(spine)).withColumn(name, F.array_min(F.filter("_all", lambda x: x > F.col(day)))).drop("_all")


def expected_label(days: DataFrame, calendar: DataFrame, moment: str, ready_hour: int = 10, name: str = "expected") -> DataFrame:
    """Newest day whose value is due at a moment: that day if it is a business day and the hour has come, else the one before."""
    spine = calendar.agg(F.array_sort(F.collect_list("d")).alias("_all"))
    today = F.to_date(moment)
    due = F.hour(moment) >= ready_hour
    got = F.array_max(F.filter("_all", lambda x: (x < today) | ((x == today) & due)))
    return days.crossJoin(F.broadcast(spine)).withColumn(name, got).drop("_all")


def first_of(period: str, day: str = "d") -> Column:
    """Whether a calendar row is the first of its month, quarter or year (over the calendar alone)."""
    return F.row_number().over(Window.partitionBy(F.trunc(day, period)).orderBy(day)) == 1


def walk_forward(calendar: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """(split, train_start, train_end, test_start, test_end) as positions; every split lies inside the calendar."""
    step = step or test
    n = calendar.agg(F.max("i").alias("n"))
    splits = n.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.col("n") + 1 - train - test), F.lit(step).cast("bigint"))).alias("a"), "n")
    splits = splits.filter(F.col("a") + train + test <= F.col("n") + 1)
    return splits.select(
        (F.col("a") / step).cast("bigint").alias("split"), F.col("a").alias("train_start"), (F.col("a") + train - 1).alias("train_end"),
        (F.col("a") + train).alias("test_start"), (F.col("a") + train + test - 1).alias("test_end"),
    )


def embargoed(train: DataFrame, start: int, days: int, position: str = "i") -> DataFrame:
    """Training rows at least ``days`` positions before a test start."""
    return train.filter(F.col(position) < start - days)
