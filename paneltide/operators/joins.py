"""Joins across time axes, and validated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises, when run, on a key that repeats in ``right``."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = right.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"join key repeats: {', '.join(keys)}")).cast("boolean")).otherwise(True))
    return left.join(checked.filter("_ok").drop("_n", "_ok"), keys, "left")


def coalescing(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join in which ``columns`` take the right value where present, else the left one."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = left.join(r, keys, "left")
    return out.select(*[F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns])


def asof_last(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    One shuffle: both sides are laid end to end and the last right values are carried forward, so
    neither side is multiplied. A right row at the very time of a left row counts.
    """
    l = left.select(*[F.col(c) for c in left.columns], F.col(left_time).alias("_t"), F.lit(1).alias("_side"))
    r = right.select(F.col(by), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("_at"), *values).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_got", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, F.col("_got._at").alias(right_time), *[F.col(f"_got.{v}").alias(v) for v in values])


def asof_where(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, usable: Column, values: list[str], ties: list[str] = ()) -> DataFrame:
    """As :func:`asof_last`, with a further condition over both sides (such as a publication cut-off of that day).

    An equi-join by entity with the time condition inside it; the newest usable right row wins by
    one aggregation, and left rows without one stay.
    """
    key = [c for c in left.columns]
    r = right.select(F.col(by).alias("_by"), F.col(right_time).alias("_rt"), *[F.col(c).alias(f"_v_{c}") for c in dict.fromkeys([*values, *ties])])
    cond = (F.col(by) == F.col("_by")) & (F.col("_rt") <= F.col(left_time)) & usable
    best = F.max_by(F.struct("_rt", *[F.col(f"_v_{v}") for v in values]), F.struct("_rt", *[F.col(f"_v_{t}") for t in ties]))
    out = left.join(r, cond, "left").groupBy(*key).agg(best.alias("_b"))
    return out.select(*key, F.col("_b._rt").alias(right_time), *[F.col(f"_b._v_{v}").alias(v) for v in values])


def newest_before(right: DataFrame, by: str, time: str, moment: Column, ties: list[str] = ()) -> DataFrame:
    """The newest row of each key at or before one moment."""
    w = Window.partitionBy(by).orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties])
    return right.filter(F.col(time) <= moment).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def step_function(calendar: DataFrame, observed: DataFrame, visible: str, value: str, order: str) -> DataFrame:
    """Value of a slow series as it was known on each calendar day: visible from its release, then carried forward.

    Of several values released on one day the newest observation counts.
    """
    released = observed.groupBy(F.col(visible).alias("d")).agg(F.max_by(value, order).alias("_v"))
    spine = calendar.select("d", F.lit(True).alias("_day")).unionByName(released.select("d", "_v"), allowMissingColumns=True)
    per_day = spine.groupBy("d").agg(F.max("_day").alias("_day"), F.max("_v").alias("_v"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_day").select("d", value)


def aligned(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str], fill: float = 0.0) -> DataFrame:
    """Full outer alignment of two vectors, absent entries filled."""
    a, b = left.select(key, F.col(value).alias(names[0])), right.select(key, F.col(value).alias(names[1]))
    return a.join(b, key, "full").select(key, *[F.coalesce(n, F.lit(fill)).alias(n) for n in names])


def position_range(left: DataFrame, right: DataFrame, position: str, low: int, high: int, other: str, block: int = 128) -> DataFrame:
    """Pairs with ``left.position - low >= right.other >= ...``: right positions from ``position - low`` to ``position - high``.

    A pure range condition would be a nested loop. Both sides get block numbers, so it is an
    equi-join by block (a left row meets the two or more blocks that its range touches).
    """
    first, last = F.floor((F.col(position) - low) / block), F.floor((F.col(position) - high) / block)
    l = left.withColumn("_block", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    r = right.withColumn("_block", F.floor(F.col(other) / block).cast("bigint"))
    return l.join(r, "_block").filter((F.col(other) >= F.col(position) - low) & (F.col(other) <= F.col(position) - high)).drop("_block")


def carried(today: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Today's rows, and the last known ones of keys that today lacks."""
    return today.unionByName(known.join(today.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def effective_on(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str) -> DataFrame:
    """Left rows for which the key has a right row on or before their day."""
    first = right.groupBy(F.col(key).alias("_key")).agg(F.min(right_day).alias("_from"))
    return left.join(first, (F.col(key) == F.col("_key")) & (F.col("_from") <= F.col(left_day)), "left_semi")
