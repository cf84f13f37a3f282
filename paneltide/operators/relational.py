"""Relational operators of the store: latest snapshots, deterministic dedupe, upserts, splices, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_snapshot(df: DataFrame, day: str = "snapshot_date") -> DataFrame:
    newest = df.agg(F.max(day).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(day) == F.col("_newest")).drop("_newest")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def upsert(stored: DataFrame, arrived: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Stored rows replaced by the last arrival of their key, new keys added."""
    newest = first_per_key(arrived, keys, [F.col(arrival).desc()]).drop(arrival)
    return stored.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*stored.columns))


def replace_partitions(stored: DataFrame, arrived: DataFrame, partition: str) -> DataFrame:
    """Stored rows without the partitions that arrived, and what arrived, by name."""
    days = arrived.select(partition).distinct()
    return stored.join(days, partition, "left_anti").select(*stored.columns).unionByName(arrived.select(*stored.columns))


def insert_ignore(stored: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(arrived.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def backfilled(df: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    return df.withColumn(column, F.when(where & F.col(column).isNull(), value).otherwise(F.col(column)))


def spliced(old: DataFrame, new: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Old rows before the cut-off, new ones from it on."""
    return old.filter(F.col(time) < cutoff).unionByName(new.filter(F.col(time) >= cutoff))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side; none if the tables are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def matured_only(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Violations of one-way maturation: a value that was there has changed or gone. Null to value is allowed."""
    both = old.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_there")), keys, "left")
    return both.filter(F.col("_there").isNull() | (F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, xor): row count and an order-insensitive hash of all columns."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("xor"))


def top_per_group(df: DataFrame, group: str | None, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("bigint")).filter(F.col("rank") <= n)


def capped_top(df: DataFrame, group: str, per_group: int, n: int, order: list[Column]) -> DataFrame:
    """Greedy top n with at most ``per_group`` of each group: one rank within the group, then one overall."""
    inside = df.withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_g") <= per_group).drop("_g")
    return inside.orderBy(*order).limit(n)


def buffered_top(df: DataFrame, held: str, n: int, factor: float, order: list[Column], by: str) -> DataFrame:
    """Held rows stay while their rank is within ``factor * n``; free places go to the best others. One set for each ``by``."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    stays = F.col(held) & (F.col("_r") <= factor * n)
    again = ranked.withColumn("_q", F.row_number().over(Window.partitionBy(by).orderBy(F.when(stays, 0).otherwise(1), "_r")))
    return again.filter(F.col("_q") <= n).drop("_q", "_r")


def seeded_sample(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, chosen by hash: the same at every run and on any partitioning."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str, keep_null: bool = False) -> DataFrame:
    out = df.unpivot(ids, columns, name, value)
    return out if keep_null else out.filter(F.col(value).isNotNull())


def pivot(df: DataFrame, ids: list[str], name: str, values: list[str], value: str) -> DataFrame:
    """Wide form with the given columns in order; for small results only."""
    return df.groupBy(*ids).pivot(name, values).agg(F.first(value))


def all_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the most frequent value of each group, the smallest of those that tie; null is no value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("value")))
    return counted.groupBy(by).agg(best.alias("_b")).select(by, F.col("_b.value").alias(value), (-F.col("_b.less")).alias("n"))


def key_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_left, in_right), one row for each key of either side: both flags are the intersection, one the difference."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_left", "in_right")])
