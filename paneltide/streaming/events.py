"""Event-time windows: the same functions on static and on streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Windows need session time zone timestamps; the session runs in UTC, so the wall clock stays."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if dict(events.dtypes)["ts"] == "timestamp_ntz" else events


def late(events: DataFrame, delay: str | None) -> DataFrame:
    return _timed(events).withWatermark("ts", delay) if delay else _timed(events)


def _out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), "n", "total")


def tumbling(events: DataFrame, size: str, delay: str | None = None) -> DataFrame:
    g = late(events, delay).groupBy("event_type", F.window("ts", size))
    return _out(g.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "event_type")


def sliding(events: DataFrame, size: str, every: str, delay: str | None = None) -> DataFrame:
    g = late(events, delay).groupBy("event_type", F.window("ts", size, every))
    return _out(g.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "event_type")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    g = late(events, delay).groupBy("user_id", F.session_window("ts", gap))
    out = g.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n", "total")


def dedup(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """One event of each key while the watermark remembers it."""
    return late(events, delay).dropDuplicatesWithinWatermark(keys)


def upsert_batches(events: DataFrame, path: str, day: str = "day"):
    """A ``foreachBatch`` writer keyed by day: a replayed batch replaces its own days, so the sink is idempotent."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return events.writeStream.foreachBatch(write)
