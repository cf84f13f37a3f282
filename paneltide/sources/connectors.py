"""Deterministic synthetic sources, a REST payload parser, and text sinks."""

from __future__ import annotations

import html
import json
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.functions.text import to_day, to_number


def synthetic_nav(spark: SparkSession, funds: int, days: int, seed: int = 0, start: date = date(2023, 1, 2)) -> DataFrame:
    """(code, d, price): geometric random walks on business days. Each price depends on seed, fund and day alone."""
    grid = spark.range(funds).withColumnRenamed("id", "f").crossJoin(F.broadcast(spark.range(days).withColumnRenamed("id", "t")))
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "f", "t"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    shock = F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * 3.141592653589793 * u("b")) * 0.01 + F.when(F.col("f") == 0, 0.0024).otherwise(0.0004)
    from pyspark.sql import Window

    walk = F.sum(shock).over(Window.partitionBy("f").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    day = F.date_add(F.lit(start), (F.floor(F.col("t") / 5) * 7 + F.col("t") % 5).cast("int"))
    return grid.select(F.concat(F.lit("F"), F.col("f").cast("string")).alias("code"), day.alias("d"), (10 * F.exp(walk)).alias("price"))


def rest_items(payload: DataFrame, series: list[str], column: str = "payload", day_field: str = "Tarih") -> DataFrame:
    """(date, series columns with dots): items of a REST answer; day-first dates in two forms, absent fields null."""
    names = {s: s.replace(".", "_") for s in series}
    schema = "items array<struct<" + ",".join([f"{day_field}:string", *[f"{v}:string" for v in names.values()]]) + ">>"
    rows = payload.select(F.explode(F.from_json(column, schema)["items"]).alias("x"))
    return rows.select(to_day(F.col(f"x.{day_field}"), "dd-MM-yyyy", "d-M-yyyy", "yyyy-MM").alias("date"), *[to_number(F.col(f"x.{v}")).alias(s) for s, v in names.items()])


def melt_series(wide: DataFrame, lag_days: int = 0) -> DataFrame:
    """(series, date, value, available_from) without nulls."""
    cols = [c for c in wide.columns if c != "date"]
    quoted = wide.select("date", *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in cols])
    long = quoted.unpivot(["date"], [c.replace(".", "_") for c in cols], "series", "value").filter("value IS NOT NULL")
    return long.select("series", "date", "value", F.date_add("date", lag_days).alias("available_from"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(path: str, value: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def markdown(title: str, df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def message_chunks(text: str, size: int = 4000) -> list[str]:
    """Parts of at most ``size`` characters, cut at line ends where possible."""
    out: list[str] = []
    for line in text.split("\n"):
        while len(line) > size:
            out.append(line[:size])
            line = line[size:]
        if out and len(out[-1]) + 1 + len(line) <= size:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def plain(message: str) -> str:
    """A message without markup, for sinks that refuse it."""
    return html.unescape(re.sub(r"<[^>]+>", "", message))
