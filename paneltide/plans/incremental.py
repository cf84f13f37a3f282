"""Append-only builds: recompute an overlap, demand an unchanged prefix, splice the tail, publish at once."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.operators import relational as rel


class PrefixChanged(RuntimeError):
    """History differs from what was published: nothing is written."""


class StaleInput(RuntimeError):
    pass


@dataclass(frozen=True)
class Derived:
    """A derived table: its key, its time column, columns that may mature from null to a value, and days to recompute."""

    name: str
    keys: list[str]
    time: str
    maturing: list[str] = field(default_factory=list)
    overlap: int = 45


def _live(root: str, name: str) -> Path | None:
    pointer = Path(root) / f"{name}.current"
    return Path(root) / pointer.read_text().strip() if pointer.exists() else None


def read(spark: SparkSession, root: str, d: Derived) -> DataFrame | None:
    at = _live(root, d.name)
    return spark.read.parquet(str(at)) if at else None


def publish(df: DataFrame, root: str, d: Derived) -> str:
    """Writes beside the live table and then moves the pointer; a failed write changes nothing."""
    name = f"{d.name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(str(Path(root) / name))
    swap = Path(root) / f".{d.name}-{uuid.uuid4().hex[:6]}"
    swap.write_text(name)
    os.replace(swap, Path(root) / f"{d.name}.current")
    return name


def check_prefix(old: DataFrame, new: DataFrame, d: Derived) -> None:
    """Raises unless the recomputed rows equal the published ones, but for maturing columns that gained a value."""
    fixed = [c for c in old.columns if c not in d.maturing]
    if rel.differences(old.select(*fixed), new.select(*fixed)).limit(1).count():
        raise PrefixChanged(f"{d.name}: published rows changed")
    for c in d.maturing:
        if rel.matured_only(old, new, d.keys, c).limit(1).count():
            raise PrefixChanged(f"{d.name}: {c} changed after it had matured")


def build(spark: SparkSession, root: str, d: Derived, calendar: DataFrame, compute: Callable[[object | None], DataFrame], newest_input) -> str:
    """Brings a derived table up to date; returns ``full``, ``unchanged`` or ``appended``.

    ``compute(cutoff)`` gives the rows from ``cutoff`` on (all with None). ``calendar``: (d, i). Input
    older than what is published is refused. The overlap reaches ``overlap`` trading days back from
    the newest published row; the prefix before it is kept as it stands.
    """
    old = read(spark, root, d)
    if old is None:
        publish(compute(None), root, d)
        return "full"
    newest = old.agg(F.max(d.time)).first()[0]
    if newest_input is None or (newest is not None and newest_input < newest):
        raise StaleInput(f"{d.name}: input ends {newest_input}, published rows end {newest}")
    at = calendar.filter(F.col("d") <= F.lit(newest)).agg(F.max("i")).first()[0]
    cutoff = calendar.filter(F.col("i") == max(0, (at or 0) - d.overlap)).first()["d"]
    tail = compute(cutoff)
    known = old.filter(F.col(d.time) >= F.lit(cutoff))
    check_prefix(known, tail.filter(F.col(d.time) <= F.lit(newest)), d)
    if not rel.differences(known, tail).limit(1).count():
        return "unchanged"
    publish(rel.spliced(old, tail.select(*old.columns), d.time, F.lit(cutoff)), root, d)
    return "appended"


def business_day_guard(panel: DataFrame, calendar: DataFrame, day: str = "d") -> None:
    """Raises if the panel has a day that is no business day."""
    odd = panel.select(day).distinct().join(calendar.select(F.col("d").alias(day)), day, "left_anti").limit(5).collect()
    if odd:
        raise ValueError(f"not business days: {', '.join(str(r[0]) for r in odd)}")


def run_steps(steps: list[tuple[str, list[str], Callable[[], str | None]]]) -> tuple[str, dict[str, dict]]:
    """Runs named steps with their dependencies. A failed step does not stop independent ones; its dependents are skipped.

    Returns the worst status and each step's: ok, partial, skipped or failed.
    """
    out: dict[str, dict] = {}
    for name, needs, step in steps:
        if any(out.get(n, {}).get("status") in ("failed", "skipped") for n in needs):
            out[name] = {"status": "skipped", "needs": needs}
            continue
        try:
            out[name] = {"status": step() or "ok"}
        except Exception as e:  # noqa: BLE001  isolation is the purpose
            out[name] = {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
    order = ["ok", "skipped", "partial", "failed"]
    return max((x["status"] for x in out.values()), key=lambda s: order.index(s) if s in order else 2, default="ok"), out
