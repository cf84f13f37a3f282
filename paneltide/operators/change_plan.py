"""Second-leg plan: selected funds to capped weights, a yearly change counter, append-only rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from paneltide.operators.allocation import water_fill

PLAN = "change_id string, date date, year int, month int, fund_code string, target_weight double, p_value double, lower double, q50 double, note string"


def next_change(plan: DataFrame, year: int, most: int = 12) -> str | None:
    """``YYYY-NN`` after the year's last change; none once the year's changes are used up."""
    last = plan.filter(F.col("year") == year).agg(F.max(F.regexp_extract("change_id", r"-(\d+)$", 1).cast("int"))).first()[0] or 0
    return f"{year}-{last + 1:02d}" if last < most else None


def make(plan: DataFrame, selected: DataFrame, founders: dict[str, str | None], day: date, budget: float = 1.0, most: int = 20, changes: int = 12) -> DataFrame:
    """The plan with one more change: the best ``most`` selected rows by p-value, water-filled under fund and founder caps.

    One change for each month at most: a repeat of the month returns the plan as it is.
    """
    if plan.filter((F.col("year") == day.year) & (F.col("month") == day.month)).limit(1).count():
        return plan
    change = next_change(plan, day.year, changes)
    if change is None:
        return plan
    rows = selected.orderBy("p_value", "fund_code").limit(most).collect()  # at most `most` rows
    weights, left = water_fill([r["fund_code"] for r in rows], founders, budget)
    out = [(change, day, day.year, day.month, r["fund_code"], weights[r["fund_code"]], r["p_value"], r["lower"], r["q50"], None) for r in rows if weights[r["fund_code"]] > 0]
    out.append((change, day, day.year, day.month, "CASH", left, None, None, None, "remainder"))
    return plan.unionByName(plan.sparkSession.createDataFrame(out, PLAN))
