"""Execution profiles by decision date: as-of selection under a publication cut-off, and fail-closed reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.stats import whole_days
from paneltide.functions.text import first_reason, mentions
from paneltide.operators import joins
from paneltide.operators.ledger import tax_rate_on
from paneltide.operators.quality import execution_masks

FIELDS = ["tefas_status", "buy_valor", "sell_valor", "tax_category", "last_success_at", "source_published_at"]


def cutoff(day: str, hours: int = 9, minutes: int = 15) -> Column:
    return F.col(day).cast("timestamp_ntz") + F.expr(f"INTERVAL {hours} HOURS {minutes} MINUTES")


def profiles_asof(decisions: DataFrame, history: DataFrame, day: str = "dday", by: str = "fund_code") -> DataFrame:
    """Each decision with the newest snapshot published by that morning; snapshots without a time count by date."""
    published = F.col("_v_source_published_at")
    return joins.asof_where(decisions, history, by, day, "snapshot_date", published.isNull() | (published <= cutoff(day)), FIELDS)


def reasons(profiles: DataFrame, day: str = "dday", freshness: str = "7") -> DataFrame:
    """can_buy, can_sell and the first reason against each; nothing missing ever means allowed."""
    moment = cutoff(day)
    buy, sell, known = execution_masks()
    success = F.col("last_success_at")
    reason = first_reason(
        (F.col("snapshot_date").isNull(), "no_pit_snapshot"),
        (success.isNull(), "missing_last_success_at"),
        (success > moment, "future_last_success_at"),
        (moment - success > F.expr(f"INTERVAL '{freshness}' DAY"), "stale_last_success_at"),
        (~known, "unknown_status"),
        (F.col("buy_valor").isNull() | F.col("sell_valor").isNull(), "missing_execution_field"),
        (F.coalesce(F.trim("tax_category"), F.lit("")) == "", "missing_tax_category"),
        (~whole_days(F.col("buy_valor")), "invalid_buy_valor"),
        (~whole_days(F.col("sell_valor")), "invalid_sell_valor"),
    )
    out = profiles.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    side = lambda mask, closed: F.when(ok & ~mask, closed).otherwise(F.col("reason"))
    return out.select(
        *profiles.columns, (ok & buy).alias("can_buy"), (ok & sell).alias("can_sell"), side(buy, "status_buy_closed").alias("buy_reason"), side(sell, "status_sell_closed").alias("sell_reason"),
        F.when(F.col("source_published_at").isNotNull(), "source_timestamp").otherwise("date_only_pit_assumption").alias("publication_time_assumption"),
    )


def stressed(profiles: DataFrame, extra_days: int = 0, fee_factor: float = 1.0) -> DataFrame:
    """Profiles with longer settlement and scaled fees."""
    out = profiles.withColumns({c: F.col(c) + extra_days for c in ("buy_valor", "sell_valor")})
    return out.withColumns({c: F.col(c) * fee_factor for c in ("entry_fee", "exit_fee") if c in profiles.columns})


def fund_meta(master: DataFrame, pension: bool = False, unknown_tax: float = 0.175) -> DataFrame:
    """One row for each fund: settlement lags, fees, tax and whether the tax is assumed. Defaults only where data lack."""
    tax = F.col("withholding_rate")
    return master.select(
        "fund_code", F.coalesce("buy_valor", F.lit(1)).cast("int").alias("buy_lag"), F.coalesce("sell_valor", F.lit(2)).cast("int").alias("sell_lag"),
        F.lit(0.0).alias("entry_fee"), F.lit(0.0).alias("exit_fee"),
        (F.lit(0.0) if pension else F.coalesce(tax, F.lit(unknown_tax))).alias("tax_rate"), (F.lit(False) if pension else tax.isNull()).alias("tax_assumed"), "founder", "umbrella_type",
    )


def withholding_classes(funds: DataFrame, rules: list[tuple[str, list[str], list[str]]] | None, schedule: list[tuple[str, dict[str, float]]], day: str = "snapshot_date") -> DataFrame:
    """Adds tax_category and withholding_rate, the rate of the category on ``day``.

    ``rules``: (category, literals of the fund's category, literals of its name), the first that fits counts; no literals ask nothing, null text is
    empty. A fund that fits none, and every fund where no rules are given, has both null: nothing is assumed. ``schedule`` as in
    :func:`paneltide.operators.ledger.tax_rate_on`; a day before its beginning has no rate. The rules are one native expression, so
    the pairs of category and name need neither be told apart nor joined back.
    """
    fits = lambda c, words: mentions(F.col(c), words) if words else F.lit(True)
    kinds = [F.when(fits("category", of) & fits("name", named), F.lit(kind)) for kind, of, named in rules or []]
    out = funds.withColumn("tax_category", F.coalesce(*kinds, F.lit(None).cast("string")))
    rate = tax_rate_on(F.col(day), F.col("tax_category"), schedule, F.lit(None).cast("double"))
    return out.withColumn("withholding_rate", F.when(F.col("tax_category").isNotNull(), rate))
