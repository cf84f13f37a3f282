"""Suites: tables of runs, replayed side by side, summarised and described."""

from __future__ import annotations

from itertools import product

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.operators import ledger, robustness as rb, strategies as st, windows as w
from paneltide.sources.connectors import markdown

RUNS = "run_id string, strategy string, n int, every int, start bigint, tax double, haircut double"

#: Strategies of each suite; ``name@column`` runs a strategy under the exposure levels of that column.
SUITES = {
    "baseline": ("cash", "top", "momentum_hrp"),
    "selection": ("conformal_hrp", "selected_q10", "selected_q20", "selected_q30"),
    "gates": ("momentum_hrp", "momentum_hrp@spread", "momentum_hrp@rule", "momentum_hrp@regime", "conformal_hrp@spread", "conformal_hrp@rule", "conformal_hrp@regime"),
}
SUITES["full"] = tuple(dict.fromkeys(name for names in SUITES.values() for name in names))


def _make(name: str, cov_rows: int, run: pd.Series) -> ledger.Strategy:
    base, _, column = name.partition("@")
    n = int(run["n"])
    if base == "cash":
        made = ledger.cash_only
    elif base == "top":
        made = ledger.top_n(n)
    elif base == "momentum_hrp":
        made = st.momentum_hrp(n, cov_rows)
    elif base == "conformal_hrp":
        made = st.conformal_hrp(n, cov_rows)
    elif base.startswith("selected_"):
        made = st.selected_hrp(n, cov_rows, base)
    else:
        raise ValueError(f"no strategy {name}")
    return st.gated(made, column) if column else made


def makers(names: tuple[str, ...], cov_rows: int = 126) -> dict[str, Callable[[pd.Series], ledger.Strategy]]:
    return {name: partial(_make, name, cov_rows) for name in names}


def run_suite(panel: DataFrame, suite: str, n: int = 10, every: int = 21, cov_rows: int = 126, start: int = 0, tax: float = 0.175, also: tuple[str, ...] = ()) -> DataFrame:
    """Equity of a named suite's strategies (and ``also``), one run each, errors isolated; an unknown suite raises."""
    names = (*SUITES[suite], *also)
    runs = panel.sparkSession.createDataFrame([(x, x, n, every, start, tax, 0.0) for x in names], RUNS)
    return ledger.run_isolated(panel, runs, makers(names, cov_rows))


def runs_table(spark: SparkSession, strategies: list[tuple[str, int]], every: list[int], starts: list[int], taxes: list[float], haircut: float = 0.0) -> DataFrame:
    rows = [(f"{s}{n}-e{e}-s{a}-t{t}", s, n, e, a, t, haircut) for (s, n), e, a, t in product(strategies, every, starts, taxes)]
    return spark.createDataFrame(rows, RUNS)


def evaluate(panel: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equity, summary, description) of all runs; cash is each run's own yardstick."""
    eq = ledger.run_all(panel, runs)
    cash = panel.groupBy("i").agg(F.first("cash").alias("cash")).withColumn("code", F.lit("cash")).withColumn("cash_level", F.exp(w.running_log_growth("cash"))).select("i", "cash_level")
    summary = rb.summary(eq.join(F.broadcast(cash), "i"))
    return eq, summary, rb.describe(summary, ["cagr", "vol", "sharpe", "mdd"])


def friction(panel: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, net, gross, drag): yearly growth with and without tax."""
    net = evaluate(panel, runs)[1].select("run_id", F.col("cagr").alias("net"))
    gross = evaluate(panel, runs.withColumn("tax", F.lit(0.0)))[1].select("run_id", F.col("cagr").alias("gross"))
    return net.join(gross, "run_id").withColumn("drag", F.col("gross") - F.col("net"))


def report(panel: DataFrame, runs: DataFrame, title: str) -> str:
    """The suite as Markdown, with the probability of backtest overfitting over its runs."""
    eq, summary, described = evaluate(panel, runs)
    r = eq.withColumn("r", F.ln("equity") - F.lag(F.ln("equity")).over(w.Window.partitionBy("run_id").orderBy("i")))
    pbo = rb.pbo(r.select("run_id", "i", F.coalesce("r", F.lit(0.0)).alias("r")))
    return "\n".join([markdown(title, summary.orderBy("run_id")), markdown("Over runs", described), markdown("Overfitting", pbo)])
