"""Ingest orchestration over any source with four methods: what to fetch, what to carry forward, how it went."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.functions.text import founder_of
from paneltide.operators.joins import carried
from paneltide.operators.quality import execution_masks
from paneltide.schema import FUND_MASTER
from paneltide.sources.store import Store, migrated


class Source(Protocol):
    def funds(self) -> list[dict]: ...

    def fees(self) -> list[dict]: ...

    def profile(self, code: str) -> dict: ...

    def history(self, code: str, start: date | None) -> list[dict]: ...


def fetched(codes: list[str], get, workers: int = 3) -> tuple[dict[str, object], dict[str, str]]:
    """Results and errors by code, in the order of ``codes``; one failure stops no other."""

    def one(code: str):
        try:
            return code, get(code), None
        except Exception as e:  # noqa: BLE001  isolation is the purpose
            return code, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        rows = list(pool.map(one, codes))
    return {c: v for c, v, e in rows if e is None}, {c: e for c, _, e in rows if e is not None}


def wanted(funds: list[str], mode: str, failing: set[str], weekday: int, subset: set[str] | None = None) -> list[str]:
    """Codes whose profile is fetched: all at first, known failing ones again on Mondays only, or just those."""
    codes = [c for c in funds if subset is None or c in subset]
    if mode == "only_failed":
        return [c for c in codes if c in failing]
    return codes if mode == "initial" or weekday == 0 else [c for c in codes if c not in failing]


def long_history(spark: SparkSession, histories: dict[str, list[dict]], arrived: datetime) -> DataFrame:
    """(fund_code, date, price, published_at, _seq); prices that are null or not positive are left out."""
    rows = [(c, h["date"], float(h["price"]), arrived, n) for c, hs in histories.items() for n, h in enumerate(hs) if h.get("price") is not None and float(h["price"]) > 0]
    return spark.createDataFrame(rows, "fund_code string, date date, price double, published_at timestamp_ntz, _seq int")


def fund_master(funds: DataFrame, fees: DataFrame, profiles: DataFrame, stats: DataFrame, day: date, moment: datetime) -> DataFrame:
    """The canonical rows: the list with fees, profiles and history statistics joined on, flags derived from the status text."""
    known = set(profiles.columns) - {"fund_code"}
    out = funds.join(fees.dropDuplicates(["fund_code"]), "fund_code", "left").join(profiles, "fund_code", "left").join(stats, "fund_code", "left")
    out = out.withColumn("snapshot_date", F.lit(day)).withColumn("founder", F.coalesce(*([F.col("founder")] if "founder" in out.columns else []), founder_of(F.col("name"))))
    ok = F.col("tefas_status").isNotNull() if "tefas_status" in known else F.lit(False)
    buy, sell, _ = execution_masks() if "tefas_status" in known else (F.lit(False), F.lit(False), None)
    return migrated(out.withColumns({"info_ok": ok, "info_fetched": ok, "hist_ok": F.coalesce(F.col("n_nav") > 0, F.lit(False)), "last_success_at": F.when(ok, F.lit(moment)), "can_buy": buy, "can_sell": sell}), FUND_MASTER)


def ingest(store: Store, source: Source, moment: datetime, mode: str = "incremental", subset: set[str] | None = None, workers: int = 3) -> dict:
    """One run: list, profiles, histories, upserts, and a run log entry. Status is ok, partial or failed."""
    spark, day = store.spark, moment.date()
    try:
        listed = source.funds()
    except Exception as e:  # noqa: BLE001
        summary = {"status": "failed", "error": f"{type(e).__name__}: {e}"}
        store.log_run(f"ingest-{moment:%Y%m%dT%H%M%S}", "ingest", moment, moment, "failed", summary)
        return summary
    codes = [f["fund_code"] for f in listed if subset is None or f["fund_code"] in subset]
    stored = store.table("fund_master")
    newest = stored.groupBy("fund_code").agg(F.max_by(F.struct("info_ok"), "snapshot_date").alias("x"))
    failing = {r["fund_code"] for r in newest.filter(~F.coalesce("x.info_ok", F.lit(False))).collect()}
    last = {r["fund_code"]: r["d"] for r in store.table("fund_nav").groupBy("fund_code").agg(F.max("date").alias("d")).collect()}
    profiles, bad_profiles = fetched(wanted(codes, mode, failing, moment.weekday(), subset), source.profile, workers)
    histories, bad_histories = fetched(codes, lambda c: source.history(c, None if mode == "initial" else last.get(c)), workers)
    nav = long_history(spark, histories, moment)
    store.upsert_nav(nav)
    stats = store.table("fund_nav").groupBy("fund_code").agg(F.min("date").alias("first_nav_date"), F.max("date").alias("last_nav_date"), F.count("*").cast("int").alias("n_nav"))
    frame = lambda rows, ddl: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in ddl.split(", ")) for r in rows], ddl)
    today = fund_master(
        frame([f for f in listed if f["fund_code"] in set(codes)], "fund_code string, name string, fund_class string, umbrella_type string"), frame(source.fees(), "fund_code string, applied_fee double, expense_ratio double"),
        frame([{**v, "fund_code": c} for c, v in profiles.items()], "fund_code string, tefas_status string, buy_valor int, sell_valor int, category string"), stats, day, moment,
    )
    good = today.filter("info_ok")
    from paneltide.operators.relational import first_per_key

    before = first_per_key(stored.filter(F.col("snapshot_date") < F.lit(day)), ["fund_code"], [F.col("snapshot_date").desc()]).withColumn("snapshot_date", F.lit(day)).withColumn("info_fetched", F.lit(False))
    known = before.join(today.select("fund_code"), "fund_code", "left_semi").select(*today.columns)
    rows = carried(carried(good, known, ["fund_code"]), today, ["fund_code"])
    store.write_fund_master(rows)
    summary = {"status": "ok" if not bad_profiles and not bad_histories else "failed" if not histories else "partial", "funds": len(codes), "profiles": len(profiles), "failed_profiles": sorted(bad_profiles), "failed_histories": sorted(bad_histories)}
    store.log_run(f"ingest-{moment:%Y%m%dT%H%M%S}", "ingest", moment, moment, summary["status"], summary)
    return summary


class Synthetic:
    """A small deterministic source: ``fail`` lists codes whose profile raises, ``young`` gives a shorter history."""

    def __init__(self, n: int = 6, days: int = 30, fail: set[str] = frozenset(), young: set[str] = frozenset()) -> None:
        self.codes, self.days, self.fail, self.young = [f"S{i:02d}" for i in range(n)], days, fail, young

    def funds(self) -> list[dict]:
        return [{"fund_code": c, "name": f"Kurucu{i % 3} Portföy {c}", "fund_class": "YAT", "umbrella_type": "Hisse" if i % 2 else "Serbest"} for i, c in enumerate(self.codes)]

    def fees(self) -> list[dict]:
        return [{"fund_code": c, "applied_fee": 0.02, "expense_ratio": 0.03} for c in self.codes]

    def profile(self, code: str) -> dict:
        if code in self.fail:
            raise RuntimeError(f"no profile for {code}")
        return {"tefas_status": "TEFAS'ta işlem görüyor", "buy_valor": 1, "sell_valor": 2, "category": "Fon"}

    def history(self, code: str, start: date | None) -> list[dict]:
        n = self.days // 2 if code in self.young else self.days
        days = [date.fromordinal(date(2026, 1, 5).toordinal() + i // 5 * 7 + i % 5) for i in range(n)]
        return [{"date": d, "price": 10.0 + i + self.codes.index(code)} for i, d in enumerate(days) if start is None or d >= start]
