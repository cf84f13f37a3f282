"""The driver's tables as panels, masters, macro series and runs, and the same relations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.functions import calendars
from paneltide.operators import features as ft, windows as w
from paneltide.operators.strategies import UNKNOWN_TAX
from paneltide.schema import FEATURE_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, raw): weekly value over quantity of each part type. Money is summed as decimals: the same on any partitioning."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    week = F.date_trunc("week", "l_shipdate").cast("date")
    return joined.groupBy(F.col("p_type").alias("code"), week.alias("d")).agg((money("l_extendedprice") / money("l_quantity")).alias("raw"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, i, price) on the dense weekly grid, with a drift for each entity and a gap in every seventeenth cell."""
    obs = observations(spark, sf_dir)
    cal = calendars.trading_calendar(obs)
    grid = w.dense_grid(obs, cal, "raw")
    ranks = obs.select("code").distinct().withColumn("k", F.dense_rank().over(w.Window.orderBy("code")).cast("bigint"))
    out = grid.join(ranks, "code")
    price = F.when((F.col("k") * 5 + F.col("i")) % 17 != 0, F.col("raw") * F.exp((F.col("k") - 3) * F.lit(0.008) * F.col("i")))
    return out.select("code", "d", "i", price.alias("price"))


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, i, price): the weekly value over quantity of each supplier's parts, a panel that grows with the tables."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    obs = li.groupBy(F.format_string("S%07d", "l_suppkey").alias("code"), week.alias("d")).agg((money("l_extendedprice") / money("l_quantity")).alias("raw"))
    grid = w.dense_grid(obs, calendars.trading_calendar(obs), "raw")
    return grid.select("code", "d", "i", F.col("raw").alias("price"))


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide panel's 25 features with its labels: code, d, i, the features, y."""
    p = wide_panel(spark, sf_dir).withColumn("price", w.fill_forward())
    cal = p.select("d", "i").distinct()
    cash = with_cash(cal).select("d", "cash")
    kinds = p.select("code").distinct().select("code", F.pmod(F.crc32("code"), F.lit(7)).cast("int").alias("umbrella_type_code"), F.lit(UNKNOWN_TAX).alias("tax_rate"), F.lit(False).alias("excluded"))
    out = ft.build(p, cash, ft.macro_features(cal, macro(spark, sf_dir)), ft.market_features(p), kinds, least=60)
    return out.join(cal, out["feature_asof"] == cal["d"]).select(F.col("fund_code").alias("code"), "d", "i", *FEATURE_COLUMNS, "y")


PANEL_SQL = """
obs AS (
  SELECT p.p_type AS code, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS d,
    CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS raw
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2
),
cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM obs)),
codes AS (SELECT code, dense_rank() OVER (ORDER BY code) AS k FROM (SELECT DISTINCT code FROM obs)),
panel AS (
  SELECT codes.code, cal.d, cal.i,
    CASE WHEN (k * 5 + cal.i) % 17 <> 0 THEN o.raw * exp((k - 3) * 0.008e0 * cal.i) END AS price
  FROM codes CROSS JOIN cal LEFT JOIN obs o ON o.code = codes.code AND o.d = cal.d
)"""


WIDE_SQL = """
wobs AS (
  SELECT printf('S%07d', l_suppkey) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS raw
  FROM lineitem GROUP BY 1, 2
),
wcal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM wobs)),
wide AS (
  SELECT c.code, wcal.d, wcal.i, o.raw AS price, last_value(o.raw IGNORE NULLS) OVER (PARTITION BY c.code ORDER BY wcal.i) AS filled
  FROM (SELECT DISTINCT code FROM wobs) c CROSS JOIN wcal LEFT JOIN wobs o ON o.code = c.code AND o.d = wcal.d
)"""


def with_cash(p: DataFrame) -> DataFrame:
    """Adds a small cash rate that depends on the position."""
    return p.withColumn("cash", F.lit(0.0005) + F.lit(0.0001) * (F.col("i") % 7))


CASH_SQL = """
pc AS (
  SELECT *, sum(ln(1 + cash)) OVER (PARTITION BY code ORDER BY i) AS cash_sum
  FROM (SELECT *, 0.0005e0 + 0.0001e0 * (i % 7) AS cash FROM panel)
)"""


def labels(p: DataFrame) -> DataFrame:
    """Panel with cash, ``y`` and the one-row return ``r``; the label looks 5 rows ahead so that a short history matures."""
    q = with_cash(p).withColumn("cash_sum", w.running_log_growth("cash"))
    return q.withColumn("r", w.log_return(1)).withColumn("y", w.forward_label(horizon=22))


LABEL_SQL = """
lab AS (
  SELECT *, ln(price) - lag(ln(price)) OVER w AS r,
    lead(ln(price), 22) OVER w - lead(ln(price), 1) OVER w - (lead(cash_sum, 22) OVER w - lead(cash_sum, 1) OVER w) AS y
  FROM pc WINDOW w AS (PARTITION BY code ORDER BY i)
)"""


def predictions(p: DataFrame) -> DataFrame:
    """(code, d, i, q10, q50, q90, y): trailing empirical quantiles as forecasts, on all grid rows."""
    q = labels(p)
    for a in (10, 50, 90):
        q = q.withColumn(f"_q{a}", w.rolling_quantile(a / 100, 252, 63, 22)).withColumn(f"q{a}", w.delayed(f"_q{a}", 22))
    return q.select("code", "d", "i", "q10", "q50", "q90", "y")


PREDICTION_SQL = """
quant AS (
  SELECT code, d, i, y,
    CASE WHEN count(y) OVER w >= 63 THEN quantile_cont(y, 0.1) OVER w END AS a10,
    CASE WHEN count(y) OVER w >= 63 THEN quantile_cont(y, 0.5) OVER w END AS a50,
    CASE WHEN count(y) OVER w >= 63 THEN quantile_cont(y, 0.9) OVER w END AS a90
  FROM lab WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)
),
pred AS (
  SELECT code, d, i, lag(a10, 22) OVER w AS q10, lag(a50, 22) OVER w AS q50, lag(a90, 22) OVER w AS q90, y
  FROM quant WINDOW w AS (PARTITION BY code ORDER BY i)
)"""

#: Status texts dealt to the master's rows in turn.
STATUS = [
    "TEFAS'ta işlem görüyor", "İşlem Görüyor", "TEFAS'ta İşlem Görmüyor", "Fon Alımına Kapalı, Fon Bozumuna Kapalı",
    "Fon Alımına Kapalı, Fon Bozumuna Açık", "Fon Alımına Açık", "tanınmayan durum", "Alımına ve Bozumuna Kapalı", None,
]


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as fund rows in three snapshots: class, umbrella, people, status, lags, publication times."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.crossJoin(spark.range(3).withColumnRenamed("id", "snap"))
    key = F.col("s_suppkey") + F.col("snap")
    status = F.element_at(F.array(*[F.lit(x) for x in STATUS]), (key % len(STATUS) + 1).cast("int"))
    day = F.date_add(F.lit("1998-01-05").cast("date"), (F.col("snap") * 28).cast("int"))
    return s.select(
        day.alias("snapshot_date"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("fund_code"),
        F.concat(F.col("n_name"), F.lit(" Portföy "), F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") % 5 == 0, "EMK").otherwise("YAT").alias("fund_class"),
        F.concat(F.col("r_name"), F.when(F.col("s_suppkey") % 11 == 0, " SERBEST FON").otherwise(" Şemsiye  Fonu")).alias("umbrella_type"),
        F.when(F.col("s_suppkey") % 6 == 0, "Hisse").otherwise("Borçlanma").alias("category"),
        F.when(F.col("s_suppkey") % 13 == 0, "İSTANBUL PORTFÖY").otherwise(F.col("n_name")).alias("founder"),
        F.col("r_name").alias("manager"), status.alias("tefas_status"),
        F.date_sub(F.lit("1998-01-05").cast("date"), (F.col("s_suppkey") * 7 % 900).cast("int")).alias("inception_date"),
        F.when(key % 17 != 0, F.lit(True)).alias("info_ok"),
        F.when(key % 19 != 0, (F.col("s_suppkey") % 4).cast("double") + F.when(F.col("s_suppkey") % 23 == 0, 0.5).otherwise(0.0)).alias("buy_valor"),
        (F.col("s_suppkey") % 3).cast("double").alias("sell_valor"), F.when(key % 29 != 0, F.lit("A")).alias("tax_category"),
        F.when(F.col("s_suppkey") % 4 == 1, day.cast("timestamp_ntz") + F.expr("INTERVAL 11 HOURS")).alias("source_published_at"),
        F.when(key % 31 != 0, day.cast("timestamp_ntz") - F.make_dt_interval((F.col("s_suppkey") % 10).cast("int"))).alias("last_success_at"),
        (F.col("s_acctbal") > 0).alias("can_buy"), F.lit(True).alias("can_sell"), F.col("s_acctbal").alias("score"),
    )


_STATUS_SQL = "CASE (s_suppkey + snap) % 9 " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(STATUS) if x) + " END"
MASTER_SQL = f"""
master AS (
  SELECT day AS snapshot_date, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS fund_code, n_name || ' Portföy ' || s_name AS name,
    CASE WHEN s_nationkey % 5 = 0 THEN 'EMK' ELSE 'YAT' END AS fund_class,
    r_name || CASE WHEN s_suppkey % 11 = 0 THEN ' SERBEST FON' ELSE ' Şemsiye  Fonu' END AS umbrella_type,
    CASE WHEN s_suppkey % 6 = 0 THEN 'Hisse' ELSE 'Borçlanma' END AS category,
    CASE WHEN s_suppkey % 13 = 0 THEN 'İSTANBUL PORTFÖY' ELSE n_name END AS founder, r_name AS manager,
    {_STATUS_SQL} AS tefas_status, DATE '1998-01-05' - CAST(s_suppkey * 7 % 900 AS INTEGER) AS inception_date,
    CASE WHEN (s_suppkey + snap) % 17 <> 0 THEN true END AS info_ok,
    CASE WHEN (s_suppkey + snap) % 19 <> 0 THEN CAST(s_suppkey % 4 AS DOUBLE) + CASE WHEN s_suppkey % 23 = 0 THEN 0.5e0 ELSE 0e0 END END AS buy_valor,
    CAST(s_suppkey % 3 AS DOUBLE) AS sell_valor, CASE WHEN (s_suppkey + snap) % 29 <> 0 THEN 'A' END AS tax_category,
    CASE WHEN s_suppkey % 4 = 1 THEN CAST(day AS TIMESTAMP) + INTERVAL 11 HOUR END AS source_published_at,
    CASE WHEN (s_suppkey + snap) % 31 <> 0 THEN CAST(day AS TIMESTAMP) - to_days(CAST(s_suppkey % 10 AS INTEGER)) END AS last_success_at,
    s_acctbal > 0 AS can_buy, true AS can_sell, s_acctbal AS score
  FROM (SELECT *, DATE '1998-01-05' + CAST(snap * 28 AS INTEGER) AS day FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(range(3)) AS snap))
)"""
#: The fold and the collapse of text, as SQL.
FOLD_SQL = "lower(translate({0}, 'İIŞĞÜÖÇ', 'iışğüöç'))"
STATUS_FOLD_SQL = "lower(translate(trim(regexp_replace(coalesce(tefas_status, ''), '\\s+', ' ', 'g')), 'İIŞĞÜÖÇ', 'iışğüöç'))"


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value, available_from): a monthly price index, a rate that changes in steps, and a weekly exchange rate."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    month = o.groupBy(F.trunc("day", "month").alias("date")).agg((total / F.count("*")).alias("value"))
    cpi = month.select(F.lit("cpi_index").alias("series"), "date", "value", F.date_add("date", 35).alias("available_from"))
    rate = month.select(F.lit("policy_rate").alias("series"), "date", (F.month("date") / 3).cast("int").cast("double").alias("value"), F.col("date").alias("available_from"))
    week = o.groupBy(F.date_trunc("week", "day").cast("date").alias("date")).agg((total / F.count("*")).alias("value"))
    return cpi.unionByName(rate).unionByName(week.select(F.lit("usdtry").alias("series"), "date", "value", F.date_add("date", 1).alias("available_from")))


MACRO_SQL = """
mon AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
  FROM orders GROUP BY 1
),
macro AS (
  SELECT 'cpi_index' AS series, date, value, date + 35 AS available_from FROM mon
  UNION ALL SELECT 'policy_rate', date, CAST(month(date) // 3 AS DOUBLE), date FROM mon
  UNION ALL SELECT 'usdtry', date, value, date + 1 FROM (
    SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY 1)
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, kind, started_at, status, summary) from events."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") > 50, "ok").when(F.col("value") > 10, "partial").otherwise("failed")
    return e.select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("kind"), F.col("ts").alias("started_at"), status.alias("status"), F.col("props").alias("summary"))


RUNS_SQL = """
runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS kind, ts AS started_at,
    CASE WHEN value > 50 THEN 'ok' WHEN value > 10 THEN 'partial' ELSE 'failed' END AS status, props AS summary
  FROM events
)"""
