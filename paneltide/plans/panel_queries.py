"""Windows, features, macro and market on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.functions import calendars
from paneltide.operators import features as ft, joins, relational as rel, universe, windows as w
from paneltide.plans import adapters as ad
from paneltide.plans.adapters import CASH_SQL, LABEL_SQL, MACRO_SQL, MASTER_SQL, PANEL_SQL
from paneltide.plans.registry import query, rounded as r
from paneltide.schema import FEATURE_COLUMNS, MASK_COLUMNS, TIME_COLUMNS


@query("SELECT code, d, i, round(price, 6) + 0e0 AS price FROM panel", PANEL_SQL)
def dense_grid(spark, sf):
    return ad.panel(spark, sf).select("code", "d", "i", r("price", 6).alias("price"))


@query("""
SELECT code, i, round(last_value(price IGNORE NULLS) OVER w, 6) + 0e0 AS price,
  i - max(CASE WHEN price IS NOT NULL THEN i END) OVER w AS since FROM panel WINDOW w AS (PARTITION BY code ORDER BY i)
""", PANEL_SQL)  # fmt: skip
def ffill_nav(spark, sf):
    return ad.panel(spark, sf).select("code", "i", r(w.fill_forward(), 6).alias("price"), w.since_last().alias("since"))


@query("""
SELECT code, i, price IS NOT NULL AND count(price) OVER w >= 60 AND i - max(CASE WHEN price IS NOT NULL THEN i END) OVER w <= 5 AS eligible
FROM panel WINDOW w AS (PARTITION BY code ORDER BY i)
""", PANEL_SQL)  # fmt: skip
def eligible_mask(spark, sf):
    return ad.panel(spark, sf).select("code", "i", universe.eligible(60, 5).alias("eligible"))


@query("SELECT code, i, " + ", ".join(f"round(ln(price) - lag(ln(price), {k}) OVER w, 8) + 0e0 AS log_ret_{k}" for k in (1, 5, 21, 63, 126, 252)) + " FROM panel WINDOW w AS (PARTITION BY code ORDER BY i)", PANEL_SQL)
def log_returns(spark, sf):
    return ad.panel(spark, sf).select("code", "i", *[r(w.log_return(k)).alias(f"log_ret_{k}") for k in (1, 5, 21, 63, 126, 252)])


@query("""
SELECT code, i, CASE WHEN count(r) OVER w >= 13 THEN round(stddev_samp(r) OVER w * sqrt(252), 8) + 0e0 END AS vol
FROM (SELECT code, i, ln(price) - lag(ln(price)) OVER (PARTITION BY code ORDER BY i) AS r FROM panel)
WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
""", PANEL_SQL)  # fmt: skip
def rolling_vol(spark, sf):
    p = ad.panel(spark, sf).withColumn("r", w.log_return(1))
    return p.select("code", "i", r(w.rolling_vol(13)).alias("vol"))


@query("""
SELECT code, i, CASE WHEN count(r) OVER w >= 21 THEN round(sqrt(sum(r * r * pow(1 / 0.94e0, i)) OVER w / sum(CASE WHEN r IS NOT NULL THEN pow(1 / 0.94e0, i) END) OVER w * 252), 8) + 0e0 END AS vol
FROM (SELECT code, i, ln(price) - lag(ln(price)) OVER (PARTITION BY code ORDER BY i) AS r FROM panel)
WINDOW w AS (PARTITION BY code ORDER BY i)
""", PANEL_SQL)  # fmt: skip
def ewma_vol(spark, sf):
    p = ad.panel(spark, sf).withColumn("r", w.log_return(1))
    return p.select("code", "i", r(w.ewma_vol()).alias("vol"))


@query("""
SELECT code, i, CASE WHEN count(price) OVER w >= 13 THEN round(price / max(price) OVER w - 1, 8) + 0e0 END AS below,
  round(max(price) OVER (PARTITION BY code ORDER BY i), 6) + 0e0 AS peak
FROM panel WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
""", PANEL_SQL)  # fmt: skip
def rolling_drawdown(spark, sf):
    return ad.panel(spark, sf).select("code", "i", r(w.below_peak(13)).alias("below"), r(w.running_peak("price"), 6).alias("peak"))


@query("""
SELECT code, i, round((rank() OVER (PARTITION BY d ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY d, v) - 1) / 2e0) / count(v) OVER (PARTITION BY d), 8) + 0e0 AS pct
FROM (SELECT code, d, i, round(ln(price) - lag(ln(price), 21) OVER (PARTITION BY code ORDER BY i), 1) + 0e0 AS v FROM panel) WHERE v IS NOT NULL
""", PANEL_SQL)  # fmt: skip
def pct_rank_avg_ties(spark, sf):
    p = ad.panel(spark, sf).withColumn("v", r(w.log_return(21), 1))
    return p.withColumn("pct", r(w.percentile_rank("v", F.lit(True)))).filter("v IS NOT NULL").select("code", "i", "pct")


@query("""
SELECT code, i, CASE WHEN count(price) OVER w >= 46.8 THEN round(lag(ln(price), 4) OVER f - lag(ln(price), 52) OVER f, 8) + 0e0 END AS score
FROM panel WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 51 PRECEDING AND CURRENT ROW), f AS (PARTITION BY code ORDER BY i)
""", PANEL_SQL)  # fmt: skip
def momentum_12_1(spark, sf):
    return ad.panel(spark, sf).select("code", "i", r(w.momentum(4, 52)).alias("score"))


@query("""
SELECT d, round(avg(a), 8) + 0e0 AS breadth FROM (
  SELECT d, CASE WHEN m IS NOT NULL AND p IS NOT NULL THEN CASE WHEN p > m THEN 1e0 ELSE 0e0 END END AS a FROM (
    SELECT d, p, CASE WHEN count(p) OVER w >= 20 THEN avg(p) OVER w END AS m
    FROM (SELECT code, d, i, last_value(price IGNORE NULLS) OVER (PARTITION BY code ORDER BY i) AS p FROM panel)
    WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))) GROUP BY d
""", PANEL_SQL)  # fmt: skip
def ma_breadth(spark, sf):
    p = ad.panel(spark, sf).withColumn("p", w.fill_forward()).withColumn("m", w.partial_mean(40, 20, "p"))
    above = F.when(F.col("m").isNotNull() & F.col("p").isNotNull(), (F.col("p") > F.col("m")).cast("double"))
    return p.groupBy("d").agg(r(F.avg(above)).alias("breadth"))


@query("SELECT code, i, coalesce(abs(ln(price) - lag(ln(price)) OVER (PARTITION BY code ORDER BY i)) > 0.25, false) AS jump FROM panel", PANEL_SQL)
def jump_flags(spark, sf):
    return ad.panel(spark, sf).select("code", "i", w.jumps(0.25).alias("jump"))


_RET_SQL = """
ret AS (
  SELECT code, d, i, p / nullif(lag(p) OVER (PARTITION BY code ORDER BY i), 0) - 1 AS ret
  FROM (SELECT code, d, i, last_value(price IGNORE NULLS) OVER (PARTITION BY code ORDER BY i) AS p FROM panel)
)"""


@query("SELECT d, i, round(coalesce(avg(least(greatest(ret, -0.01e0), 0.01e0)), 0e0), 8) + 0e0 AS cash FROM ret GROUP BY d, i", PANEL_SQL, _RET_SQL)
def cash_basket_return(spark, sf):
    return ft.basket_return(ad.panel(spark, sf)).select("d", "i", r("cash").alias("cash"))


_INDEX_SQL = """
idx AS (
  SELECT d, i, CASE WHEN avg(CASE WHEN ret IS NOT NULL THEN 1e0 ELSE 0e0 END) >= 0.8 THEN coalesce(avg(least(greatest(ret, -0.2e0), 0.2e0)), 0e0) ELSE 0e0 END AS ret
  FROM ret GROUP BY d, i
)"""


@query("SELECT d, i, round(ret, 8) + 0e0 AS ret, round(exp(sum(ln(1 + ret)) OVER (ORDER BY i)), 8) + 0e0 AS level FROM idx", PANEL_SQL, _RET_SQL, _INDEX_SQL)
def equity_index_breadth(spark, sf):
    return ft.index_level(ad.panel(spark, sf)).select("d", "i", r("ret").alias("ret"), r("level").alias("level"))


@query("""
SELECT d, i, round(l - lag(l, 63) OVER (ORDER BY i), 8) + 0e0 AS eq_trend63,
  CASE WHEN count(rr) OVER w >= 21 THEN round(stddev_samp(rr) OVER w * sqrt(252), 8) + 0e0 END AS eq_vol21,
  round(ln(exp(l)), 6) + 0e0 AS log_level
FROM (SELECT *, l - lag(l) OVER (ORDER BY i) AS rr FROM (SELECT d, i, sum(ln(1 + ret)) OVER (ORDER BY i) AS l FROM idx))
WINDOW w AS (ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
""", PANEL_SQL, _RET_SQL, _INDEX_SQL)  # fmt: skip
def market_trend(spark, sf):
    p = ad.panel(spark, sf)
    level = ft.index_level(p).select("d", r(F.ln("level"), 6).alias("log_level"))
    return ft.market_features(p).join(level, "d").select("d", "i", r("eq_trend63").alias("eq_trend63"), r("eq_vol21").alias("eq_vol21"), "log_level")


@query("""
SELECT m.d, m.i, eq_trend63, eq_trend252, eq_vol21, eq_vol63, breadth200, n_suspended FROM (
  SELECT d, i, round(l - lag(l, 63) OVER (ORDER BY i), 8) + 0e0 AS eq_trend63, round(l - lag(l, 252) OVER (ORDER BY i), 8) + 0e0 AS eq_trend252,
    CASE WHEN count(rr) OVER w >= 21 THEN round(stddev_samp(rr) OVER w * sqrt(252), 8) + 0e0 END AS eq_vol21,
    CASE WHEN count(rr) OVER x >= 63 THEN round(stddev_samp(rr) OVER x * sqrt(252), 8) + 0e0 END AS eq_vol63
  FROM (SELECT *, l - lag(l) OVER (ORDER BY i) AS rr FROM (SELECT d, i, sum(ln(1 + ret)) OVER (ORDER BY i) AS l FROM (
    SELECT d, i, CASE WHEN avg(CASE WHEN ret IS NOT NULL THEN 1e0 ELSE 0e0 END) >= 0.8 THEN coalesce(avg(least(greatest(ret, -0.2e0), 0.2e0)), 0e0) ELSE 0e0 END AS ret
    FROM ret WHERE code <> (SELECT min(code) FROM panel) GROUP BY d, i)))
  WINDOW w AS (ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), x AS (ORDER BY i ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) m
JOIN (SELECT d, round(avg(CASE WHEN m IS NOT NULL AND p IS NOT NULL THEN CASE WHEN p > m THEN 1e0 ELSE 0e0 END END), 8) + 0e0 AS breadth200 FROM (
  SELECT d, p, CASE WHEN count(p) OVER w >= 120 THEN avg(p) OVER w END AS m
  FROM (SELECT code, d, i, last_value(price IGNORE NULLS) OVER (PARTITION BY code ORDER BY i) AS p FROM panel WHERE code <> (SELECT min(code) FROM panel))
  WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) GROUP BY d) b USING (d)
JOIN (SELECT d, count(*) FILTER (WHERE since > 0) AS n_suspended FROM (
  SELECT d, i - max(CASE WHEN price IS NOT NULL THEN i END) OVER (PARTITION BY code ORDER BY i) AS since FROM panel) GROUP BY d) s USING (d)
""", PANEL_SQL, _RET_SQL)  # fmt: skip
def market_features_all(spark, sf):
    p = ad.panel(spark, sf)
    least = p.agg(F.min("code").alias("least"))
    out = ft.market_features(p, p.select("code").distinct().crossJoin(F.broadcast(least)).filter("code <> least"))
    cols = ("eq_trend63", "eq_trend252", "eq_vol21", "eq_vol63", "breadth200")
    return out.select("d", "i", *[r(c).alias(c) for c in cols], "n_suspended")


@query("SELECT code, i, round(y, 8) + 0e0 AS y, round(cash_sum, 8) + 0e0 AS cash_sum FROM lab", PANEL_SQL, CASH_SQL, LABEL_SQL)
def forward_label(spark, sf):
    return ad.labels(ad.panel(spark, sf)).select("code", "i", r("y").alias("y"), r("cash_sum").alias("cash_sum"))


@query("SELECT code, i, round(ln(price) - lag(ln(price), 21) OVER w - (cash_sum - lag(cash_sum, 21) OVER w), 8) + 0e0 AS excess FROM pc WINDOW w AS (PARTITION BY code ORDER BY i)", PANEL_SQL, CASH_SQL)
def cash_excess(spark, sf):
    p = ft.entity_features(ad.with_cash(ad.panel(spark, sf)))
    return p.select("code", "i", r("cash_excess_21").alias("excess"))


_FEATURE_PARTS = """
feat AS (
  SELECT code, d, i, y, ln(price) - lag(ln(price), 63) OVER w AS r63, ln(price) - lag(ln(price), 5) OVER w AS r5,
    ln(price) - lag(ln(price), 63) OVER w - (cash_sum - lag(cash_sum, 63) OVER w) AS ex63,
    price IS NOT NULL AND count(price) OVER w >= 60 AND i - max(CASE WHEN price IS NOT NULL THEN i END) OVER w <= 5 AS eligible
  FROM lab WINDOW w AS (PARTITION BY code ORDER BY i)
)"""


@query("""
SELECT f.d AS feature_asof, f.code AS fund_code,
  lead(f.d, 22) OVER (PARTITION BY f.code ORDER BY f.i) AS label_end, eligible AS eligible_at_decision,
  round(r5, 8) + 0e0 AS log_ret_5, round(r63, 8) + 0e0 AS log_ret_63, round(ex63, 8) + 0e0 AS cash_excess_63,
  CASE WHEN eligible AND r63 IS NOT NULL THEN round((rank() OVER (PARTITION BY f.d ORDER BY CASE WHEN eligible THEN r63 END NULLS LAST)
    + (count(CASE WHEN eligible THEN r63 END) OVER (PARTITION BY f.d, CASE WHEN eligible THEN r63 END) - 1) / 2e0)
    / count(CASE WHEN eligible THEN r63 END) OVER (PARTITION BY f.d), 8) + 0e0 END AS pct_rank_63,
  dense_rank() OVER (ORDER BY f.code) - 1 AS umbrella_type_code, round(y, 8) + 0e0 AS y
FROM feat f
""", PANEL_SQL, CASH_SQL, LABEL_SQL, _FEATURE_PARTS)  # fmt: skip
def feature_panel(spark, sf):
    p = ad.panel(spark, sf)
    cash = ad.with_cash(p).select("d", "cash").distinct()
    cal = p.select("d", "i").distinct()
    kinds = p.select("code").distinct().withColumn("kind", F.col("code"))
    kinds = universe.category_code(kinds, "kind", "umbrella_type_code").select("code", "umbrella_type_code", F.lit(0.175).alias("tax_rate"), F.lit(False).alias("excluded"))
    out = ft.build(p, cash, ft.macro_features(cal, ad.macro(spark, sf)), ft.market_features(p), kinds, least=60)
    cols = ("log_ret_5", "log_ret_63", "cash_excess_63", "pct_rank_63")
    return out.select("feature_asof", "fund_code", "label_end", "eligible_at_decision", *[r(c).alias(c) for c in cols], "umbrella_type_code", r("y").alias("y"))


_ALL_PARTS = """
yoy AS (SELECT date, available_from, value / lag(value, 12) OVER (ORDER BY date) - 1 AS value FROM macro WHERE series = 'cpi_index' QUALIFY lag(value, 12) OVER (ORDER BY date) IS NOT NULL),
fp AS (SELECT code, d, i, last_value(price IGNORE NULLS) OVER (PARTITION BY code ORDER BY i) AS price FROM panel),
fc AS (SELECT *, sum(ln(1 + cash)) OVER (PARTITION BY code ORDER BY i) AS cash_sum FROM (SELECT *, 0.0005e0 + 0.0001e0 * (i % 7) AS cash FROM fp)),
fr AS (SELECT *, ln(price) AS l, ln(price) - lag(ln(price)) OVER (PARTITION BY code ORDER BY i) AS r FROM fc),
fe AS (
  SELECT code, d, i, """ + ", ".join(f"l - lag(l, {k}) OVER w AS log_ret_{k}" for k in (1, 5, 21, 63, 126, 252)) + """,
    """ + ", ".join(f"l - lag(l, {k}) OVER w - (cash_sum - lag(cash_sum, {k}) OVER w) AS cash_excess_{k}" for k in (21, 63)) + """,
    CASE WHEN count(r) OVER w >= 21 THEN sqrt(sum(r * r * pow(1 / 0.94e0, i)) OVER w / sum(CASE WHEN r IS NOT NULL THEN pow(1 / 0.94e0, i) END) OVER w * 252) END AS ewma_vol,
    CASE WHEN count(r) OVER w63 >= 63 THEN stddev_samp(r) OVER w63 * sqrt(252) END AS vol_63,
    CASE WHEN count(price) OVER w126 >= 126 THEN price / max(price) OVER w126 - 1 END AS dd_from_peak_126,
    CASE WHEN count(price) OVER w252 >= 252 THEN price / max(price) OVER w252 - 1 END AS dist_peak_252,
    lead(l, 22) OVER w - lead(l, 1) OVER w - (lead(cash_sum, 22) OVER w - lead(cash_sum, 1) OVER w) AS y,
    price IS NOT NULL AND count(price) OVER w >= 60 AND i - max(CASE WHEN price IS NOT NULL THEN i END) OVER w <= 5 AS eligible
  FROM fr WINDOW w AS (PARTITION BY code ORDER BY i), w63 AS (PARTITION BY code ORDER BY i ROWS BETWEEN 62 PRECEDING AND CURRENT ROW),
    w126 AS (PARTITION BY code ORDER BY i ROWS BETWEEN 125 PRECEDING AND CURRENT ROW), w252 AS (PARTITION BY code ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)
),
fk AS (
  SELECT *, """ + ", ".join(f"""CASE WHEN eligible AND log_ret_{k} IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY CASE WHEN eligible THEN log_ret_{k} END NULLS LAST)
    + (count(CASE WHEN eligible THEN log_ret_{k} END) OVER (PARTITION BY d, CASE WHEN eligible THEN log_ret_{k} END) - 1) / 2e0)
    / count(CASE WHEN eligible THEN log_ret_{k} END) OVER (PARTITION BY d) END AS pct_rank_{k}""" for k in (63, 252)) + """, dense_rank() OVER (ORDER BY code) - 1 AS umbrella_type_code, 0.175e0 AS tax_rate FROM fe
),
mi AS (
  SELECT d, i, sum(ln(1 + ret)) OVER (ORDER BY i) AS l FROM (
    SELECT d, i, CASE WHEN avg(CASE WHEN ret IS NOT NULL THEN 1e0 ELSE 0e0 END) >= 0.8 THEN coalesce(avg(least(greatest(ret, -0.2e0), 0.2e0)), 0e0) ELSE 0e0 END AS ret
    FROM (SELECT d, i, price / nullif(lag(price) OVER (PARTITION BY code ORDER BY i), 0) - 1 AS ret FROM fp) GROUP BY d, i)
),
mk AS (
  SELECT m.d, eq_trend63, eq_vol21, breadth200 FROM (
    SELECT d, l - lag(l, 63) OVER (ORDER BY i) AS eq_trend63, CASE WHEN count(rr) OVER x >= 21 THEN stddev_samp(rr) OVER x * sqrt(252) END AS eq_vol21
    FROM (SELECT *, l - lag(l) OVER (ORDER BY i) AS rr FROM mi) WINDOW x AS (ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) m
  JOIN (SELECT d, avg(CASE WHEN m IS NOT NULL AND price IS NOT NULL THEN CASE WHEN price > m THEN 1e0 ELSE 0e0 END END) AS breadth200 FROM (
    SELECT d, price, CASE WHEN count(price) OVER w >= 120 THEN avg(price) OVER w END AS m FROM fp
    WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) GROUP BY d) b USING (d)
),
mc AS (
  SELECT d, p AS policy_rate, p - lag(p, 63) OVER w AS d_policy_63, yoy AS cpi_yoy, p - yoy AS real_rate, l - lag(l, 63) OVER w AS usdtry_ret63,
    CASE WHEN count(rr) OVER x >= 21 THEN stddev_samp(rr) OVER x * sqrt(252) END AS usdtry_vol21
  FROM (SELECT *, l - lag(l) OVER (ORDER BY d) AS rr FROM (
    SELECT cal.d, p.value / 100 AS p, ln(x.value) AS l, y.value AS yoy FROM cal
    LEFT JOIN LATERAL (SELECT value FROM macro m WHERE m.series = 'policy_rate' AND m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) p ON true
    LEFT JOIN LATERAL (SELECT value FROM macro m WHERE m.series = 'usdtry' AND m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) x ON true
    LEFT JOIN LATERAL (SELECT value FROM yoy m WHERE m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) y ON true))
  WINDOW w AS (ORDER BY d), x AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
),
days AS (
  SELECT d, coalesce(lead(d, 1) OVER w, d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS decision_at, lead(d, 22) OVER w AS label_end,
    CASE WHEN lead(d, 22) OVER w IS NOT NULL THEN coalesce(lead(d, 23) OVER w, (SELECT max(d) + CASE isodow(max(d)) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END FROM cal)) END AS label_available_at
  FROM cal WINDOW w AS (ORDER BY i)
)"""


@query("SELECT f.d AS feature_asof, f.code AS fund_code, CAST(decision_at AS DATE) AS decision_at, label_end, CAST(label_available_at AS DATE) AS label_available_at, "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS) + " AS feature_ready, label_end IS NOT NULL AS label_ready, eligible AS eligible_at_decision, false AS policy_today_excluded, "
    + ", ".join("umbrella_type_code" if c == "umbrella_type_code" else f"round({c}, 7) + 0e0 AS {c}" for c in FEATURE_COLUMNS)
    + ", round(y, 7) + 0e0 AS y FROM fk f JOIN days USING (d) LEFT JOIN mc USING (d) LEFT JOIN mk USING (d)", PANEL_SQL, MACRO_SQL, _ALL_PARTS)
def feature_panel_all(spark, sf):
    """All 35 columns of the panel, prices carried over gaps."""
    p = ad.panel(spark, sf).withColumn("price", w.fill_forward())
    cash = ad.with_cash(p).select("d", "cash").distinct()
    cal = p.select("d", "i").distinct()
    kinds = universe.category_code(p.select("code").distinct().withColumn("kind", F.col("code")), "kind", "umbrella_type_code")
    kinds = kinds.select("code", "umbrella_type_code", F.lit(0.175).alias("tax_rate"), F.lit(False).alias("excluded"))
    out = ft.build(p, cash, ft.macro_features(cal, ad.macro(spark, sf)), ft.market_features(p), kinds, least=60)
    whole = {"umbrella_type_code"}
    return out.select(*TIME_COLUMNS, *MASK_COLUMNS, *[F.col(c) if c in whole else r(c, 7).alias(c) for c in FEATURE_COLUMNS], r("y", 7).alias("y"))


_STEP_SQL = """
SELECT cal.d, {out} FROM cal LEFT JOIN LATERAL (
  SELECT value FROM {table} m WHERE {where} m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) v ON true"""


@query(_STEP_SQL.format(out="round(v.value, 6) + 0e0 AS value", table="macro", where="m.series = 'cpi_index' AND"), PANEL_SQL, MACRO_SQL)
def macro_pit_daily(spark, sf):
    cal = calendars.trading_calendar(ad.observations(spark, sf))
    cpi = ad.macro(spark, sf).filter("series = 'cpi_index'")
    return joins.step_function(cal, cpi, "available_from", "value", "date").select("d", r("value", 6).alias("value"))


@query(_STEP_SQL.format(out="round(v.value, 8) + 0e0 AS yoy", table="yoy", where=""), PANEL_SQL, MACRO_SQL, """
yoy AS (SELECT date, available_from, value / lag(value, 12) OVER (ORDER BY date) - 1 AS value FROM macro WHERE series = 'cpi_index' QUALIFY lag(value, 12) OVER (ORDER BY date) IS NOT NULL)
""")  # fmt: skip
def macro_yoy_pit(spark, sf):
    cal = calendars.trading_calendar(ad.observations(spark, sf))
    yoy = ft.yearly_change(ad.macro(spark, sf).filter("series = 'cpi_index'"), "available_from", "value", "date")
    return joins.step_function(cal, yoy, "available_from", "yoy", "date").select("d", r("yoy").alias("yoy"))


@query("""
SELECT d, round(p, 8) + 0e0 AS policy_rate, round(p - lag(p, 63) OVER (ORDER BY d), 8) + 0e0 AS d_policy_63 FROM (
  SELECT cal.d, v.value / 100 AS p FROM cal LEFT JOIN LATERAL (
    SELECT value FROM macro m WHERE m.series = 'policy_rate' AND m.available_from <= cal.d ORDER BY m.available_from DESC LIMIT 1) v ON true)
""", PANEL_SQL, MACRO_SQL)  # fmt: skip
def macro_features(spark, sf):
    cal = calendars.trading_calendar(ad.observations(spark, sf))
    return ft.macro_features(cal, ad.macro(spark, sf)).select("d", r("policy_rate").alias("policy_rate"), r("d_policy_63").alias("d_policy_63"))


@query("""
SELECT d, round(p, 8) + 0e0 AS policy_rate, round(p - lag(p, 63) OVER w, 8) + 0e0 AS d_policy_63, round(yoy, 8) + 0e0 AS cpi_yoy, round(p - yoy, 8) + 0e0 AS real_rate,
  round(l - lag(l, 63) OVER w, 8) + 0e0 AS usdtry_ret63, CASE WHEN count(rr) OVER x >= 21 THEN round(stddev_samp(rr) OVER x * sqrt(252), 8) + 0e0 END AS usdtry_vol21
FROM (SELECT *, l - lag(l) OVER (ORDER BY d) AS rr FROM (
  SELECT cal.d, p.value / 100 AS p, ln(x.value) AS l, y.value AS yoy FROM cal
  LEFT JOIN LATERAL (SELECT value FROM macro m WHERE m.series = 'policy_rate' AND m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) p ON true
  LEFT JOIN LATERAL (SELECT value FROM macro m WHERE m.series = 'usdtry' AND m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) x ON true
  LEFT JOIN LATERAL (SELECT value FROM yoy m WHERE m.available_from <= cal.d ORDER BY m.available_from DESC, m.date DESC LIMIT 1) y ON true))
WINDOW w AS (ORDER BY d), x AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
""", PANEL_SQL, MACRO_SQL, """
yoy AS (SELECT date, available_from, value / lag(value, 12) OVER (ORDER BY date) - 1 AS value FROM macro WHERE series = 'cpi_index' QUALIFY lag(value, 12) OVER (ORDER BY date) IS NOT NULL)
""")  # fmt: skip
def macro_features_all(spark, sf):
    cal = calendars.trading_calendar(ad.observations(spark, sf))
    cols = ("policy_rate", "d_policy_63", "cpi_yoy", "real_rate", "usdtry_ret63", "usdtry_vol21")
    return ft.macro_features(cal, ad.macro(spark, sf)).select("d", *[r(c).alias(c) for c in cols])


@query("""
SELECT date, round(value, 6) + 0e0 AS value FROM macro WHERE series = 'policy_rate'
QUALIFY row_number() OVER (ORDER BY date) = 1 OR value IS DISTINCT FROM lag(value) OVER (ORDER BY date)
""", MACRO_SQL)  # fmt: skip
def step_changes(spark, sf):
    return w.changes_only(ad.macro(spark, sf).filter("series = 'policy_rate'"), "series", "date", "value").select("date", r("value", 6).alias("value"))


@query("SELECT series, date, value FROM macro WHERE available_from <= DATE '1998-06-30'", MACRO_SQL)
def visible_asof(spark, sf):
    return ad.macro(spark, sf).filter(F.col("available_from") <= F.lit("1998-06-30").cast("date")).select("series", "date", "value")


@query("""
SELECT code, round(avg(coalesce(r, 0)), 8) + 0e0 AS mean_r, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM (
  SELECT code, i, r, i - row_number() OVER (PARTITION BY code ORDER BY i) AS g FROM lab WHERE r > 0.02) GROUP BY code, g
""", PANEL_SQL, CASH_SQL, LABEL_SQL)  # fmt: skip
def episodes(spark, sf):
    hits = ad.labels(ad.panel(spark, sf)).filter("r > 0.02")
    e = w.episodes(hits).groupBy("code", "episode").agg(r(F.avg(F.coalesce("r", F.lit(0.0)))).alias("mean_r"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"))
    return e.drop("episode")


@query("""
SELECT code, d, i, CASE WHEN r - x > 0.02 THEN 1e0 WHEN r - x < -0.02 THEN 0.35e0 ELSE 0.65e0 END AS level FROM (
  SELECT code, d, i, ln(price) - lag(ln(price), 63) OVER w AS r, cash_sum - lag(cash_sum, 63) OVER w AS x FROM pc WINDOW w AS (PARTITION BY code ORDER BY i))
WHERE r IS NOT NULL
""", PANEL_SQL, CASH_SQL)  # fmt: skip
def spread_gate(spark, sf):
    from paneltide.operators.strategies import spread_levels

    p = ad.with_cash(ad.panel(spark, sf)).withColumn("cash_sum", w.running_log_growth("cash"))
    return spread_levels(p).select("code", "d", "i", "level")


@query("""
SELECT i, d, CASE WHEN above AND calm THEN 1e0 WHEN above OR calm THEN 0.65e0 ELSE 0.35e0 END AS level FROM (
  SELECT i, d, l > m AS above, v < q AS calm FROM (
    SELECT *, CASE WHEN count(v) OVER (ORDER BY i) >= 1 THEN quantile_cont(v, 0.8) OVER (ORDER BY i) END AS q FROM (
      SELECT i, d, l, CASE WHEN count(l) OVER (ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) >= 40 THEN avg(l) OVER (ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) END AS m,
        CASE WHEN count(rr) OVER (ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) >= 21 THEN stddev_samp(rr) OVER (ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END AS v
      FROM (SELECT *, l - lag(l) OVER (ORDER BY i) AS rr FROM (SELECT d, i, sum(ln(1 + ret)) OVER (ORDER BY i) AS l FROM idx)))) WHERE m IS NOT NULL AND v IS NOT NULL)
""", PANEL_SQL, _RET_SQL, _INDEX_SQL)  # fmt: skip
def rule_gate(spark, sf):
    from paneltide.operators.strategies import rule_levels

    return rule_levels(ft.index_level(ad.panel(spark, sf)), mean_rows=40, vol_rows=21).select("i", "d", "level")


@query("SELECT code, d, first FROM (SELECT code, d, row_number() OVER (PARTITION BY code, date_trunc('month', d) ORDER BY d) = 1 AS first FROM panel) WHERE first", PANEL_SQL)
def first_of_month(spark, sf):
    cal = calendars.trading_calendar(ad.observations(spark, sf)).withColumn("first", calendars.first_of("month")).filter("first")
    return ad.panel(spark, sf).join(F.broadcast(cal), "d", "left_semi").select("code", "d", F.lit(True).alias("first"))


@query("""
SELECT i // 26 AS split, i AS train_start, i + 103 AS train_end, i + 104 AS test_start, i + 129 AS test_end
FROM cal WHERE i % 26 = 0 AND i + 130 <= (SELECT count(*) FROM cal)
""", PANEL_SQL)  # fmt: skip
def wf_splits(spark, sf):
    return calendars.walk_forward(calendars.trading_calendar(ad.observations(spark, sf)), 104, 26)


@query("SELECT code, count(price) AS n, min(CASE WHEN price IS NOT NULL THEN d END) AS first_d, max(CASE WHEN price IS NOT NULL THEN d END) AS last_d FROM panel GROUP BY code", PANEL_SQL)
def nav_stats(spark, sf):
    have = F.col("price").isNotNull()
    return ad.panel(spark, sf).groupBy("code").agg(F.count("price").alias("n"), F.min(F.when(have, F.col("d"))).alias("first_d"), F.max(F.when(have, F.col("d"))).alias("last_d"))


@query("""
SELECT code, d, i, rank FROM (SELECT code, d, i, row_number() OVER (PARTITION BY d ORDER BY ln(price) - m DESC, code) AS rank FROM (
  SELECT *, lag(ln(price), 13) OVER (PARTITION BY code ORDER BY i) AS m FROM panel) WHERE m IS NOT NULL AND price IS NOT NULL) WHERE rank <= 3
""", PANEL_SQL)  # fmt: skip
def topn_scores(spark, sf):
    p = ad.panel(spark, sf).withColumn("s", w.log_return(13)).filter("s IS NOT NULL")
    return rel.top_per_group(p, "d", [F.col("s").desc(), F.col("code")], 3).select("code", "d", "i", "rank")


@query("""
SELECT code, d FROM (SELECT code, d, row_number() OVER (PARTITION BY d ORDER BY CASE WHEN held AND rk <= 4 THEN 0 ELSE 1 END, rk) AS q FROM (
  SELECT code, d, ascii(code) % 2 = 0 AS held, row_number() OVER (PARTITION BY d ORDER BY ln(price) - m DESC, code) AS rk FROM (
    SELECT *, lag(ln(price), 13) OVER (PARTITION BY code ORDER BY i) AS m FROM panel) WHERE m IS NOT NULL AND price IS NOT NULL)) WHERE q <= 2
""", PANEL_SQL)  # fmt: skip
def buffered_topn(spark, sf):
    p = ad.panel(spark, sf).withColumn("s", w.log_return(13)).filter("s IS NOT NULL").withColumn("held", F.ascii("code") % 2 == 0)
    return rel.buffered_top(p, "held", 2, 2.0, [F.col("s").desc(), F.col("code")], "d").select("code", "d")


@query("""
SELECT a.code AS a, b.code AS b, round(corr(a.r, b.r), 8) + 0e0 AS rho, count(*) AS n
FROM lab a JOIN lab b ON a.i = b.i AND a.code < b.code WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2
""", PANEL_SQL, CASH_SQL, LABEL_SQL)  # fmt: skip
def pairwise_corr(spark, sf):
    lab = ad.labels(ad.panel(spark, sf)).filter("r IS NOT NULL").select("code", "i", "r")
    b = lab.select(F.col("code").alias("b"), "i", F.col("r").alias("rb"))
    j = lab.withColumnRenamed("code", "a").join(b, "i").filter("a < b")
    return j.groupBy("a", "b").agg(r(F.corr("r", "rb")).alias("rho"), F.count("*").alias("n"))


@query("""
SELECT code, i, name, round(value, 6) + 0e0 AS value FROM (
  SELECT code, i, 'price' AS name, price AS value FROM pc UNION ALL SELECT code, i, 'cash', cash FROM pc) WHERE value IS NOT NULL
""", PANEL_SQL, CASH_SQL)  # fmt: skip
def unpivot_long(spark, sf):
    p = ad.with_cash(ad.panel(spark, sf)).select("code", "i", "price", "cash")
    return rel.unpivot(p, ["code", "i"], ["price", "cash"], "name", "value").select("code", "i", "name", r("value", 6).alias("value"))


@query("SELECT DISTINCT CAST(f AS DOUBLE) AS z, code, i FROM (SELECT code, i, round(coalesce(least(greatest((r - (SELECT avg(r) FROM lab WHERE i < 200)) / (SELECT stddev_pop(r) FROM lab WHERE i < 200), -3e0), 3e0), 0e0), 6) + 0e0 AS f FROM lab)", PANEL_SQL, CASH_SQL, LABEL_SQL)
def standardise_clip(spark, sf):
    lab = ad.labels(ad.panel(spark, sf)).select("code", "i", "r")
    return ft.standardised(lab, ["r"], F.col("i") < 200).select(r("r", 6).alias("z"), "code", "i")


@query("""
SELECT fund_code, dense_rank() OVER (ORDER BY v) - 1 AS type_code FROM (
  SELECT fund_code, lower(translate(trim(regexp_replace(umbrella_type, '\\s+', ' ', 'g')), 'İIŞĞÜÖÇ', 'iışğüöç')) AS v FROM master WHERE snapshot_date = DATE '1998-01-05')
""", MASTER_SQL)  # fmt: skip
def category_code(spark, sf):
    first = ad.master(spark, sf).filter("snapshot_date = DATE '1998-01-05'")
    return universe.category_code(first, "umbrella_type", "type_code").select("fund_code", "type_code")


@query("""
SELECT founder, umbrella_type, n FROM (SELECT *, row_number() OVER (PARTITION BY founder ORDER BY n DESC, umbrella_type) AS k FROM (
  SELECT founder, umbrella_type, count(*) AS n FROM master GROUP BY 1, 2)) WHERE k = 1
""", MASTER_SQL)  # fmt: skip
def mode_by_founder(spark, sf):
    return rel.mode(ad.master(spark, sf), "founder", "umbrella_type")


@query("""
SELECT code, i, bool_or(a) AS in_left, bool_or(NOT a) AS in_right FROM (
  SELECT code, i, true AS a FROM panel WHERE price IS NOT NULL AND i % 3 <> 0 UNION ALL SELECT code, i, false FROM lab WHERE y IS NOT NULL) GROUP BY 1, 2
""", PANEL_SQL, CASH_SQL, LABEL_SQL)  # fmt: skip
def key_sets(spark, sf):
    p = ad.panel(spark, sf)
    return rel.key_sets(p.filter("price IS NOT NULL AND i % 3 <> 0"), ad.labels(p).filter("y IS NOT NULL"), ["code", "i"])
