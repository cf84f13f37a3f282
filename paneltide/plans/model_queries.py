"""Baselines, conformal calibration, selection and model statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paneltide.functions.stats import pinball
from paneltide.operators import attribution, conformal as cf, windows as w
from paneltide.plans import adapters as ad
from paneltide.plans.adapters import CASH_SQL, LABEL_SQL, PANEL_SQL, PREDICTION_SQL
from paneltide.plans.registry import query, rounded as r

BASE = (PANEL_SQL, CASH_SQL, LABEL_SQL, PREDICTION_SQL)


def _pred(spark, sf) -> DataFrame:
    return ad.predictions(ad.panel(spark, sf))


def _scored(spark, sf) -> DataFrame:
    return _pred(spark, sf).filter(F.col("q50").isNotNull())


@query("SELECT code, i, round(q10, 8) + 0e0 AS q10, round(q50, 8) + 0e0 AS q50, round(q90, 8) + 0e0 AS q90 FROM pred WHERE q50 IS NOT NULL", *BASE)
def baseline_empirical_quantile(spark, sf):
    return _scored(spark, sf).select("code", "i", *[r(c).alias(c) for c in ("q10", "q50", "q90")])


@query("SELECT code, i, 0e0 AS q50 FROM pred WHERE q50 IS NOT NULL", *BASE)
def baseline_zero(spark, sf):
    return _scored(spark, sf).select("code", "i", F.lit(0.0).alias("q50"))


@query("""
SELECT code, i, CASE WHEN count(x) OVER w >= 21 THEN round(21 * avg(x) OVER w, 8) + 0e0 END AS q50 FROM (
  SELECT code, i, r - ln(1 + cash) AS x FROM lab) WINDOW w AS (PARTITION BY code ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
""", PANEL_SQL, CASH_SQL, LABEL_SQL)  # fmt: skip
def baseline_cash_excess(spark, sf):
    x = ad.labels(ad.panel(spark, sf)).withColumn("x", F.col("r") - F.log1p("cash"))
    return x.select("code", "i", r(21 * w.full_window(21, F.col("x"), F.avg("x"))).alias("q50"))


_LOSS = "CASE WHEN y - q{k} >= 0 THEN {a}e0 * (y - q{k}) ELSE ({a}e0 - 1) * (y - q{k}) END"


@query(" UNION ALL ".join(f"SELECT {a}e0 AS alpha, round(avg({_LOSS.format(k=k, a=a)}), 8) + 0e0 AS loss, count(y - q{k}) AS n FROM pred" for k, a in ((10, 0.1), (50, 0.5), (90, 0.9))), *BASE)
def pinball_by_alpha(spark, sf):
    p = _pred(spark, sf)
    one = lambda k, a: p.agg(F.lit(a).alias("alpha"), r(F.avg(pinball(F.col("y"), F.col(f"q{k}"), a))).alias("loss"), F.count(F.col("y") - F.col(f"q{k}")).alias("n"))
    return reduce(DataFrame.unionByName, [one(k, a) for k, a in ((10, 0.1), (50, 0.5), (90, 0.9))])


@query(f"SELECT round(avg({_LOSS.format(k=50, a=0.5).replace('q50', '0e0')}) - avg({_LOSS.format(k=50, a=0.5)}), 8) + 0e0 AS fva FROM pred WHERE q50 IS NOT NULL AND y IS NOT NULL", *BASE)
def fva(spark, sf):
    p = _scored(spark, sf).filter("y IS NOT NULL")
    return p.agg(r(F.avg(pinball(F.col("y"), F.lit(0.0), 0.5)) - F.avg(pinball(F.col("y"), F.col("q50"), 0.5))).alias("fva"))


@query("""
SELECT d, count(*) AS n, round(corr(a, b), 8) + 0e0 AS ic FROM (
  SELECT d, rank() OVER (PARTITION BY d ORDER BY q50) + (count(*) OVER (PARTITION BY d, q50) - 1) / 2e0 AS a,
    rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2e0 AS b
  FROM pred WHERE q50 IS NOT NULL AND y IS NOT NULL) GROUP BY d HAVING count(*) >= 4 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0
""", *BASE)  # fmt: skip
def rank_ic_daily(spark, sf):
    return cf.rank_ic(_scored(spark, sf), "q50", least=4).select("d", "n", r("ic").alias("ic"))


_CAL = """
days AS (SELECT DISTINCT i + 1 AS D FROM pred WHERE q50 IS NOT NULL),
resid AS (SELECT i, y - q50 AS v, greatest(q10 - y, y - q90) AS score, y FROM pred WHERE q50 IS NOT NULL AND y IS NOT NULL),
win AS (SELECT days.D, resid.* FROM days JOIN resid ON resid.i BETWEEN days.D - 149 AND days.D - 23)"""
_PVAL = """
nn AS (SELECT D, count(*) AS n FROM win GROUP BY D),
pv AS (
  SELECT p.code, p.d, p.i + 1 AS dd, p.q50, coalesce(nn.n, 0) AS n,
    CASE WHEN coalesce(nn.n, 0) < 200 THEN 'insufficient_calibration' ELSE 'ok' END AS flag,
    CASE WHEN nn.n >= 200 THEN (1 + (SELECT count(*) FROM win w WHERE w.D = p.i + 1 AND {v} <= -p.q50)) / (nn.n + 1e0) END AS p
  FROM pred p LEFT JOIN nn ON nn.D = p.i + 1 WHERE p.q50 IS NOT NULL
)"""
_P = _PVAL.format(v="w.v")


@query("SELECT code, d, dd AS D_pos, round(q50, 8) + 0e0 AS q50, round(p, 8) + 0e0 AS p_value, n AS n_calib, flag AS quality_flag FROM pv", *BASE, _CAL, _P)
def pvalues(spark, sf):
    return cf.p_values(_scored(spark, sf)).select("code", "d", F.col("at").alias("D_pos"), r("q50").alias("q50"), r("p_value").alias("p_value"), "n_calib", "quality_flag")


@query("SELECT code, d, round(p, 8) + 0e0 AS p_value FROM pv", *BASE, _CAL, _PVAL.format(v="CASE WHEN w.y > 0 THEN 'infinity'::DOUBLE ELSE w.v END"))
def pvalues_clipped(spark, sf):
    return cf.p_values(_scored(spark, sf), clipped=True).select("code", "d", r("p_value").alias("p_value"))


_BH = "coalesce(p IS NOT NULL AND rk <= max(CASE WHEN p <= rk * {q}e0 / m THEN rk END) OVER (PARTITION BY dd), false)"
_BH_SQL = "bh AS (SELECT *, row_number() OVER (PARTITION BY dd ORDER BY p NULLS LAST, code) AS rk, count(p) OVER (PARTITION BY dd) AS m FROM pv)"


@query("SELECT code, d, dd AS D_pos, round(q50, 8) + 0e0 AS q50, round(p, 8) + 0e0 AS p_value, n AS n_calib, flag AS quality_flag, " + ", ".join(f"{_BH.format(q=q / 100)} AS selected_q{q}" for q in (10, 20, 30)) + " FROM bh", *BASE, _CAL, _P, _BH_SQL)
def bh_grid(spark, sf):
    out = cf.select_bh(cf.p_values(_scored(spark, sf)))
    return out.select("code", "d", F.col("at").alias("D_pos"), r("q50").alias("q50"), r("p_value").alias("p_value"), "n_calib", "quality_flag", "selected_q10", "selected_q20", "selected_q30")


@query(f"SELECT d, count(*) FILTER (WHERE s) AS candidates FROM (SELECT d, {_BH.format(q=0.2)} AS s FROM bh) GROUP BY d", *BASE, _CAL, _P, _BH_SQL)
def candidate_counts(spark, sf):
    return cf.select_bh(cf.p_values(_scored(spark, sf)), (0.2,)).groupBy("d").agg(F.count_if("selected_q20").alias("candidates"))


@query(f"""
SELECT year(d) AS yr, round(avg(CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END), 8) + 0e0 AS positive, count(*) AS n
FROM (SELECT b.*, {_BH.format(q=0.2)} AS s FROM bh b) b JOIN lab USING (code, d) WHERE s AND y IS NOT NULL GROUP BY 1
""", *BASE, _CAL, _P, _BH_SQL)  # fmt: skip
def selected_positive_rate(spark, sf):
    p = _scored(spark, sf)
    s = cf.select_bh(cf.p_values(p), (0.2,)).filter("selected_q20").select("code", "d")
    hit = p.join(s, ["code", "d"], "left_semi").filter("y IS NOT NULL")
    return hit.groupBy(F.year("d").cast("bigint").alias("yr")).agg(r(F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0))).alias("positive"), F.count("*").alias("n"))


_CQR = """
rk AS (SELECT D, score, row_number() OVER (PARTITION BY D ORDER BY score) AS k, count(*) OVER (PARTITION BY D) AS n FROM win WHERE score IS NOT NULL),
st AS (SELECT D, max(n) AS n, CAST(ceil(round((max(n) + 1) * 0.8e0, 9)) AS BIGINT) AS kk, max(CASE WHEN k = CAST(ceil(round((n + 1) * 0.8e0, 9)) AS BIGINT) THEN score END) AS s FROM rk GROUP BY D),
cq AS (
  SELECT p.code, p.d, p.i, p.y, coalesce(st.n, 0) AS n, CASE WHEN st.n >= 200 AND kk <= st.n THEN q10 - s END AS lower, CASE WHEN st.n >= 200 AND kk <= st.n THEN q90 + s END AS upper,
    CASE WHEN coalesce(st.n, 0) < 200 THEN 'insufficient_calibration' WHEN kk > st.n THEN 'k_gt_n' ELSE 'ok' END AS flag
  FROM pred p LEFT JOIN st ON st.D = p.i + 1 WHERE q50 IS NOT NULL
)"""


@query("SELECT code, i, round(lower, 8) + 0e0 AS lower, round(upper, 8) + 0e0 AS upper, n AS n_calib, flag AS quality_flag FROM cq", *BASE, _CAL, _CQR)
def cqr_fixed_alpha(spark, sf):
    return cf.fixed_alpha(_scored(spark, sf), 0.2).select("code", "i", r("lower").alias("lower"), r("upper").alias("upper"), "n_calib", "quality_flag")


@query("""
SELECT CAST(date_trunc('month', d) AS DATE) AS period, round(avg(CASE WHEN y >= lower AND y <= upper THEN 1e0 ELSE 0e0 END), 8) + 0e0 AS coverage, count(*) AS n, round(avg(upper - lower), 8) + 0e0 AS width
FROM cq WHERE y IS NOT NULL AND lower IS NOT NULL GROUP BY 1
""", *BASE, _CAL, _CQR)  # fmt: skip
def coverage_monthly(spark, sf):
    return cf.coverage(cf.fixed_alpha(_scored(spark, sf), 0.2)).select("period", r("coverage").alias("coverage"), "n", r("width").alias("width"))


@query("""
SELECT series, round(avg(c), 8) + 0e0 AS coverage, round(avg(w), 8) + 0e0 AS width, count(*) AS months, CAST(sum(m) AS BIGINT) AS n FROM (
  SELECT series, date_trunc('month', d) AS month, avg(CASE WHEN y >= lower AND y <= upper THEN 1e0 ELSE 0e0 END) AS c, avg(upper - lower) AS w, count(*) AS m FROM (
    SELECT 'all' AS series, * FROM rows_ UNION ALL SELECT 'positive', * FROM rows_ WHERE lower > 0 UNION ALL SELECT 'top', * FROM rows_ WHERE t <= 2) GROUP BY 1, 2) GROUP BY series
""", *BASE, _CAL, _CQR, "rows_ AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY lower DESC, code) AS t FROM cq WHERE y IS NOT NULL AND lower IS NOT NULL)")  # fmt: skip
def coverage_diag(spark, sf):
    out = cf.coverage_series(cf.fixed_alpha(_scored(spark, sf), 0.2), 2).filter("series <> 'random'")
    return out.select("series", r("coverage").alias("coverage"), r("width").alias("width"), "months", "n")


@query("""
SELECT w.D AS at, round(avg({m}), 8) + 0e0 AS model_loss, round(avg({b}), 8) + 0e0 AS baseline_loss, coalesce(avg({m}) >= avg({b}), false) AS stop
FROM (SELECT days.D, p.q50 AS q, p.y FROM days JOIN pred p ON p.i BETWEEN days.D - 149 AND days.D - 23 WHERE p.y IS NOT NULL AND p.q50 IS NOT NULL) w GROUP BY w.D
""".format(m="CASE WHEN y - q >= 0 THEN 0.5e0 * (y - q) ELSE -0.5e0 * (y - q) END", b="CASE WHEN y >= 0 THEN 0.5e0 * y ELSE -0.5e0 * y END"), *BASE, _CAL)  # fmt: skip
def kill_switch(spark, sf):
    p = _scored(spark, sf).withColumn("zero", F.lit(0.0))
    return cf.kill_switch(p, {0.5: "q50"}, {0.5: "zero"}).filter("model_loss IS NOT NULL").select("at", r("model_loss").alias("model_loss"), r("baseline_loss").alias("baseline_loss"), "stop")


@query("""
SELECT code, i, round(alpha, 8) + 0e0 AS alpha FROM path WHERE i IS NOT NULL
""", *BASE, """
err AS (SELECT code, i, row_number() OVER (PARTITION BY code ORDER BY i) AS n, CASE WHEN y < 0 THEN 1e0 ELSE 0e0 END AS err FROM pred WHERE y IS NOT NULL),
path AS (
  WITH RECURSIVE step AS (
    SELECT code, CAST(NULL AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, 0.2e0 AS alpha FROM (SELECT DISTINCT code FROM err)
    UNION ALL
    SELECT e.code, e.i, e.n, least(greatest(s.alpha + 0.01e0 * (0.2e0 - e.err), 0.02e0), 0.5e0) FROM step s JOIN err e ON e.code = s.code AND e.n = s.n + 1)
  SELECT * FROM step)
""")  # fmt: skip
def alpha_path(spark, sf):
    err = _pred(spark, sf).filter("y IS NOT NULL").select("code", "i", F.when(F.col("y") < 0, 1.0).otherwise(0.0).alias("err"))
    return cf.alpha_path(err, 0.2, 0.01).select("code", "i", r("alpha").alias("alpha"))


@query()
def aci_calibrated(spark, sf):
    p = _scored(spark, sf).select(F.explode(F.array(F.lit("t20"), F.lit("t10"))).alias("config"), "*")
    return cf.adaptive(p, {"t20": 0.2, "t10": 0.1}, 0.01)


_SELECT_END = "1999-06-30"
#: Intervals of a constant level of 0.3, beside those of 0.2.
_CQR_LOOSE = _CQR.replace("0.8e0", "0.7e0").replace("rk AS", "rk3 AS").replace("FROM rk ", "FROM rk3 ").replace("st AS", "st3 AS").replace("JOIN st ", "JOIN st3 st ").replace("cq AS", "cq3 AS")
_CELLS = f"""
given AS (SELECT 'issued' AS run, code, d, y, lower, upper FROM cq3 UNION ALL SELECT 'constant', code, d, y, lower, upper FROM cq),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run, d, lower > 0 ORDER BY lower DESC, code) AS t, row_number() OVER (PARTITION BY run, d, lower > 0 ORDER BY md5('0|' || code || '|' || d), code) AS u FROM given WHERE lower IS NOT NULL),
tagged AS (
  SELECT 'all' AS series, * FROM ranked UNION ALL SELECT 'positive', * FROM ranked WHERE lower > 0
  UNION ALL SELECT 'random', * FROM ranked WHERE lower > 0 AND u <= 1 UNION ALL SELECT 'top', * FROM ranked WHERE lower > 0 AND t <= 1),
cells AS (
  SELECT run, series, CASE WHEN d <= DATE '{_SELECT_END}' THEN 'selection' ELSE 'outside' END AS period, CAST(date_trunc('month', d) AS DATE) AS month,
    avg(CASE WHEN y BETWEEN lower AND upper THEN 1e0 ELSE 0e0 END) AS coverage, avg(upper - lower) AS width, count(*) AS n FROM tagged WHERE y IS NOT NULL GROUP BY ALL),
means AS (
  SELECT run, series, period, avg(coverage) AS coverage, avg(width) AS width, count(*) AS months, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL
  UNION ALL SELECT run, series, 'both', avg(coverage), avg(width), count(*), CAST(sum(n) AS BIGINT) FROM cells GROUP BY ALL)"""


def _levels(spark, sf):
    p = _scored(spark, sf)
    return cf.fixed_alpha(p, 0.3), cf.fixed_alpha(p, 0.2)


@query("SELECT series, period, month, round(coverage, 8) + 0e0 AS coverage, round(width, 8) + 0e0 AS width, n FROM cells WHERE run = 'constant'", *BASE, _CAL, _CQR, _CQR_LOOSE, _CELLS)
def coverage_cells(spark, sf):
    out = attribution.monthly(_levels(spark, sf)[1], _SELECT_END, 1)
    return out.select("series", "period", "month", r("coverage").alias("coverage"), r("width").alias("width"), "n")


@query("SELECT series, period, round(coverage, 8) + 0e0 AS coverage, round(width, 8) + 0e0 AS width, months, n FROM means WHERE run = 'constant'", *BASE, _CAL, _CQR, _CQR_LOOSE, _CELLS)
def coverage_periods(spark, sf):
    out = attribution.by_period(attribution.monthly(_levels(spark, sf)[1], _SELECT_END, 1))
    return out.select("series", "period", r("coverage").alias("coverage"), r("width").alias("width"), "months", "n")


_PARTS = ("gap", "base", "pool", "ranking", "level", "width", "constant_width")


def _gap(issued, constant):
    out = attribution.gap_parts(issued, constant, 0.2, _SELECT_END, 1)
    return out.select("period", *[r(c).alias(c) for c in _PARTS], "constant_months", "dominant", "few")


@query("""
SELECT period, """ + ", ".join(f"round({c}, 8) + 0e0 AS {c}" for c in _PARTS) + """, constant_months, constant_months < 6 AS few,
  CASE WHEN most < 0 THEN NULL WHEN p = most THEN 'pool' WHEN k = most THEN 'ranking' ELSE 'level' END AS dominant FROM (
SELECT *, greatest(p, k, l) AS most FROM (
SELECT *, coalesce(round(abs(pool), 12), -1) AS p, coalesce(round(abs(ranking), 12), -1) AS k, coalesce(round(abs(level), 12), -1) AS l FROM (
SELECT *, top - 0.8e0 AS gap, all_ - 0.8e0 AS base, random - all_ AS pool, top - random AS ranking, top - top_constant AS level FROM (
SELECT period, max(coverage) FILTER (WHERE run = 'issued' AND series = 'all') AS all_, max(coverage) FILTER (WHERE run = 'issued' AND series = 'random') AS random,
  max(coverage) FILTER (WHERE run = 'issued' AND series = 'top') AS top, max(coverage) FILTER (WHERE run = 'constant' AND series = 'top') AS top_constant,
  max(width) FILTER (WHERE run = 'issued' AND series = 'top') AS width, max(width) FILTER (WHERE run = 'constant' AND series = 'top') AS constant_width,
  coalesce(max(months) FILTER (WHERE run = 'constant' AND series = 'top'), 0) AS constant_months FROM means GROUP BY period))))
""", *BASE, _CAL, _CQR, _CQR_LOOSE, _CELLS)  # fmt: skip
def coverage_gap_parts(spark, sf):
    return _gap(*_levels(spark, sf))


@query()
def coverage_gap_adaptive(spark, sf):
    """As ``coverage_gap_parts``, of the intervals whose level moves with each day's misses."""
    p = _scored(spark, sf)
    moving = cf.adaptive(p.withColumn("config", F.lit("t20")), {"t20": 0.2}, 0.01)
    return _gap(moving.join(p.select("code", "i", "y"), ["code", "i"]), cf.fixed_alpha(p, 0.2))


def flagship(spark, sf):
    """Selection with false-discovery control: p-values of every decision and the selected rows at q = 0.2."""
    return bh_grid(spark, sf)
