"""Store maintenance, text and status vocabulary, universe, as-of profiles, calendars, operational statistics, event windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from paneltide.functions import calendars, text
from paneltide.operators import execution, joins, live_basket, ops, quality as ql, relational as rel, universe, windows as w
from paneltide.plans import adapters as ad
from paneltide.plans.adapters import FOLD_SQL, MASTER_SQL, PANEL_SQL, RUNS_SQL, STATUS_FOLD_SQL
from paneltide.plans.registry import query, rounded as r
from paneltide.streaming import events as ev


@query("SELECT fund_code, snapshot_date, score FROM master WHERE snapshot_date = (SELECT max(snapshot_date) FROM master)", MASTER_SQL)
def latest_snapshot(spark, sf):
    return rel.latest_snapshot(ad.master(spark, sf)).select("fund_code", "snapshot_date", "score")


_UPSERT_SQL = """
stored AS (SELECT code, d, i, price FROM panel WHERE i < 200),
arrived AS (SELECT code, d, i, price * (1 + 0.01e0 * n) AS price, n FROM panel CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE i BETWEEN 190 AND 210)"""


def _arrived(p):
    return p.filter(F.col("i").between(190, 210)).crossJoin(p.sparkSession.range(1, 3).withColumnRenamed("id", "n")).withColumn("price", F.col("price") * (1 + F.lit(0.01) * F.col("n")))


@query("""
SELECT code, i, round(price, 6) + 0e0 AS price FROM stored s WHERE NOT EXISTS (SELECT 1 FROM arrived a WHERE a.code = s.code AND a.d = s.d)
UNION ALL SELECT code, i, round(price, 6) + 0e0 FROM arrived WHERE n = 2
""", PANEL_SQL, _UPSERT_SQL)  # fmt: skip
def upsert_nav(spark, sf):
    p = ad.panel(spark, sf)
    return rel.upsert(p.filter("i < 200"), _arrived(p), ["code", "d"], "n").select("code", "i", r("price", 6).alias("price"))


_UPSERT_WHOLE_SQL = """
corrected AS (
  SELECT code, d, i, price * (1 + 0.01e0 * n) AS price, n FROM panel CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE i % 10 = 0
  UNION ALL SELECT code, CAST(d + INTERVAL 70 DAY AS DATE), i + 10, price, 1 FROM panel WHERE i > (SELECT max(i) - 10 FROM panel)
)"""


@query("""
SELECT code, i, round(price, 6) + 0e0 AS price FROM panel s WHERE NOT EXISTS (SELECT 1 FROM corrected a WHERE a.code = s.code AND a.d = s.d)
UNION ALL SELECT code, i, round(price, 6) + 0e0 FROM corrected WHERE n = 2 OR i > (SELECT max(i) FROM panel)
""", PANEL_SQL, _UPSERT_WHOLE_SQL)  # fmt: skip
def upsert_nav_whole(spark, sf):
    """All weeks stored; corrections in all parts of the panel, and ten new weeks after it."""
    p = ad.panel(spark, sf)
    twice = p.filter("i % 10 = 0").crossJoin(spark.range(1, 3).withColumnRenamed("id", "n")).withColumn("price", F.col("price") * (1 + F.lit(0.01) * F.col("n")))
    end = p.agg(F.max("i").alias("last"))
    new = p.crossJoin(F.broadcast(end)).filter(F.col("i") > F.col("last") - 10).drop("last")
    new = new.withColumns({"d": F.date_add("d", 70), "i": F.col("i") + 10, "n": F.lit(1).cast("bigint")})
    return rel.upsert(p, twice.unionByName(new), ["code", "d"], "n").select("code", "i", r("price", 6).alias("price"))


@query("SELECT fund_code, snapshot_date, score FROM master WHERE snapshot_date <> DATE '1998-02-02' UNION ALL SELECT fund_code, snapshot_date, score + 1 FROM master WHERE snapshot_date = DATE '1998-02-02' AND score > 0", MASTER_SQL)
def replace_partition(spark, sf):
    m = ad.master(spark, sf).select("fund_code", "snapshot_date", "score")
    new = m.filter("snapshot_date = DATE '1998-02-02' AND score > 0").withColumn("score", F.col("score") + 1)
    return rel.replace_partitions(m, new, "snapshot_date")


@query("SELECT fund_code, score FROM master WHERE snapshot_date = DATE '1998-02-02' AND score > 0 UNION ALL SELECT fund_code, score FROM master WHERE snapshot_date = DATE '1998-01-05' AND NOT score > 0", MASTER_SQL)
def carry_forward(spark, sf):
    m = ad.master(spark, sf).select("fund_code", "snapshot_date", "score")
    return joins.carried(m.filter("snapshot_date = DATE '1998-02-02' AND score > 0"), m.filter("snapshot_date = DATE '1998-01-05'"), ["fund_code"]).select("fund_code", "score")


@query("SELECT fund_code, score FROM master WHERE snapshot_date = DATE '1998-01-05' AND score > 5000 UNION ALL SELECT fund_code, score * 2 FROM master WHERE snapshot_date = DATE '1998-02-02' AND NOT score > 5000", MASTER_SQL)
def insert_ignore(spark, sf):
    m = ad.master(spark, sf).select("fund_code", "snapshot_date", "score")
    stored = m.filter("snapshot_date = DATE '1998-01-05' AND score > 5000").select("fund_code", "score")
    new = m.filter("snapshot_date = DATE '1998-02-02'").select("fund_code", (F.col("score") * 2).alias("score"))
    return rel.insert_ignore(stored, new, ["fund_code"])


@query("SELECT fund_code, snapshot_date, CASE WHEN last_success_at IS NULL AND coalesce(info_ok, false) THEN CAST(snapshot_date AS TIMESTAMP) ELSE last_success_at END AS last_success_at FROM master", MASTER_SQL)
def backfill_flag(spark, sf):
    m = ad.master(spark, sf)
    return rel.backfilled(m, "last_success_at", F.col("snapshot_date").cast("timestamp_ntz"), F.coalesce("info_ok", F.lit(False))).select("fund_code", "snapshot_date", "last_success_at")


@query("SELECT CAST(1 AS BIGINT) AS changed", PANEL_SQL)
def prefix_equal(spark, sf):
    p = ad.panel(spark, sf).select("code", "i", "price")
    other = p.withColumn("price", F.when((F.col("i") == 50) & (F.col("code") == "SMALL"), F.coalesce("price", F.lit(1.0)) + 1).otherwise(F.col("price")))
    return rel.differences(p, other).filter("side = 'right'").agg(F.count("*").alias("changed"))


@query("SELECT code, i FROM panel WHERE price IS NOT NULL AND i % 40 = 3 AND i < 100", PANEL_SQL)
def prefix_y_maturation(spark, sf):
    p = ad.panel(spark, sf).select("code", "i", "price").filter("i < 100")
    new = p.withColumn("price", F.when(F.col("i") % 40 == 3, F.lit(None)).otherwise(F.coalesce("price", F.lit(1.0))))
    return rel.matured_only(p, new, ["code", "i"], "price").select("code", "i")


@query("SELECT code, i FROM panel WHERE i % 7 = 2", PANEL_SQL)
def whole_differences(spark, sf):
    p = ad.panel(spark, sf).select("code", "i", "price")
    other = p.withColumn("price", F.when(F.col("i") % 7 == 2, F.coalesce("price", F.lit(1.0)) + 1).otherwise(F.col("price")))
    return rel.differences(p, other).filter("side = 'right'").select("code", "i")


@query("SELECT code, i FROM panel WHERE price IS NOT NULL AND i % 40 = 3", PANEL_SQL)
def whole_y_maturation(spark, sf):
    p = ad.panel(spark, sf).select("code", "i", "price")
    new = p.withColumn("price", F.when(F.col("i") % 40 == 3, F.lit(None)).otherwise(F.coalesce("price", F.lit(1.0))))
    return rel.matured_only(p, new, ["code", "i"], "price").select("code", "i")


@query("SELECT code, count(*) AS violations FROM panel WHERE i >= 46 AND (i % 50 + i // 2) > i - 23 GROUP BY code", PANEL_SQL)
def train_max_t_check(spark, sf):
    p = ad.panel(spark, sf).filter("i >= 46").withColumn("train_max", F.col("i") % 50 + F.floor(F.col("i") / 2))
    return ops.late_training(p, "train_max", "i", 23).groupBy("code").agg(F.count("*").alias("violations"))


@query(f"SELECT DISTINCT founder, {FOLD_SQL.format('founder')} AS folded, CASE WHEN name ILIKE '%portföy%' THEN regexp_extract(name, '(?i)^(.*?portföy)', 1) END AS parsed FROM master", MASTER_SQL)
def tr_fold_text(spark, sf):
    m = ad.master(spark, sf)
    return m.select("founder", text.fold(F.col("founder")).alias("folded"), text.founder_of(F.col("name")).alias("parsed")).distinct()


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) + 0.5e0 AS n FROM supplier")
def num_parse(spark, sf):
    s = ad.table(spark, sf, "supplier")
    return s.select("s_suppkey", text.first_number(F.concat(F.lit("ücret: "), F.col("s_suppkey").cast("string"), F.lit(",5 % / yıl"))).alias("n"))


_S = STATUS_FOLD_SQL
_BC = "(s LIKE '%alımına kapalı%' OR s LIKE '%alımına ve bozumuna kapalı%' OR s LIKE '%bozumuna ve alımına kapalı%')"
_SC = "(s LIKE '%bozumuna kapalı%' OR s LIKE '%alımına ve bozumuna kapalı%' OR s LIKE '%bozumuna ve alımına kapalı%')"
_NT, _TR = "s LIKE '%işlem görmüyor%'", "(s LIKE '%işlem görüyor%' OR s LIKE '%işlem yapılabilir%')"
_MASKS = f"""
st AS (SELECT *, {_S} AS s FROM master),
mk AS (
  SELECT *, NOT {_NT} AND s NOT LIKE '%alımına kapalı%' AS legacy_buy, NOT {_NT} AND s NOT LIKE '%bozumuna kapalı%' AS legacy_sell,
    ({_TR} OR s LIKE '%alımına açık%' OR {_SC}) AND NOT {_BC} AND NOT {_NT} AS strict_buy,
    ({_TR} OR s LIKE '%bozumuna açık%' OR {_BC}) AND NOT {_SC} AND NOT {_NT} AS strict_sell,
    {_TR} OR {_NT} OR {_BC} OR {_SC} OR s LIKE '%alımına açık%' OR s LIKE '%bozumuna açık%' AS known,
    s LIKE '%alımına kapalı%' AND s LIKE '%bozumuna kapalı%' AS suspended FROM st
)"""
_EXEC = "legacy_buy AND strict_buy AND known AS exec_buy, legacy_sell AND strict_sell AND known AS exec_sell"


@query(f"SELECT fund_code, snapshot_date, legacy_buy, legacy_sell, strict_buy, strict_sell, known, {_EXEC}, suspended FROM mk", MASTER_SQL, _MASKS)
def status_masks(spark, sf):
    cols = "legacy_buy legacy_sell strict_buy strict_sell known exec_buy exec_sell suspended".split()
    return ql.with_masks(ad.master(spark, sf)).select("fund_code", "snapshot_date", *cols)


@query("SELECT fund_code, snapshot_date FROM (SELECT *, legacy_buy AND strict_buy AND known AS b, legacy_sell AND strict_sell AND known AS e FROM mk) WHERE can_buy IS DISTINCT FROM b OR can_sell IS DISTINCT FROM e", MASTER_SQL, _MASKS)
def mask_mismatches(spark, sf):
    return ql.mask_mismatches(ad.master(spark, sf)).select("fund_code", "snapshot_date")


_NORM = "lower(translate(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 'İIŞĞÜÖÇ', 'iışğüöç'))"


@query(f"""
SELECT fund_code, coalesce(fund_class = 'YAT' AND NOT {_NORM.format('umbrella_type')} LIKE '%serbest%' AND NOT {_NORM.format('category')} LIKE '%serbest%'
  AND NOT ({_NORM.format('founder')} LIKE '%istanbul portföy%' OR {_NORM.format('manager')} LIKE '%istanbul portföy%' OR {_NORM.format('name')} LIKE '%istanbul portföy%')
  AND DATE '1998-03-02' - inception_date >= 365 AND coalesce(info_ok, false) AND NOT suspended AND legacy_buy AND strict_buy AND known, false) AS in_universe
FROM mk WHERE snapshot_date = DATE '1998-03-02'
""", MASTER_SQL, _MASKS)  # fmt: skip
def universe_phase1(spark, sf):
    policy = universe.Policy(blacklist=("İstanbul Portföy",))
    buy, _, _ = ql.execution_masks()
    m = rel.latest_snapshot(ad.master(spark, sf))
    return m.select("fund_code", universe.universe_mask(policy, F.lit("1998-03-02").cast("date"), ql.suspended(), buy).alias("in_universe"))


@query(f"SELECT fund_code, {_NORM.format('umbrella_type')} LIKE '%asia%' OR {_NORM.format('category')} LIKE '%asia%' AS excluded FROM master WHERE fund_class = 'EMK' AND snapshot_date = DATE '1998-01-05'", MASTER_SQL)
def scope_bes(spark, sf):
    m = ad.master(spark, sf).filter("fund_class = 'EMK' AND snapshot_date = DATE '1998-01-05'")
    mask = universe.excluded_scope(universe.Policy(switches={"state": False}), {"area": ("ASİA",), "state": ("AMERİCA",)})
    return m.select("fund_code", mask.alias("excluded"))


_DEC = "decs AS (SELECT DISTINCT fund_code, DATE '1998-01-05' + CAST(o * 14 AS INTEGER) AS dday FROM master CROSS JOIN (SELECT unnest(range(5)) AS o))"


def _decisions(m):
    return m.select("fund_code").distinct().crossJoin(m.sparkSession.range(5)).select("fund_code", F.date_add(F.lit("1998-01-05").cast("date"), (F.col("id") * 14).cast("int")).alias("dday"))


@query("SELECT d.fund_code, d.dday, m.snapshot_date, m.score FROM decs d ASOF LEFT JOIN master m ON d.fund_code = m.fund_code AND d.dday >= m.snapshot_date", MASTER_SQL, _DEC)
def asof_profile(spark, sf):
    m = ad.master(spark, sf)
    return joins.asof_last(_decisions(m), m, "fund_code", "dday", "snapshot_date", ["score"])


_ASOF = """
pit AS (
  SELECT d.fund_code, d.dday, m.* EXCLUDE (fund_code) FROM decs d LEFT JOIN LATERAL (
    SELECT * FROM mk WHERE mk.fund_code = d.fund_code AND mk.snapshot_date <= d.dday
      AND (source_published_at IS NULL OR source_published_at <= CAST(d.dday AS TIMESTAMP) + INTERVAL '9 hours 15 minutes') ORDER BY snapshot_date DESC LIMIT 1) m ON true
)"""


@query("SELECT fund_code, dday, snapshot_date FROM pit", MASTER_SQL, _MASKS, _DEC, _ASOF)
def asof_profile_cutoff(spark, sf):
    m = ad.master(spark, sf)
    return execution.profiles_asof(_decisions(m), m).select("fund_code", "dday", "snapshot_date")


_REASON = """
CASE WHEN snapshot_date IS NULL THEN 'no_pit_snapshot' WHEN last_success_at IS NULL THEN 'missing_last_success_at'
  WHEN last_success_at > CAST(dday AS TIMESTAMP) + INTERVAL '9 hours 15 minutes' THEN 'future_last_success_at'
  WHEN CAST(dday AS TIMESTAMP) + INTERVAL '9 hours 15 minutes' - last_success_at > INTERVAL 7 DAY THEN 'stale_last_success_at'
  WHEN NOT coalesce(known, false) THEN 'unknown_status' WHEN buy_valor IS NULL OR sell_valor IS NULL THEN 'missing_execution_field'
  WHEN tax_category IS NULL OR trim(tax_category) = '' THEN 'missing_tax_category'
  WHEN buy_valor < 0 OR buy_valor <> floor(buy_valor) THEN 'invalid_buy_valor' WHEN sell_valor < 0 OR sell_valor <> floor(sell_valor) THEN 'invalid_sell_valor' ELSE 'ok' END"""


@query(f"""
SELECT fund_code, dday, coalesce(legacy_buy AND strict_buy AND known, false) AND reason = 'ok' AS can_buy, coalesce(legacy_sell AND strict_sell AND known, false) AND reason = 'ok' AS can_sell,
  CASE WHEN reason = 'ok' AND NOT (legacy_buy AND strict_buy AND known) THEN 'status_buy_closed' ELSE reason END AS buy_reason,
  CASE WHEN reason = 'ok' AND NOT (legacy_sell AND strict_sell AND known) THEN 'status_sell_closed' ELSE reason END AS sell_reason
FROM (SELECT *, {_REASON} AS reason FROM pit)
""", MASTER_SQL, _MASKS, _DEC, _ASOF)  # fmt: skip
def exec_reasons(spark, sf):
    m = ad.master(spark, sf)
    return execution.reasons(execution.profiles_asof(_decisions(m), m)).select("fund_code", "dday", "can_buy", "can_sell", "buy_reason", "sell_reason")


_HOL = (date(2024, 1, 1), date(2024, 1, 15))
_BD = "bd AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS bd FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15'))"


def _business(spark):
    return calendars.business_days(spark, date(2024, 1, 1), date(2024, 2, 15), list(_HOL))


@query("SELECT day, (SELECT count(*) FROM bd WHERE bd.d < day) AS before, (SELECT min(d) FROM bd WHERE bd.d > day) AS next_day FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)", _BD)
def busday_count(spark, sf):
    days = ad.table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    cal = _business(spark)
    return calendars.next_business_day(calendars.with_index(days, cal, "day", "before"), cal, "day")


@query("SELECT event_id, (SELECT max(d) FROM bd WHERE bd.d < CAST(ts AS DATE) OR (bd.d = CAST(ts AS DATE) AND hour(ts) >= 10)) AS expected FROM events", _BD)
def expected_label(spark, sf):
    e = ad.table(spark, sf, "events").select("event_id", "ts")
    return calendars.expected_label(e, _business(spark), "ts").select("event_id", "expected")


@query("""
SELECT n_codes, fresh_ratio, n_stale, n_buy_closed, n_sell_closed, n_unknown, n_suspended, n_non_positive, n_jumps FROM
 (SELECT count(*) AS n_codes, round(avg(CASE WHEN l = n THEN 1e0 ELSE 0e0 END), 8) + 0e0 AS fresh_ratio, count(*) FILTER (WHERE coalesce(n - l > 3, true)) AS n_stale
  FROM (SELECT code, max(CASE WHEN price IS NOT NULL THEN i END) AS l FROM panel GROUP BY code) CROSS JOIN (SELECT max(i) AS n FROM panel)) CROSS JOIN
 (SELECT count(*) FILTER (WHERE NOT (legacy_buy AND strict_buy AND known)) AS n_buy_closed, count(*) FILTER (WHERE NOT (legacy_sell AND strict_sell AND known)) AS n_sell_closed,
  count(*) FILTER (WHERE NOT known) AS n_unknown, count(*) FILTER (WHERE suspended) AS n_suspended FROM mk) CROSS JOIN
 (SELECT count(*) FILTER (WHERE price <= 0) AS n_non_positive, count(*) FILTER (WHERE coalesce(abs(ln(price) - lp) > 0.25, false)) AS n_jumps
  FROM (SELECT *, lag(ln(price)) OVER (PARTITION BY code ORDER BY i) AS lp FROM panel))
""", PANEL_SQL, MASTER_SQL, _MASKS)  # fmt: skip
def quality_summary(spark, sf):
    out = ql.quality_summary(ad.panel(spark, sf), ad.master(spark, sf))
    return out.select("n_codes", r("fresh_ratio").alias("fresh_ratio"), *[c for c in out.columns if c not in ("n_codes", "fresh_ratio")])


@query("""
SELECT day, kind, status, n FROM (SELECT CAST(started_at AS DATE) AS day, kind, status, row_number() OVER (PARTITION BY kind, CAST(started_at AS DATE) ORDER BY started_at DESC, run_id DESC) AS k,
  count(*) OVER (PARTITION BY kind, CAST(started_at AS DATE)) AS n FROM runs) WHERE k = 1
""", RUNS_SQL)  # fmt: skip
def last_run_per_day(spark, sf):
    return ops.last_runs(ad.runs(spark, sf)).select("day", "kind", "status", "n")


@query("""
SELECT kind, (SELECT count(*) FROM bd) AS expected, count(DISTINCT day) AS observed, (SELECT count(*) FROM bd) - count(DISTINCT day) AS missing,
  round(count(DISTINCT CASE WHEN status <> 'failed' THEN day END) / (SELECT count(*) FROM bd)::DOUBLE, 8) + 0e0 AS ok_ratio
FROM (SELECT day, kind, status FROM (SELECT CAST(started_at AS DATE) AS day, kind, status, row_number() OVER (PARTITION BY kind, CAST(started_at AS DATE) ORDER BY started_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1)
WHERE day IN (SELECT d FROM bd) GROUP BY kind
""", RUNS_SQL, _BD)  # fmt: skip
def kpi_daily_coverage(spark, sf):
    out = ops.daily_coverage(ops.last_runs(ad.runs(spark, sf)), _business(spark))
    return out.select("kind", "expected", "observed", "missing", r("ok_ratio").alias("ok_ratio"))


@query("SELECT kind, count(*) AS n, CAST(sum(CAST(json_extract_string(summary, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM runs GROUP BY kind", RUNS_SQL)
def json_orders(spark, sf):
    return ops.summaries(ad.runs(spark, sf), "k bigint").groupBy("kind").agg(F.count("*").alias("n"), F.sum("s.k").alias("k_sum"))


@query("""
SELECT median(lag) AS median_lag, count(*) AS n FROM (
  SELECT date_diff('day', CAST(o_orderdate AS DATE), min(CAST(l_shipdate AS DATE))) AS lag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)
""")  # fmt: skip
def proposal_fill_lag(spark, sf):
    o = ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    f = ad.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("fill_day"))
    return ops.fill_lag(o, f)


@query("SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return ev.tumbling(ad.table(spark, sf, "events"), "1 hour").select("event_type", "window_start", "n", r("total", 4).alias("total"))


@query("""
SELECT event_type, window_start, count(*) AS n FROM (
  SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start FROM events CROSS JOIN (SELECT unnest(range(2)) AS k)) GROUP BY 1, 2
""")  # fmt: skip
def events_sliding(spark, sf):
    return ev.sliding(ad.table(spark, sf, "events"), "1 hour", "30 minutes").select("event_type", "window_start", "n")


@query("""
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s
""")  # fmt: skip
def events_sessions(spark, sf):
    return ev.sessions(ad.table(spark, sf, "events"), "30 minutes").select("user_id", "session_start", "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def events_dedup(spark, sf):
    return rel.first_per_key(ad.table(spark, sf, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT code, last_d FROM (SELECT code, max(CASE WHEN price IS NOT NULL THEN d END) AS last_d FROM panel GROUP BY code)", PANEL_SQL)
def last_valid_dates(spark, sf):
    return ql.last_valid_dates(ad.panel(spark, sf))


@query("SELECT code, d, kind FROM (SELECT code, d, CASE WHEN price <= 0 THEN 'non_positive' WHEN coalesce(abs(ln(price) - lag(ln(price)) OVER (PARTITION BY code ORDER BY i)) > 0.2, false) THEN 'jump' END AS kind FROM panel) WHERE kind IS NOT NULL", PANEL_SQL)
def bad_cells(spark, sf):
    return ql.bad_cells(ad.panel(spark, sf), 0.2)


@query("SELECT fund_code, coalesce(a.score, 0e0) AS old_w, coalesce(b.score, 0e0) AS new_w FROM (SELECT fund_code, score FROM master WHERE snapshot_date = DATE '1998-01-05' AND score > 0) a FULL JOIN (SELECT fund_code, score FROM master WHERE snapshot_date = DATE '1998-02-02' AND score < 5000) b USING (fund_code)", MASTER_SQL)
def aligned_vectors(spark, sf):
    m = ad.master(spark, sf).select("fund_code", "snapshot_date", "score")
    return joins.aligned(m.filter("snapshot_date = DATE '1998-01-05' AND score > 0"), m.filter("snapshot_date = DATE '1998-02-02' AND score < 5000"), "fund_code", "score", ("old_w", "new_w"))


_COVER_SQL = """
cover AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS fund_code, count(DISTINCT l_shipdate) AS n_nav FROM lineitem GROUP BY 1),
cov AS (SELECT *, n_nav / (SELECT max(n_nav) FROM cover)::DOUBLE AS share FROM cover),
cand AS (SELECT * FROM master JOIN cov USING (fund_code) WHERE snapshot_date = DATE '1998-03-02' AND umbrella_type LIKE '%Şemsiye  Fonu%' AND founder <> 'BRAZIL' AND share >= 0.5e0),
best AS (SELECT tax_category AS m FROM cand WHERE tax_category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
basket AS (SELECT * FROM cand WHERE coalesce(tax_category, (SELECT m FROM best)) = (SELECT m FROM best))"""


def _proxy(spark, sf, **strict):
    li = ad.table(spark, sf, "lineitem")
    cover = li.groupBy(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("fund_code")).agg(F.countDistinct("l_shipdate").alias("n_nav"))
    cover = cover.crossJoin(F.broadcast(cover.agg(F.max("n_nav").alias("_m")))).select("fund_code", "n_nav", (F.col("n_nav") / F.col("_m")).alias("share"))
    out = universe.proxy_basket(rel.latest_snapshot(ad.master(spark, sf)), cover, "Şemsiye Fonu", ("BRAZIL",), 0.5, **strict)
    return out.select("fund_code", "n_nav", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT fund_code, n_nav, row_number() OVER (ORDER BY n_nav DESC, fund_code) AS rank FROM basket ORDER BY rank LIMIT 5", MASTER_SQL, _COVER_SQL)
def proxy_basket(spark, sf):
    return _proxy(spark, sf)


@query(f"""
SELECT fund_code, n_nav, row_number() OVER (ORDER BY n_nav DESC, fund_code) AS rank FROM basket
WHERE tax_category IS NOT NULL AND {STATUS_FOLD_SQL} LIKE '%işlem görüyor%' AND buy_valor = floor(buy_valor) AND sell_valor = floor(sell_valor)
  AND last_success_at BETWEEN TIMESTAMP '1998-02-23 09:15:00' AND TIMESTAMP '1998-03-02 09:15:00'
ORDER BY rank LIMIT 5
""", MASTER_SQL, _COVER_SQL)  # fmt: skip
def proxy_basket_strict(spark, sf):
    return _proxy(spark, sf, asof=F.lit("1998-03-02 09:15:00").cast("timestamp_ntz"), first_day="1998-02-01")


@query(f"""
SELECT "at", fund_code, name, founder, rank, n_nav, CASE WHEN place <= 2 THEN round(least(1e0 / k, 0.2e0 / least(m, 2)), 8) ELSE 0e0 END + 0e0 AS weight, buy_valor, sell_valor, last_nav_date FROM (
SELECT *, count(*) OVER (PARTITION BY "at") AS k, count(*) OVER (PARTITION BY "at", founder) AS m, row_number() OVER (PARTITION BY "at", founder ORDER BY rank) AS place FROM (
SELECT *, row_number() OVER (PARTITION BY "at" ORDER BY n_nav DESC, fund_code) AS rank FROM cand JOIN best USING ("at")
WHERE tax_category = best.usual AND {STATUS_FOLD_SQL} LIKE '%işlem görüyor%' AND buy_valor = floor(buy_valor) AND sell_valor = floor(sell_valor)
  AND last_success_at BETWEEN CAST("at" AS TIMESTAMP) + INTERVAL '9 hours 15 minutes' - INTERVAL 45 DAY AND CAST("at" AS TIMESTAMP) + INTERVAL '9 hours 15 minutes') WHERE rank <= 8)
""", MASTER_SQL, """
nav AS (SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS fund_code, CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem),
days AS (SELECT d AS "at", n_days FROM (SELECT d, row_number() OVER (ORDER BY d) AS n_days FROM (SELECT DISTINCT d FROM nav)) WHERE d >= DATE '1997-12-01'),
seen AS (SELECT "at", fund_code, count(*) AS n_nav, max(d) AS last_nav_date FROM days JOIN nav ON d <= "at" GROUP BY ALL),
prof AS (SELECT * EXCLUDE (k) FROM (SELECT days.*, m.*, row_number() OVER (PARTITION BY "at", fund_code ORDER BY snapshot_date DESC) AS k FROM days JOIN master m
  ON snapshot_date <= "at" AND (source_published_at IS NULL OR source_published_at <= CAST("at" AS TIMESTAMP) + INTERVAL '9 hours 15 minutes')) WHERE k = 1),
cand AS (SELECT * FROM prof JOIN seen USING ("at", fund_code) WHERE umbrella_type LIKE '%Şemsiye  Fonu%' AND founder <> 'BRAZIL' AND n_nav / n_days::DOUBLE >= 0.5e0),
best AS (SELECT "at", arg_max(tax_category, n) AS usual FROM (SELECT "at", tax_category, count(*) AS n FROM cand WHERE tax_category IS NOT NULL GROUP BY ALL) GROUP BY 1)
""")  # fmt: skip
def live_baskets(spark, sf):
    """The basket of each week from December 1997 on, over the suppliers as funds and the weeks in which they shipped."""
    week = F.date_trunc("week", "l_shipdate").cast("date").alias("d")
    nav = ad.table(spark, sf, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("fund_code"), week).distinct().withColumn("price", F.lit(1.0))
    days = nav.select(F.col("d").alias("at")).distinct().filter("at >= DATE '1997-12-01'")
    out = live_basket.live_baskets(days, ad.master(spark, sf), nav, "Şemsiye Fonu", ("BRAZIL",), 0.5, 8, "1998-01-05", 45, 0.2, 2)
    return out.withColumn("weight", r("weight")).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT fund_code, name, category, umbrella_type FROM master WHERE snapshot_date = DATE '1998-03-02' AND fund_class = 'EMK' AND (category = 'Hisse' OR name LIKE '%IRAN%')", MASTER_SQL)
def state_excluded(spark, sf):
    return universe.state_excluded(rel.latest_snapshot(ad.master(spark, sf)), ("hisse", "IRAN"))
