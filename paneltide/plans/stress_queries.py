"""Settlement stress of fixed baskets, staleness of the source at each moment, withholding classes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from paneltide.functions import calendars
from paneltide.operators import execution, quality, settlement, windows as w
from paneltide.plans import adapters as ad
from paneltide.plans.adapters import MASTER_SQL, WIDE_SQL
from paneltide.plans.registry import query, rounded as r

#: First position of the stress, when most suppliers have a price, and the position of the synthetic sale.
FIRST, SALE = 40, 200


@query(f"""
SELECT basket, mode, scenario, period, CASE WHEN problem IS NOT NULL THEN 'not evaluable: ' || problem[3:] WHEN period <> 'full' THEN '{settlement.NO_ACCOUNTS}' ELSE 'ok' END AS status,
  CASE WHEN problem IS NULL AND period = 'full' THEN round(pow((cash + due) / 100, 252e0 / (span - 1)) - 1, 8) + 0e0 END AS cagr,
  CASE WHEN problem IS NULL THEN settle_i END AS settle_i, CASE WHEN problem IS NULL THEN round(taxes, 7) + 0e0 END AS taxes_paid,
  CASE WHEN problem IS NULL THEN round(cash, 7) + 0e0 END AS settled_cash, CASE WHEN problem IS NULL THEN round(due, 7) + 0e0 END AS receivables,
  CASE WHEN problem IS NULL THEN round(cash + due, 7) + 0e0 END AS ending_equity, CASE WHEN problem IS NULL AND period = 'full' THEN true END AS adds_up
FROM done CROSS JOIN (SELECT unnest(['full', 'select', 'external']) AS period)
""", WIDE_SQL, f"""
px AS (SELECT code, CAST(code[2:] AS BIGINT) AS k, i, filled AS price FROM wide WHERE i >= {FIRST}),
mk AS (SELECT min(i) AS a, max(i) AS z, max(i) - min(i) + 1 AS span FROM px),
mem AS (
  SELECT CAST(s_suppkey // 6 AS BIGINT) AS basket, printf('S%07d', s_suppkey) AS code, CASE WHEN s_suppkey % 97 = 3 THEN 2 ELSE 1 END AS copies FROM supplier
),
en AS (SELECT code, count(price) AS good, max(CASE WHEN i = a THEN price END) AS p0 FROM px, mk GROUP BY code),
pr AS (
  SELECT code, i, k % 3 AS buy_valor, (k + i) % 4 AS sell_valor, k % 37 <> 5 AS can_buy, (k + i) % 41 <> 0 AS can_sell, CASE WHEN k % 43 <> 7 THEN 'A' END AS cat,
    CASE WHEN k % 5 <> 0 THEN (k % 5) * 0.05e0 END AS rate, price FROM px
),
js AS (
  SELECT mem.*, mode, scenario, mk.*, sold_at, s.price AS p1, p0, en.good, count(*) OVER (PARTITION BY basket, mode, scenario) AS n, coalesce(f.rate, 0.175e0) AS rate,
    s.sell_valor + extra AS lag, sold_at + s.sell_valor + extra AS settled_at,
    CASE WHEN copies > 1 THEN '1 member listed twice' WHEN en.good IS NULL OR en.good < span THEN '2 prices incomplete' WHEN f.cat IS NULL THEN '4 no whole profile on the first day'
      WHEN s.cat IS NULL THEN '5 no whole profile on the day of sale' WHEN NOT f.can_buy THEN '6 closed for purchase on the first day'
      WHEN NOT s.can_sell THEN '7 closed for sale on the day of sale' WHEN a + f.buy_valor > sold_at THEN '8 lots not yet to be sold' END AS problem
  FROM mem CROSS JOIN mk CROSS JOIN LATERAL (SELECT unnest([z, {SALE}]) AS sold_at, unnest(['{settlement.FIXED}', '{settlement.REINVESTED}']) AS mode)
    CROSS JOIN (SELECT unnest([0, 1]) AS extra, unnest(['base', 'later_settlement']) AS scenario)
    LEFT JOIN en ON en.code = mem.code LEFT JOIN pr f ON f.code = mem.code AND f.i = a LEFT JOIN pr s ON s.code = mem.code AND s.i = sold_at
),
nets AS (
  SELECT *, 100e0 / n * p1 / p0 - rate * greatest(100e0 / n * (p1 / p0 - 1), 0) AS net, rate * greatest(100e0 / n * (p1 / p0 - 1), 0) AS tax,
    CASE WHEN mode = '{settlement.FIXED}' THEN lag = 0 ELSE settled_at <= z END AS settled FROM js
),
days AS (
  SELECT r.basket, r.mode, r.scenario, c.i, exp(sum(CASE WHEN q.i IS NULL THEN ln(1 + (0.0005e0 + 0.0001e0 * (c.i % 7)) * 0.825e0) ELSE 0 END) OVER (PARTITION BY r.basket, r.mode, r.scenario ORDER BY c.i)) AS g
  FROM (SELECT DISTINCT basket, mode, scenario FROM nets WHERE mode <> '{settlement.FIXED}') r CROSS JOIN (SELECT DISTINCT i FROM px WHERE i > {SALE}) c
    LEFT JOIN (SELECT DISTINCT basket, mode, scenario, settled_at AS i FROM nets WHERE settled AND lag > 0) q ON (q.basket, q.mode, q.scenario, q.i) = (r.basket, r.mode, r.scenario, c.i)
),
lived AS (
  SELECT nets.*, CASE WHEN NOT settled OR nets.mode = '{settlement.FIXED}' THEN 1e0 ELSE e.g / coalesce(b.g, 1e0) END AS growth
  FROM nets LEFT JOIN days e ON (e.basket, e.mode, e.scenario, e.i) = (nets.basket, nets.mode, nets.scenario, z)
    LEFT JOIN days b ON (b.basket, b.mode, b.scenario, b.i) = (nets.basket, nets.mode, nets.scenario, settled_at)
),
done AS (
  SELECT basket, mode, scenario, min(problem) AS problem, max(settled_at) AS settle_i, any_value(span) AS span, sum(tax) + sum(net * (growth - 1)) / 0.825e0 * 0.175e0 AS taxes,
    sum(CASE WHEN settled THEN net * growth ELSE 0 END) AS cash, sum(CASE WHEN settled THEN 0 ELSE net END) AS due FROM lived GROUP BY 1, 2, 3
)""")  # fmt: skip
def settlement_stress(spark, sf):
    """Baskets of six suppliers each: sold at the end, and sold on one position with the proceeds kept as cash."""
    p = ad.wide_panel(spark, sf).withColumn("price", w.fill_forward()).filter(F.col("i") >= FIRST).select("code", "i", "price")
    k = F.substring("code", 2, 20).cast("bigint")
    profiles = p.select(
        "code", "i", (k % 3).cast("double").alias("buy_valor"), ((k + F.col("i")) % 4).cast("double").alias("sell_valor"), (k % 37 != 5).alias("can_buy"),
        ((k + F.col("i")) % 41 != 0).alias("can_sell"), F.when(k % 43 != 7, "A").alias("tax_category"), F.when(k % 5 != 0, (k % 5) * 0.05).alias("tax_rate"),
    )
    listed = F.explode(F.array_repeat(F.format_string("S%07d", "s_suppkey"), F.when(F.col("s_suppkey") % 97 == 3, 2).otherwise(1)))
    baskets = ad.table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 6).alias("basket"), listed.alias("code"))
    cash = ad.with_cash(p.select("i").distinct()).select("i", F.col("cash").alias("rate"))
    out = settlement.settlement_stress(baskets, p, profiles, cash, liquidation=SALE)
    figures = [r(c, 7).alias(c) for c in ("taxes_paid", "settled_cash", "receivables", "ending_equity")]
    return out.select("basket", "mode", "scenario", "period", "status", r("cagr").alias("cagr"), "settle_i", *figures, (F.col("identity_gap") < 1e-6).alias("adds_up"))


@query("""
SELECT "at", expected, newest, behind, round(ratio, 8) + 0e0 AS fresh_ratio, reason <> 'ok' AS stale, reason FROM (
  SELECT *, CASE WHEN snap IS NULL THEN 'no_snapshot' WHEN newest IS NULL THEN 'no_price' WHEN coalesce(behind >= 3, true) THEN 'behind' WHEN ratio < 0.8e0 THEN 'few_fresh' ELSE 'ok' END AS reason
  FROM (SELECT *, (SELECT count(*) FROM bds WHERE d < expected) - before AS behind FROM asked ASOF LEFT JOIN per ON day >= newest))
""", """
taken AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) + 40 AS d FROM orders),
bds AS (SELECT d FROM (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND NOT (month(d) = 1 AND day(d) = 1)),
nav AS (SELECT DISTINCT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) + CAST(4 + l_suppkey % 3 AS INTEGER) AS d FROM lineitem),
dn AS (SELECT d, (SELECT count(*) FROM bds WHERE bds.d < nd.d) AS before FROM (SELECT DISTINCT d FROM nav) nd),
per AS (
  SELECT newest, any_value(before) AS before, avg(CASE WHEN last_before = before THEN 1e0 ELSE 0e0 END) AS ratio FROM (
    SELECT a.d AS newest, a.before, n.code, max(b.before) AS last_before FROM dn a JOIN nav n ON n.d <= a.d JOIN dn b ON b.d = n.d GROUP BY ALL) GROUP BY newest
),
asked AS (
  SELECT *, CAST("at" AS DATE) AS day, (SELECT max(d) FROM bds WHERE d < CAST("at" AS DATE) OR (d = CAST("at" AS DATE) AND hour("at") >= 10)) AS expected,
    (SELECT max(d) FROM taken WHERE d <= CAST("at" AS DATE)) AS snap
  FROM (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 3 * 6 AS INTEGER)) AS "at" FROM orders)
)""")  # fmt: skip
def source_stale(spark, sf):
    """Three moments on each day with an order, against the suppliers' weekly prices, dated Friday to Sunday."""
    o = ad.table(spark, sf, "orders").select((F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 3 * 6).cast("int"))).alias("at"))
    label = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), (4 + F.col("l_suppkey") % 3).cast("int"))
    nav = ad.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), label.alias("d"), F.lit(1.0).alias("price"))
    cal = calendars.business_days(spark, date(1992, 1, 1), date(1998, 12, 31), [date(y, 1, 1) for y in range(1992, 1999)])
    taken = ad.table(spark, sf, "orders").select(F.date_add(F.trunc("o_orderdate", "quarter"), 40).alias("snapshot_date"))
    out = quality.source_stale(o, nav, taken, cal, most_behind=3, least_fresh=0.8)
    return out.withColumn("fresh_ratio", r("fresh_ratio"))


@query("""
SELECT fund_code, snapshot_date, kind AS tax_category, CASE WHEN kind IS NULL THEN NULL WHEN snapshot_date >= DATE '1998-02-01' THEN CASE kind WHEN 'abroad' THEN 0.15e0 ELSE 0.125e0 END
  ELSE CASE kind WHEN 'equity' THEN 0e0 ELSE 0.1e0 END END AS withholding_rate
FROM (SELECT *, CASE WHEN category = 'Hisse' THEN 'equity' WHEN name LIKE '%IRAN%' OR name LIKE '%IRAQ%' THEN 'abroad' WHEN category = 'Borçlanma' AND name LIKE '%CHINA%' THEN 'bond' END AS kind FROM master)
""", MASTER_SQL)  # fmt: skip
def withholding_classes(spark, sf):
    rules = [("equity", ["HİSSE"], []), ("abroad", [], ["iran", "ıraq"]), ("bond", ["borçlanma"], ["China"])]
    schedule = [("1990-01-01", {"equity": 0.0, "default": 0.1}), ("1998-02-01", {"abroad": 0.15, "default": 0.125})]
    out = execution.withholding_classes(ad.master(spark, sf).drop("tax_category"), rules, schedule)
    return out.select("fund_code", "snapshot_date", "tax_category", "withholding_rate")
