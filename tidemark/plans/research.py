"""Fundamentals and order queries over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as K
from tidemark.operators import orders as O
from tidemark.plans.panel import BARS, PANEL, panel
from tidemark.plans.silver import FACT
from tidemark.sources import tables as T


def _facts(spark, sf_dir):
    return K.avail_index(T.facts(spark, sf_dir), T.sessions(spark, sf_dir), "available")


def _cents(c: str):
    return F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 100 + 0.5000001) / 100).alias(c)


def avail_index(spark, sf_dir):
    return _facts(spark, sf_dir).select("company_id", "quarter", "fact", "avail_pos")


def shown_quarter(spark, sf_dir):
    """The quarter that each session shows of each company."""
    return K.shown_quarter(K.quarter_complete(_facts(spark, sf_dir)), T.sessions(spark, sf_dir).select("pos"))


def fact_age(spark, sf_dir):
    s = shown_quarter(spark, sf_dir).join(F.broadcast(T.sessions(spark, sf_dir)), "pos")
    age = F.year("session") * 4 + F.quarter("session") - 1 - F.col("quarter")
    return s.groupBy("pos").agg(F.count("*").alias("companies"), F.max(age).cast("long").alias("oldest"), F.min(age).cast("long").alias("newest"))


def trailing_sum(spark, sf_dir):
    return K.trailing_sum(_facts(spark, sf_dir)).select("company_id", "quarter", "fact", _cents("ttm"), "ttm_pos")


def year_over_year(spark, sf_dir):
    y = K.year_over_year(T.facts(spark, sf_dir))
    return y.select("company_id", "quarter", "fact", _cents("value_ly"), _cents("growth"))


def fourth_from_annual(spark, sf_dir):
    f = _facts(spark, sf_dir)
    q = f.groupBy("company_id", "quarter").agg(F.sum("value").alias("value"), F.max("avail_pos").alias("avail_pos"))
    annual = q.groupBy("company_id", F.expr("quarter div 4").alias("year")).agg(F.sum("value").alias("value"), F.max("avail_pos").alias("avail_pos"))
    return K.fourth_from_annual(annual, q).select("company_id", "quarter", _cents("value"), "avail_pos")


def notice_blocks(spark, sf_dir):
    p = T.observed(spark, sf_dir).select("instrument_id", "pos", "close")
    a = p.where("close % 97 = 0 or close % 89 = 0").select("instrument_id", "pos", F.when(F.col("close") % 97 == 0, "notice").otherwise("cancel").alias("kind"))
    return K.notice_blocks(a, p.select("instrument_id", "pos"), 30)


def _targets(spark, sf_dir):
    p = T.observed(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("value"), "instrument_id"))
    return p.withColumn("rank", rank).where("rank <= 5").select("pos", "instrument_id", "close", F.lit(0.2).alias("weight"))


def _holdings(spark, sf_dir):
    return T.observed(spark, sf_dir).where("volume > 60").select("pos", "instrument_id", F.expr("volume * 3").alias("held"))


def target_orders(spark, sf_dir):
    return O.target_orders(_targets(spark, sf_dir), _holdings(spark, sf_dir), 1_000_000.0, 0.01, 0.1)


def fill_costs(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("instrument_id", "session", O.fill_cost(F.col("value"), F.col("sell_tax_rate")).alias("tax"), O.nearest_toward_zero(F.col("change") / 2).alias("half_change"))


def portfolio_value(spark, sf_dir):
    prices = T.observed(spark, sf_dir).where("close % 50 <> 0").select("pos", "instrument_id", "close")
    return O.portfolio_value(_holdings(spark, sf_dir), prices, "pos").select("pos", "value", "unpriced")


def order_fill_estimate(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("instrument_id").orderBy("session")
    nxt = p.select("pos", "instrument_id", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("open", "volume", "open_at_upper", "open_at_lower")])
    return O.order_fill_estimate(target_orders(spark, sf_dir).where(F.col("order") != 0).select("pos", "instrument_id", "order"), nxt, 0.1)


QUERIES = {f.__name__: f for f in (
    avail_index, shown_quarter, fact_age, trailing_sum, year_over_year, fourth_from_annual, notice_blocks, target_orders, fill_costs, portfolio_value, order_fill_estimate,
)}

A = f"""{BARS}, {FACT},
cs AS (SELECT session, pos, lag(session) OVER (ORDER BY pos) AS before FROM cal),
fa AS (SELECT f0.*, pos AS avail_pos FROM f0 JOIN cs ON f0.available <= cs.session AND (cs.before IS NULL OR f0.available > cs.before))"""
SHOWN = f"""{A}, qc AS (SELECT company_id, quarter, max(avail_pos) AS p FROM fa GROUP BY ALL),
sh AS (SELECT company_id, c.pos, max(quarter) AS quarter FROM qc JOIN cal c ON qc.p <= c.pos GROUP BY ALL)"""
ORDERS = BARS + """,
ob AS (SELECT * FROM bars JOIN cal USING (session)),
tg AS (SELECT * FROM (SELECT pos, instrument_id, close, row_number() OVER (PARTITION BY pos ORDER BY value DESC, instrument_id) AS r FROM ob) WHERE r <= 5),
hd AS (SELECT pos, instrument_id, volume * 3 AS held FROM ob WHERE volume > 60),
oj AS (
  SELECT coalesce(tg.pos, hd.pos) AS pos, coalesce(tg.instrument_id, hd.instrument_id) AS instrument_id,
    CAST(coalesce(floor(0.2::DOUBLE * 1000000.0::DOUBLE * (1 - 0.01::DOUBLE) / CASE WHEN close > 0 THEN close END), 0) AS BIGINT) AS want, CAST(coalesce(held, 0) AS BIGINT) AS held
  FROM tg FULL JOIN hd ON tg.pos = hd.pos AND tg.instrument_id = hd.instrument_id),
od AS (SELECT *, CASE WHEN want > 0 AND held > 0 AND abs(want - held) <= held * 0.1::DOUBLE THEN 0 ELSE want - held END AS "order" FROM oj)"""


def _c(x: str, name: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN floor(({x}) * 100 + 0.5000001) / 100 END AS {name}"


SQL = {
    "avail_index": f"WITH {A} SELECT company_id, quarter, fact, avail_pos FROM fa",
    "shown_quarter": f"WITH {SHOWN} SELECT * FROM sh",
    "fact_age": f"""WITH {SHOWN}, g AS (SELECT pos, year(session) * 4 + quarter(session) - 1 - sh.quarter AS age FROM sh JOIN cal USING (pos))
SELECT pos, count(*) AS companies, max(age) AS oldest, min(age) AS newest FROM g GROUP BY pos""",
    "trailing_sum": f"""WITH {A}, t AS (SELECT company_id, quarter, fact, CASE WHEN count(*) OVER w = 4 THEN sum(value) OVER w END AS ttm, CASE WHEN count(*) OVER w = 4 THEN max(avail_pos) OVER w END AS ttm_pos
  FROM fa WINDOW w AS (PARTITION BY company_id, fact ORDER BY quarter RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT company_id, quarter, fact, {_c("ttm", "ttm")}, ttm_pos FROM t""",
    "year_over_year": f"""WITH {FACT} SELECT a.company_id, a.quarter, a.fact, {_c("b.value", "value_ly")}, {_c("(a.value - b.value) / nullif(abs(b.value), 0)", "growth")}
FROM f0 a LEFT JOIN f0 b ON a.company_id = b.company_id AND a.fact = b.fact AND a.quarter = b.quarter + 4""",
    "fourth_from_annual": f"""WITH {A}, q AS (SELECT company_id, quarter, sum(value) AS value, max(avail_pos) AS p FROM fa GROUP BY ALL),
y AS (SELECT company_id, quarter // 4 AS year, sum(value) AS value, max(p) AS p FROM q GROUP BY ALL),
t AS (SELECT company_id, quarter // 4 AS year, sum(value) AS three, max(p) AS p FROM q WHERE quarter % 4 < 3 GROUP BY ALL HAVING count(*) = 3)
SELECT company_id, year * 4 + 3 AS quarter, {_c("y.value - three", "value")}, greatest(y.p, t.p) AS avail_pos FROM y JOIN t USING (company_id, year)""",
    "notice_blocks": f"""WITH {BARS}, p AS (SELECT instrument_id, pos, close % 97 = 0 AS n, close % 89 = 0 AND close % 97 <> 0 AS c FROM bars JOIN cal USING (session)),
l AS (SELECT *, max(CASE WHEN n THEN pos END) OVER w AS ln, max(CASE WHEN c THEN pos END) OVER w AS lc FROM p WINDOW w AS (PARTITION BY instrument_id ORDER BY pos))
SELECT instrument_id, pos, coalesce(ln IS NOT NULL AND pos - ln <= 30 AND (lc IS NULL OR lc < ln), false) AS blocked FROM l""",
    "target_orders": f'WITH {ORDERS} SELECT pos, instrument_id, want, held, CAST("order" AS BIGINT) AS "order" FROM od',
    "fill_costs": f"""WITH {PANEL} SELECT instrument_id, session, CAST(floor(CAST(value AS DECIMAL(18, 2)) * CAST(sell_tax_rate AS DECIMAL(10, 8))) AS BIGINT) AS tax,
  CAST(sign(change) * ceil(abs(change / 2) - 0.5) AS BIGINT) AS half_change FROM panel""",
    "portfolio_value": f"""WITH {ORDERS} SELECT hd.pos, CAST(sum(held * close) AS BIGINT) AS value, count(*) FILTER (close IS NULL) AS unpriced
FROM hd LEFT JOIN (SELECT pos, instrument_id, close FROM ob WHERE close % 50 <> 0) x ON x.pos = hd.pos AND x.instrument_id = hd.instrument_id GROUP BY hd.pos""",
    "order_fill_estimate": f"""WITH {PANEL}, {ORDERS.replace(BARS + ',', '', 1)},
n AS (SELECT pos, instrument_id, lead(open) OVER w AS o, lead(volume) OVER w AS v, lead(open_at_upper) OVER w AS u, lead(open_at_lower) OVER w AS d FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY session)),
r AS (SELECT od.pos, od.instrument_id, od."order", v, CASE WHEN o IS NULL THEN 'missing_price' WHEN v = 0 THEN 'halted' WHEN od."order" > 0 AND u THEN 'limit_locked'
  WHEN od."order" < 0 AND d THEN 'limit_locked' WHEN floor(v * 0.1::DOUBLE) < 1 THEN 'capacity' END AS reject FROM od LEFT JOIN n USING (pos, instrument_id) WHERE od."order" <> 0)
SELECT pos, instrument_id, CAST("order" AS BIGINT) AS "order", reject, CAST(CASE WHEN reject IS NULL THEN least(abs("order"), floor(v * 0.1::DOUBLE)) ELSE 0 END AS BIGINT) AS filled FROM r""",
}

DATES = {"fill_costs": ("session",)}
