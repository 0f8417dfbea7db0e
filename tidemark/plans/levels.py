"""Level, decision and dividend queries over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import fundamentals as K
from tidemark.plans.features import CELLS, cells
from tidemark.plans.panel import BARS
from tidemark.sources import tables as T


def _levels(spark, sf_dir):
    return T.observed(spark, sf_dir).select("instrument_id", "pos", F.col("close").cast("double").alias("level"))


def _six(c: str):
    return F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 1e6 + 0.5000001) / 1e6).alias(c)


def realised_vol(spark, sf_dir):
    return E.realised_vol(_levels(spark, sf_dir), "instrument_id", 20).select("instrument_id", "pos", _six("vol"))


def log_returns(spark, sf_dir):
    return E.log_returns(_levels(spark, sf_dir), "instrument_id").select("instrument_id", "pos", _six("log_return"), _six("simple_return"))


def mean_sleeve_returns(spark, sf_dir):
    r = E.log_returns(_levels(spark, sf_dir), "instrument_id").where("log_return is not null").withColumn("log_return", F.col("log_return") / 10)
    return E.mean_sleeve_returns(r).select("pos", "sleeves", _six("ret"))


def revision_check(spark, sf_dir):
    new = _levels(spark, sf_dir)
    old = new.where("pos % 9 <> 0").withColumn("level", F.when(F.col("pos") % 13 == 0, F.col("level") + 1).otherwise(F.col("level")))
    return E.revision_check(old, new, ["instrument_id", "pos"], "level").groupBy("state").agg(F.count("*").alias("n"))


def effective_positions(spark, sf_dir):
    cal = T.sessions(spark, sf_dir)
    seal = F.col("session").cast("timestamp") + F.make_interval(hours=(F.pmod("pos", F.lit(40)) + 10).cast("int"))
    return E.effective_position(cal.select("pos", seal.alias("sealed_at")), cal, 9).select("pos", "effective", "is_late")


def flows_krw(spark, sf_dir):
    b = T.observed(spark, sf_dir).select("instrument_id", "pos", "close", F.col("volume").alias("net"))
    return K.flows_krw(b.where("pos % 4 <> 1").select("instrument_id", "pos", "net"), b.select("instrument_id", "pos", "close"), 2)


def _dividends(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("instrument_id"), F.year("l_shipdate").alias("y")).agg(F.to_date(F.min("l_shipdate")).alias("ex_day"), F.max("l_linenumber").cast("long").alias("dps"))


def dividend_ttm(spark, sf_dir):
    return K.dividend_ttm(_dividends(spark, sf_dir).drop("y"), T.bars(spark, sf_dir).select("instrument_id", "session"), 365)


def dividend_plausibility(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("dps"), F.when(F.col("p_partkey") % 17 > 0, F.col("p_retailprice")).alias("price"), F.lit(0.02).alias("printed_yield"))
    return K.dividend_plausibility(p, 2.0, 0.035).select("p_partkey", "label")


def coverage_stats(spark, sf_dir):
    return K.coverage_stats(cells(spark, sf_dir), ["close", "rcc", "rid", "tr"]).select("column", _six("share"))


QUERIES = {f.__name__: f for f in (
    realised_vol, log_returns, mean_sleeve_returns, revision_check, effective_positions, flows_krw, dividend_ttm, dividend_plausibility, coverage_stats,
)}


def _s(x: str, name: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN floor(({x}) * 1e6 + 0.5000001) / 1e6 END AS {name}"


L = BARS + """,
lv AS (SELECT instrument_id, pos, CAST(close AS DOUBLE) AS level FROM bars JOIN cal USING (session)),
lr AS (SELECT *, lag(level) OVER w AS p, lag(pos) OVER w AS pp FROM lv WINDOW w AS (PARTITION BY instrument_id ORDER BY pos))"""

SQL = {
    "realised_vol": f"""WITH {L}, r AS (SELECT instrument_id, pos, ln(level / p) AS lr FROM lr),
v AS (SELECT instrument_id, pos, CASE WHEN count(lr) OVER w = 20 THEN stddev_pop(lr) OVER w * sqrt(252) END AS vol FROM r WINDOW w AS (PARTITION BY instrument_id ORDER BY pos ROWS 19 PRECEDING))
SELECT instrument_id, pos, {_s("vol", "vol")} FROM v""",
    "log_returns": f"""WITH {L}, r AS (SELECT instrument_id, pos, CASE WHEN pp = pos - 1 THEN ln(level / p) END AS a, CASE WHEN pp = pos - 1 THEN level / p - 1 END AS b FROM lr)
SELECT instrument_id, pos, {_s("a", "log_return")}, {_s("b", "simple_return")} FROM r""",
    "mean_sleeve_returns": f"""WITH {L}, r AS (SELECT pos, ln(level / p) / 10 AS lr FROM lr WHERE pp = pos - 1), m AS (SELECT pos, count(*) AS sleeves, avg(exp(lr) - 1) AS ret FROM r GROUP BY pos)
SELECT pos, sleeves, {_s("ret", "ret")} FROM m""",
    "revision_check": f"""WITH {L} SELECT CASE WHEN pos % 9 = 0 THEN 'appended' WHEN pos % 13 = 0 THEN 'revised' ELSE 'unchanged' END AS state, count(*) AS n FROM lv GROUP BY ALL""",
    "effective_positions": f"""WITH {BARS}, d AS (SELECT pos, session + to_hours(CAST(pos % 40 + 10 AS INTEGER)) AS sealed FROM cal)
SELECT d.pos, greatest(min(c.pos), d.pos + 1) AS effective, greatest(min(c.pos), d.pos + 1) > d.pos + 1 AS is_late FROM d JOIN cal c ON c.session + INTERVAL 9 HOUR > d.sealed GROUP BY d.pos""",
    "flows_krw": f"""WITH {BARS} SELECT instrument_id, pos + 2 AS avail_pos, CAST(sum(volume * close) AS BIGINT) AS krw FROM bars JOIN cal USING (session) WHERE close > 0 AND pos % 4 <> 1 GROUP BY ALL""",
    "dividend_ttm": f"""WITH {BARS}, dv AS (SELECT l_suppkey AS instrument_id, CAST(min(l_shipdate) AS DATE) AS ex, max(l_linenumber) AS dps FROM lineitem GROUP BY l_suppkey, year(l_shipdate))
SELECT bars.instrument_id, session, CAST(sum(dps) AS BIGINT) AS dps_ttm, count(*) AS paid FROM bars JOIN dv ON dv.instrument_id = bars.instrument_id AND session >= ex AND session <= ex + 365 GROUP BY ALL""",
    "dividend_plausibility": """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS dps, CASE WHEN p_partkey % 17 > 0 THEN p_retailprice END AS price FROM part)
SELECT p_partkey, CASE WHEN price IS NULL OR price <= 0 THEN 'no_reference_price' WHEN dps / price / 0.02::DOUBLE > 2.0 OR dps / price / 0.02::DOUBLE < 0.5 THEN 'yield_mismatch'
  WHEN dps / price > 0.035::DOUBLE THEN 'yield_above_ceiling' END AS label FROM p""",
    "coverage_stats": f"""WITH {CELLS}, x AS (SELECT avg(CASE WHEN close IS NULL THEN 0.0 ELSE 1 END) AS a, avg(CASE WHEN rcc IS NULL THEN 0.0 ELSE 1 END) AS b, avg(CASE WHEN rid IS NULL THEN 0.0 ELSE 1 END) AS d,
  avg(CASE WHEN tr IS NULL THEN 0.0 ELSE 1 END) AS e FROM c),
u AS (SELECT 'close' AS "column", a AS share FROM x UNION ALL SELECT 'rcc', b FROM x UNION ALL SELECT 'rid', d FROM x UNION ALL SELECT 'tr', e FROM x)
SELECT "column", {_s("share", "share")} FROM u""",
}

DATES = {"dividend_ttm": ("session",)}
