"""Holdings that stay, contracts, impact and dividend returns over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import fundamentals as K
from tidemark.operators import orders as O
from tidemark.operators import panel as P
from tidemark.plans.panel import BARS, PANEL, REGIMES, _tick, panel
from tidemark.sources import datasets as D
from tidemark.sources import tables as T
from tidemark.sources.scratch import written


def select_held(spark, sf_dir):
    """Five of the day's suppliers by their last price's digits, in four sleeves of every fourth session; those among the first nine stay."""
    o = T.observed(spark, sf_dir)
    score = F.when(F.col("volume") % 11 != 0, F.expr("instrument_id * 7919 % 101 + close % 37"))
    return E.select_held(o.select((F.col("pos") % 4).alias("sleeve"), "pos", "instrument_id", score.alias("score")), 5, 1.8)


def contract_targets(spark, sf_dir):
    """Contracts of one against each day's close, with halves that are ties."""
    o = T.observed(spark, sf_dir)
    signal = F.signum("change")
    return o.select("instrument_id", "pos", O.contract_target(F.lit(0.5), signal, F.lit(1.0), F.col("close") * (F.col("pos") % 9), F.lit(1), F.when(F.col("pos") % 8 != 0, F.col("close"))).alias("contracts"))


def impact_costs(spark, sf_dir):
    p = P.ret_vol(panel(spark, sf_dir))
    cost = O.impact(0.1, F.col("ret_vol60"), F.col("value"), F.when(F.col("adtv20") > 0, F.col("adtv20")))
    return p.select("instrument_id", "session", (F.floor(cost * 1e6 + 0.5) / 1e6).alias("impact"))


def priced_orders(spark, sf_dir):
    """An order for each trading day of a supplier, on the side of its key's parity; purchases of some are blocked, others' opens are absent."""
    p = P.ret_vol(panel(spark, sf_dir)).withColumn("entry_blocked", (F.col("instrument_id") % 17 == 0) & (F.col("pos") % 3 == 0)).withColumn("open", F.when(F.col("volume") % 23 != 0, F.col("open")).otherwise(0))
    p = written(p.select("instrument_id", "pos", "session", "open", "close", "volume", "upper_limit", "lower_limit", "open_at_upper", "open_at_lower", "entry_blocked", "adtv20", "ret_vol60"), "rows")
    side = F.when(F.col("instrument_id") % 2 == 0, "buy").otherwise("sell")
    orders = p.select("instrument_id", (F.col("pos") - F.col("pos") % 2).alias("pos"), side.alias("side"), (F.col("close") % 50 * 10 + 1).alias("quantity"), F.col("pos").alias("asked"))
    return O.priced_orders(orders, p, 0.5, 0.1, 0.001, 0.5, P.tick_for(F.col("open"), F.col("session"), REGIMES))


def dividend_returns(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    paid = T.table(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0").select(F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("ex_session"), F.col("l_linenumber").alias("dps"))
    got = K.dividend_return(paid, b, 0.154)
    return got.select("instrument_id", "session", (F.floor(F.col("dividend_return") * 1e9 + 0.5) / 1e9).alias("dividend_return"))


def scanned_columns(spark, sf_dir):
    """Columns of the suppliers' table by name; one that it lacks is NULL."""
    return T.scan_dataset(spark, f"{sf_dir}/supplier.parquet", ["s_suppkey", "s_name", "s_rating"])


def published_bars(spark, sf_dir):
    """A year's bars published under the name of their identity, pruned to it and read back."""
    from tidemark.sources.scratch import scratch

    b = T.bars(spark, sf_dir).select("instrument_id", "session", "close", F.year("session").alias("year"))
    path = D.publish_identity(b, f"{scratch(spark)}/published", "bars", {"tick": "floor"}, [sf_dir], ["year"])
    return D.scan(spark, path, ["year"], F.col("p_year") == 1997).groupBy("year").agg(F.count("*").alias("n"), F.sum("close").alias("closes"))


QUERIES = {f.__name__: f for f in (select_held, contract_targets, impact_costs, priced_orders, dividend_returns, scanned_columns, published_bars)}

VOL = PANEL + """, k AS (SELECT *, CASE WHEN ret_price IS NOT NULL THEN count(ret_price) OVER (PARTITION BY instrument_id ORDER BY session) END AS kr FROM panel),
o AS (SELECT *, CASE WHEN kr >= 60 THEN stddev_samp(ret_price) OVER (PARTITION BY instrument_id, ret_price IS NULL ORDER BY session ROWS 59 PRECEDING) END AS own FROM k),
fv AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY session ROWS UNBOUNDED PRECEDING) AS vol FROM o)"""

SQL = {
    "priced_orders": f"""WITH {VOL}, a AS (SELECT instrument_id, pos - pos % 2 AS pos, CASE WHEN instrument_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, close % 50 * 10 + 1 AS quantity, pos AS asked FROM bars JOIN cal USING (session)),
n AS (SELECT instrument_id, pos - 1 AS pos, CASE WHEN volume % 23 <> 0 THEN open ELSE 0 END AS op, volume AS nv, upper_limit AS ul, lower_limit AS ll, open_at_upper AS au, open_at_lower AS al, instrument_id % 17 = 0 AND pos % 3 = 0 AS eb,
  session FROM fv),
t AS (SELECT *, {_tick("op")} AS tick FROM n),
j AS (SELECT a.*, op, nv, ul, ll, au, al, eb, tick, d.adtv20 AS adtv, d.vol, coalesce(CASE WHEN d.adtv20 > 0 AND d.close > 0 THEN CAST(floor(0.5::DOUBLE * d.adtv20 / d.close) AS BIGINT) END, 0) AS cap
  FROM a LEFT JOIN t ON t.instrument_id = a.instrument_id AND t.pos = a.pos LEFT JOIN fv d ON d.instrument_id = a.instrument_id AND d.pos = a.pos),
r AS (SELECT *, CASE WHEN nv IS NULL THEN 'missing_price' WHEN nv = 0 THEN 'halted' WHEN side = 'buy' AND eb THEN 'entry_blocked' WHEN NOT op > 0 THEN 'missing_price' WHEN CASE WHEN side = 'buy' THEN au ELSE al END THEN 'limit_locked'
  WHEN cap <= 0 THEN 'capacity' WHEN vol IS NULL THEN 'no_volatility' END AS why FROM j),
fi AS (SELECT *, CASE WHEN why IS NULL THEN least(quantity, cap) ELSE 0 END AS filled FROM r),
m AS (SELECT *, 0.1::DOUBLE * vol * sqrt(filled * CAST(op AS DOUBLE) / adtv) + 0.001::DOUBLE AS move FROM fi)
SELECT instrument_id, pos, side, quantity, asked, filled, CASE WHEN filled > 0 THEN CAST(CASE WHEN side = 'buy' THEN least(ceil(op * (1.0::DOUBLE + move) + 0.5::DOUBLE * tick), coalesce(ul, 1e18))
  ELSE greatest(floor(op * (1.0::DOUBLE - move) - 0.5::DOUBLE * tick), coalesce(ll, 1), 1) END AS BIGINT) END AS price, coalesce(why, CASE WHEN filled < quantity THEN 'capacity' END) AS reject,
  CASE WHEN why IS NULL THEN quantity - filled ELSE quantity END AS rest FROM m""",
    # A state machine over each sleeve's decisions.
    "select_held": f"""WITH RECURSIVE {BARS}, x AS (SELECT pos % 4 AS sleeve, pos, instrument_id, CASE WHEN volume % 11 <> 0 THEN instrument_id * 7919 % 101 + close % 37 END AS score FROM bars JOIN cal USING (session)),
r AS (SELECT *, row_number() OVER (PARTITION BY sleeve, pos ORDER BY score DESC, instrument_id) AS rank FROM x WHERE score IS NOT NULL),
g AS (SELECT sleeve, pos, count(*) AS n, list(instrument_id ORDER BY rank) FILTER (rank <= 9) AS ids FROM r GROUP BY ALL),
d AS (SELECT y.sleeve, y.pos, coalesce(n, 0) >= 5 AS enough, coalesce(ids, []) AS ids, row_number() OVER (PARTITION BY y.sleeve ORDER BY y.pos) AS k FROM (SELECT DISTINCT sleeve, pos FROM x) y LEFT JOIN g USING (sleeve, pos)),
s(sleeve, k, pos, held) AS (
  SELECT DISTINCT sleeve, 0::BIGINT, -1::BIGINT, CAST([] AS BIGINT[]) FROM d
  UNION ALL
  SELECT s.sleeve, d.k, d.pos, CASE WHEN enough THEN list_concat(list_filter(ids, lambda i: list_contains(held, i)), list_filter(ids, lambda i: NOT list_contains(held, i)))[1:5] ELSE CAST([] AS BIGINT[]) END
  FROM s JOIN d ON d.sleeve = s.sleeve AND d.k = s.k + 1)
SELECT sleeve, pos, CAST(unnest(range(1, len(held) + 1)) AS INTEGER) AS rank, unnest(held) AS instrument_id FROM s WHERE k > 0""",
    "contract_targets": f"""WITH {BARS}, x AS (SELECT instrument_id, pos, CASE WHEN pos % 8 <> 0 THEN CAST(sign(change) AS BIGINT) * (pos % 9) END AS twice FROM bars JOIN cal USING (session))
SELECT instrument_id, pos, CASE WHEN twice >= 0 THEN twice // 2 ELSE -(-twice // 2) END AS contracts FROM x""",
    "impact_costs": f"""WITH {VOL}
SELECT instrument_id, session, floor(0.1::DOUBLE * vol * sqrt(value / CASE WHEN adtv20 > 0 THEN adtv20 END) * 1e6 + 0.5) / 1e6 AS impact FROM fv""",
    "dividend_returns": f"""WITH {BARS}, p AS (SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session, sum(l_linenumber) AS dps FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY ALL)
SELECT instrument_id, session, floor(dps * (1 - 0.154::DOUBLE) / base_price * 1e9 + 0.5) / 1e9 AS dividend_return FROM p JOIN bars USING (instrument_id, session) WHERE base_price > 0""",
    "scanned_columns": "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_rating FROM supplier",
    "published_bars": f"WITH {BARS} SELECT CAST(year(session) AS INTEGER) AS year, count(*) AS n, CAST(sum(close) AS BIGINT) AS closes FROM bars WHERE year(session) = 1997 GROUP BY ALL",
}
DATES = {"impact_costs": ("session",), "dividend_returns": ("session",)}
