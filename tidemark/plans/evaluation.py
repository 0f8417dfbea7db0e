"""Evaluation queries over suppliers' log returns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.plans.panel import BARS
from tidemark.sources import tables as T


def streams(spark, sf_dir):
    """(instrument_id, pos, i, log_return): hundredths of log changes of observed rows, i counting them from 0."""
    b = T.observed(spark, sf_dir)
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("instrument_id").orderBy("pos")) - 1
    return b.select("instrument_id", "pos", i.cast("long").alias("i"), (F.log(F.col("close") / F.col("base_price")) / 100).alias("log_return"))


def with_market(s):
    """Streams with the mean of all at their session: a row a session, so the broadcast side does not grow with the streams, which stay where they are."""
    return s.join(F.broadcast(s.groupBy("pos").agg(F.avg("log_return").alias("market"))), "pos")


def _shown(c: str):
    return F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 1e6 + 0.5000001) / 1e6).alias(c)


def point_metrics(spark, sf_dir):
    m = E.point_metrics(streams(spark, sf_dir), "instrument_id")
    return m.select("instrument_id", "n", *map(_shown, ("growth", "cagr", "sharpe", "max_drawdown", "calmar")))


def longest_underwater(spark, sf_dir):
    return E.longest_underwater(streams(spark, sf_dir), "instrument_id")


def bootstrap_profile(spark, sf_dir):
    s = streams(spark, sf_dir).select("instrument_id", F.col("i").alias("pos"), "log_return")
    return E.bootstrap_profile(s, "instrument_id", draws=4000, horizon=1260, block=63, seed=7, low=0.05, limit=-0.3)


def bootstrap_given_starts(spark, sf_dir):
    """The bootstrap with a table of starts, by which results can be compared exactly."""
    s = streams(spark, sf_dir).select("instrument_id", F.col("i").alias("pos"), "log_return")
    n = s.groupBy("instrument_id").agg(F.count("*").alias("n"))
    grid = n.where("n >= 63").select("instrument_id", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    starts = grid.select("instrument_id", "draw", "k", F.pmod(F.col("draw") * 131 + F.col("k") * 17 + F.col("instrument_id"), F.col("n") - 62).alias("start"))
    p = E.growth_profile(E.block_bootstrap(s, starts, "instrument_id", 252, 63), "instrument_id", 0.05, -0.3)
    return p.select("instrument_id", "draws", *map(_shown, ("g_low", "g_median", "p_loss", "p_deep", "mdd_median")))


def paired_growth_tail_delta(spark, sf_dir):
    """Each stream against the mean of all at its sessions, on the same paths."""
    s = streams(spark, sf_dir)
    pairs = with_market(s).select("instrument_id", F.col("i").alias("pos"), "log_return", "market")
    return E.paired_profile(pairs, "instrument_id", "log_return", "market", draws=4000, horizon=1260, block=63, seed=7, span=21, share=0.05, alpha=0.05)


def tail_mean(spark, sf_dir):
    return E.tail_mean(streams(spark, sf_dir), "instrument_id", 21, 0.1).select("instrument_id", F.col("k").cast("long").alias("k"), _shown("cvar"))


def ols_beta(spark, sf_dir):
    s = streams(spark, sf_dir)
    return E.ols_beta(with_market(s), "instrument_id", "log_return", "market").select("instrument_id", "n", _shown("beta"))


def rolling_beta(spark, sf_dir):
    s = streams(spark, sf_dir)
    return E.rolling_beta(with_market(s), "instrument_id", "log_return", "market", 60, 30, 2.0).select("instrument_id", "pos", _shown("beta"))


def hash_chain_check(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    payload = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    chain = E.hash_chain(o, "o_custkey", "o_orderkey", payload)
    broken = chain.withColumn("prev_hash", F.when(F.col("o_orderkey") % 1000 == 7, F.lit("x")).otherwise(F.col("prev_hash")))
    return E.chain_breaks(broken, "o_custkey", "o_orderkey", payload).select("o_custkey", "o_orderkey")


def journal_reconcile(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("cents"), "event_type")
    signed = e.withColumn("delta", F.when(F.col("event_type") == "purchase", -F.col("cents")).otherwise(F.floor(F.col("cents") / 4).cast("long")))
    return E.journal_reconcile(signed, "user_id", "event_id", "delta")


def stream_differences(spark, sf_dir):
    s = streams(spark, sf_dir).select("instrument_id", "pos", F.floor(F.col("log_return") * 1e6).cast("long").alias("v"))
    return E.stream_differences(s, s.where("pos % 50 <> 3").withColumn("v", F.when(F.col("pos") % 70 == 5, F.col("v") + 1).otherwise(F.col("v"))), ["instrument_id", "pos"], "v")


def asof_targets(spark, sf_dir):
    """What each decision holds at each session until the next one."""
    s = streams(spark, sf_dir)
    return E.asof_targets(s.select("instrument_id", "pos", F.col("i").alias("target")), s.select("pos").distinct(), "instrument_id")


def select_top(spark, sf_dir):
    return E.select_top(streams(spark, sf_dir).select("instrument_id", "pos", F.col("log_return").alias("score")), 5).select("pos", "instrument_id", F.col("rank").cast("long").alias("rank"))


def trend_signals(spark, sf_dir):
    b = T.observed(spark, sf_dir).select("instrument_id", "pos", F.col("close").alias("level"))
    return E.trend_signals(b, "instrument_id", [21, 63, 126], 50).select("instrument_id", "pos", _shown("tsmom"), "ma_signal")


QUERIES = {f.__name__: f for f in (
    point_metrics, longest_underwater, bootstrap_profile, bootstrap_given_starts, paired_growth_tail_delta, tail_mean, ols_beta, rolling_beta, hash_chain_check, journal_reconcile,
    stream_differences, asof_targets, select_top, trend_signals,
)}

S = BARS + """,
s AS (SELECT instrument_id, pos, row_number() OVER (PARTITION BY instrument_id ORDER BY pos) - 1 AS i, ln(close / base_price) / 100 AS log_return FROM bars JOIN cal USING (session)),
mk AS (SELECT pos, avg(log_return) AS market FROM s GROUP BY pos)"""
_W = "(PARTITION BY instrument_id ORDER BY pos)"


def _show(x: str, name: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN floor(({x}) * 1e6 + 0.5000001) / 1e6 END AS {name}"


SQL = {
    "point_metrics": f"""WITH {S}, l AS (SELECT *, sum(log_return) OVER {_W} AS level FROM s), d AS (SELECT *, exp(level - greatest(max(level) OVER {_W}, 0)) - 1 AS dd FROM l),
m AS (SELECT instrument_id, count(*) AS n, avg(log_return) AS mean, stddev_samp(log_return) AS sd, min(dd) AS mdd FROM d GROUP BY instrument_id)
SELECT instrument_id, n, {_show("mean * 252", "growth")}, {_show("exp(mean * 252) - 1", "cagr")}, {_show(f"CASE WHEN sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END", "sharpe")},
  {_show("least(mdd, 0)", "max_drawdown")}, {_show("CASE WHEN mdd < 0 THEN (exp(mean * 252) - 1) / -mdd END", "calmar")} FROM m""",
    "longest_underwater": f"""WITH {S}, l AS (SELECT *, sum(log_return) OVER {_W} AS level FROM s), u AS (SELECT *, level < greatest(max(level) OVER {_W}, 0) AS under FROM l),
k AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER {_W} AS island FROM u), r AS (SELECT instrument_id, island, count(*) FILTER (under) AS run FROM k GROUP BY ALL)
SELECT instrument_id, max(run) AS longest FROM r GROUP BY instrument_id""",
    "bootstrap_given_starts": f"""WITH {S}, n AS (SELECT instrument_id, count(*) AS n FROM s GROUP BY instrument_id HAVING count(*) >= 63),
st AS (SELECT instrument_id, d.draw, k.k, (d.draw * 131 + k.k * 17 + instrument_id) % (n - 62) AS start FROM n, range(10) d(draw), range(4) k(k)),
p AS (SELECT st.instrument_id, draw, k * 63 + o.o AS i, log_return FROM st, range(63) o(o) JOIN s ON s.instrument_id = st.instrument_id AND s.i = st.start + o.o WHERE k * 63 + o.o < 252),
l AS (SELECT *, sum(log_return) OVER w AS level FROM p WINDOW w AS (PARTITION BY instrument_id, draw ORDER BY i)),
e AS (SELECT *, exp(level - greatest(max(level) OVER (PARTITION BY instrument_id, draw ORDER BY i), 0)) - 1 AS dd FROM l),
g AS (SELECT instrument_id, draw, avg(log_return) * 252 AS g, min(dd) AS mdd FROM e GROUP BY ALL)
SELECT instrument_id, count(*) AS draws, {_show("quantile_cont(g, 0.05)", "g_low")}, {_show("quantile_cont(g, 0.5)", "g_median")}, {_show("avg(CASE WHEN g <= 0 THEN 1.0 ELSE 0 END)", "p_loss")},
  {_show("avg(CASE WHEN mdd < -0.3 THEN 1.0 ELSE 0 END)", "p_deep")}, {_show("quantile_cont(mdd, 0.5)", "mdd_median")} FROM g GROUP BY instrument_id""",
    "tail_mean": f"""WITH {S}, b AS (SELECT instrument_id, i // 21 AS b, sum(log_return) AS v FROM s GROUP BY ALL HAVING count(*) = 21),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY v, b) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY instrument_id) * 0.1, 0)) AS k FROM b)
SELECT instrument_id, count(*) AS k, {_show("avg(v)", "cvar")} FROM r WHERE r <= k GROUP BY instrument_id""",
    "ols_beta": f"WITH {S} SELECT instrument_id, count(*) AS n, {_show('coalesce(regr_slope(log_return, market), 0)', 'beta')} FROM s JOIN mk USING (pos) GROUP BY instrument_id",
    "rolling_beta": f"""WITH {S}, j AS (SELECT instrument_id, pos, log_return AS a, market AS b FROM s JOIN mk USING (pos)),
r AS (SELECT instrument_id, pos, count(a) OVER w AS n, avg(a * b) OVER w - avg(a) OVER w * avg(b) OVER w AS cov, avg(b * b) OVER w - avg(b) OVER w * avg(b) OVER w AS var FROM j
  WINDOW w AS (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
q AS (SELECT instrument_id, pos, CASE WHEN n >= 30 AND var > 1e-18 THEN greatest(0, least(2.0, cov / var)) ELSE 0 END AS beta FROM r)
SELECT instrument_id, pos, {_show("beta", "beta")} FROM q""",
    "hash_chain_check": """WITH c AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT o_custkey, o_orderkey FROM c WHERE o_orderkey % 1000 = 7""",
    "journal_reconcile": """WITH j AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN -CAST(floor(value * 100) AS BIGINT) ELSE CAST(floor(CAST(floor(value * 100) AS BIGINT) / 4) AS BIGINT) END AS d FROM events),
b AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS balance FROM j)
SELECT user_id, CAST(sum(d) AS BIGINT) AS final, CAST(min(balance) AS BIGINT) AS lowest, min(balance) < 0 AS overdrawn FROM b GROUP BY user_id""",
    "stream_differences": f"""WITH {S}, v AS (SELECT instrument_id, pos, CAST(floor(log_return * 1e6) AS BIGINT) AS v FROM s)
SELECT instrument_id, pos, v AS "left", CASE WHEN pos % 50 <> 3 THEN CASE WHEN pos % 70 = 5 THEN v + 1 ELSE v END END AS "right" FROM v WHERE pos % 50 = 3 OR pos % 70 = 5""",
    "asof_targets": f"""WITH {S}, d AS (SELECT instrument_id, pos, i AS target, lead(pos) OVER {_W} AS upto FROM s)
SELECT p.pos, instrument_id, target, d.pos AS decided FROM d JOIN (SELECT DISTINCT pos FROM s) p ON p.pos >= d.pos AND (upto IS NULL OR p.pos < upto)""",
    "select_top": f"""WITH {S}, r AS (SELECT pos, instrument_id, row_number() OVER (PARTITION BY pos ORDER BY log_return DESC, instrument_id) AS rank, count(*) OVER (PARTITION BY pos) AS n FROM s)
SELECT pos, instrument_id, rank FROM r WHERE rank <= 5 AND n >= 5""",
    "trend_signals": f"""WITH {BARS}, l AS (SELECT instrument_id, pos, close AS level FROM bars JOIN cal USING (session)),
t AS (SELECT *, (sign(level - lag(level, 21) OVER {_W}) + sign(level - lag(level, 63) OVER {_W}) + sign(level - lag(level, 126) OVER {_W})) / 3 AS tsmom,
  count(level) OVER w AS n, avg(level) OVER w AS m FROM l WINDOW w AS (PARTITION BY instrument_id ORDER BY pos ROWS 49 PRECEDING))
SELECT instrument_id, pos, {_show("tsmom", "tsmom")}, CASE WHEN n = 50 THEN CASE WHEN level > m THEN 1 ELSE -1 END END AS ma_signal FROM t""",
}

DATES: dict[str, tuple[str, ...]] = {}
