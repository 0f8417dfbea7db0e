"""Panel queries over the shared tables, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.sources import tables as T

REGIMES = [
    P.Regime(date(1995, 1, 1), ((1000, 1), (2000, 5), (3000, 10), (None, 50)), {"MAIN": 0.0030, "GROWTH": 0.0025}, 15, 100),
    P.Regime(date(1998, 1, 1), ((2000, 1), (3000, 5), (None, 10)), {"MAIN": 0.0020, "GROWTH": 0.0018}, 30, 100),
]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.observed(spark, sf_dir).withColumn("fluc_rate", F.round(F.col("change") / F.when(F.col("base_price") > 0, F.col("base_price")) * 100, 2))
    state, reason = P.price_state()
    return b.withColumn("price_state", state).withColumn("invalid_reason", reason)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.market_panel(states(spark, sf_dir), REGIMES)


def _r(c: str, digits: int = 6):
    """Rounded half up by the same floating-point steps as in the SQL."""
    return (F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits).alias(c)


def daily_bars(spark, sf_dir):
    return T.bars(spark, sf_dir)


def calendar(spark, sf_dir):
    return T.sessions(spark, sf_dir)


def price_states(spark, sf_dir):
    return states(spark, sf_dir).select("instrument_id", "session", "price_state", "invalid_reason")


def base_adjusted(spark, sf_dir):
    return P.base_adjusted(T.observed(spark, sf_dir))


def gap_returns(spark, sf_dir):
    return panel(spark, sf_dir).select("instrument_id", "session", "gap_before", _r("ret_price"), _r("share_factor"))


def exchange_rules(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "instrument_id", "session", "tick_size", "sell_tax_rate", "upper_limit", "lower_limit", "limits_applicable",
        "open_at_upper", "open_at_lower", "close_at_upper", "close_at_lower",
    )


def liquidity(spark, sf_dir):
    return panel(spark, sf_dir).select("instrument_id", "session", _r("adtv20", 4), _r("adtv60", 4))


def ret_vol60(spark, sf_dir):
    return P.ret_vol(panel(spark, sf_dir)).select("instrument_id", "session", _r("ret_vol60"))


def limitless_moves(spark, sf_dir):
    return P.limitless_moves(panel(spark, sf_dir)).select("instrument_id", "session", _r("move"))


def instrument_exits(spark, sf_dir):
    return P.instrument_exits(T.observed(spark, sf_dir))


def panel_summary(spark, sf_dir):
    return P.panel_summary(panel(spark, sf_dir))


def panel_key_check(spark, sf_dir):
    return P.duplicate_keys(panel(spark, sf_dir), ["session", "instrument_id"])


def rule_coverage_check(spark, sf_dir):
    return P.rule_gaps(panel(spark, sf_dir)).groupBy("market").agg(F.count("*").alias("uncovered"))


def _benchmark(spark, sf_dir, weight):
    p = panel(spark, sf_dir)
    days = p.select("session", "pos").distinct()
    out = P.reference_benchmark(p, days, weight, (F.col("price_state") == "tradable"))
    return out.select("session", _r("ret"), _r("log_level"), "constituents", _r("dropped_weight"))


def benchmark_equal(spark, sf_dir):
    return _benchmark(spark, sf_dir, F.lit(1.0))


def benchmark_cap(spark, sf_dir):
    return _benchmark(spark, sf_dir, F.col("market_cap").cast("double"))


QUERIES = {f.__name__: f for f in (
    daily_bars, calendar, price_states, base_adjusted, gap_returns, exchange_rules, liquidity, ret_vol60, limitless_moves, instrument_exits,
    panel_summary, panel_key_check, rule_coverage_check, benchmark_equal, benchmark_cap,
)}

#: Common tables of the oracle SQL.
BARS = """
li AS (
  SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price,
    row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place, l_quantity, l_extendedprice FROM lineitem),
d0 AS (
  SELECT instrument_id, session, arg_min(price, place) AS open, max(price) AS high, min(price) AS low, arg_max(price, place) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume, round(sum(l_extendedprice), 2) AS value FROM li GROUP BY ALL),
d1 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY instrument_id ORDER BY session), close) AS base_price FROM d0),
bars AS (
  SELECT instrument_id, session, open, high, low, close, volume, value, base_price, close - base_price AS change,
    CASE WHEN n_regionkey % 2 = 0 THEN 'MAIN' ELSE 'GROWTH' END AS market, CAST(1000000 + s_suppkey * 1000 AS BIGINT) AS listed_shares,
    close * CAST(1000000 + s_suppkey * 1000 AS BIGINT) AS market_cap
  FROM d1 JOIN supplier ON s_suppkey = instrument_id JOIN nation ON s_nationkey = n_nationkey),
cal AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT session FROM bars))"""

STATES = BARS + """,
f AS (SELECT *, round(change / nullif(base_price, 0) * 100, 2) AS fluc_rate FROM bars JOIN cal USING (session)),
st AS (
  SELECT *, CASE WHEN close <= 0 OR base_price <= 0 THEN 'non_positive_close_or_base'
    WHEN abs(change / nullif(base_price, 0) * 100 - fluc_rate) > 0.01 THEN 'fluc_mismatch' WHEN volume = 0 THEN NULL
    WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'ohlc_inconsistent' END AS invalid_reason FROM f),
states AS (
  SELECT *, CASE WHEN invalid_reason IS NOT NULL THEN 'invalid' WHEN volume = 0 THEN 'zero_volume' ELSE 'tradable' END AS price_state FROM st)"""


def _tick(p: str) -> str:
    return (
        f"CASE WHEN session >= DATE '1998-01-01' THEN CASE WHEN {p} < 2000 THEN 1 WHEN {p} < 3000 THEN 5 ELSE 10 END "
        f"ELSE CASE WHEN {p} < 1000 THEN 1 WHEN {p} < 2000 THEN 5 WHEN {p} < 3000 THEN 10 ELSE 50 END END"
    )


PANEL = STATES + f""",
p0 AS (
  SELECT *, lag(pos) OVER w IS NULL AS first, coalesce(lag(pos) OVER w <> pos - 1, false) AS gap_before, lag(close) OVER w AS prev_close,
    {_tick("close")} AS tick_size, {_tick("base_price")} AS bt,
    CASE WHEN session >= DATE '1998-01-01' THEN CASE market WHEN 'MAIN' THEN 0.0020 ELSE 0.0018 END
      ELSE CASE market WHEN 'MAIN' THEN 0.0030 ELSE 0.0025 END END AS sell_tax_rate,
    CASE WHEN session >= DATE '1998-01-01' THEN 30 ELSE 15 END AS num
  FROM states WINDOW w AS (PARTITION BY instrument_id ORDER BY session)),
p1 AS (SELECT *, base_price + base_price * num // 100 // bt * bt AS up, greatest(base_price - base_price * num // 100 // bt * bt, 0) AS down FROM p0),
p2 AS (SELECT *, {_tick("up")} AS ut, {_tick("down")} AS dt FROM p1),
p3 AS (
  SELECT *, CASE WHEN NOT first THEN up // ut * ut END AS upper_limit,
    CASE WHEN NOT first THEN greatest((down + dt - 1) // dt * dt, dt) END AS lower_limit,
    CASE WHEN NOT first AND price_state <> 'invalid' THEN change / base_price END AS ret_price,
    CASE WHEN NOT first AND price_state <> 'invalid' AND NOT gap_before THEN prev_close / base_price END AS share_factor FROM p2),
p4 AS (
  SELECT *, NOT coalesce(first OR price_state = 'invalid' OR (price_state = 'tradable' AND (high > upper_limit OR low < lower_limit)), true)
    AS limits_applicable FROM p3),
panel AS (
  SELECT *, coalesce(limits_applicable AND price_state = 'tradable' AND open = upper_limit, false) AS open_at_upper,
    coalesce(limits_applicable AND price_state = 'tradable' AND open = lower_limit, false) AS open_at_lower,
    coalesce(limits_applicable AND price_state = 'tradable' AND close = upper_limit, false) AS close_at_upper,
    coalesce(limits_applicable AND price_state = 'tradable' AND close = lower_limit, false) AS close_at_lower,
    CASE WHEN count(value) OVER w20 = 20 THEN avg(value) OVER w20 END AS adtv20,
    CASE WHEN count(value) OVER w60 = 60 THEN avg(value) OVER w60 END AS adtv60
  FROM p4 WINDOW w20 AS (PARTITION BY instrument_id ORDER BY session ROWS 19 PRECEDING), w60 AS (PARTITION BY instrument_id ORDER BY session ROWS 59 PRECEDING))"""


def _benchmark_sql(weight: str) -> str:
    return f"""WITH {PANEL},
m AS (SELECT *, lead(pos) OVER w AS np, lead(ret_price) OVER w AS nr, CAST({weight} AS DOUBLE) AS wt FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY session)),
g AS (
  SELECT pos + 1 AS pos, sum(CASE WHEN np = pos + 1 AND nr IS NOT NULL THEN wt * nr END) / sum(CASE WHEN np = pos + 1 AND nr IS NOT NULL THEN wt END) AS ret,
    sum(CASE WHEN np = pos + 1 AND nr IS NOT NULL THEN wt END) / sum(wt) AS kept, count(*) FILTER (np = pos + 1 AND nr IS NOT NULL) AS constituents
  FROM m WHERE price_state = 'tradable' GROUP BY pos)
SELECT session, floor(coalesce(ret, 0) * 1e6 + 0.5) / 1e6 AS ret, floor(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY pos) * 1e6 + 0.5) / 1e6 AS log_level, constituents,
  floor((1 - coalesce(kept, 0)) * 1e6 + 0.5) / 1e6 AS dropped_weight FROM g JOIN cal USING (pos)"""


SQL = {
    "daily_bars": f"WITH {BARS} SELECT * FROM bars",
    "calendar": f"WITH {BARS} SELECT * FROM cal",
    "price_states": f"WITH {STATES} SELECT instrument_id, session, price_state, invalid_reason FROM states",
    "base_adjusted": f"""WITH {BARS}, b AS (SELECT * FROM bars JOIN cal USING (session))
SELECT x.session, CAST(sum(CASE WHEN x.base_price <> y.close THEN 1 ELSE 0 END) AS BIGINT) AS adjusted
FROM b x JOIN b y ON x.instrument_id = y.instrument_id AND x.pos = y.pos + 1 GROUP BY x.session""",
    "gap_returns": f"WITH {PANEL} SELECT instrument_id, session, gap_before, floor(ret_price * 1e6 + 0.5) / 1e6 AS ret_price, floor(share_factor * 1e6 + 0.5) / 1e6 AS share_factor FROM panel",
    "exchange_rules": f"""WITH {PANEL} SELECT instrument_id, session, CAST(tick_size AS BIGINT) AS tick_size, CAST(sell_tax_rate AS DOUBLE) AS sell_tax_rate,
  CAST(upper_limit AS BIGINT) AS upper_limit, CAST(lower_limit AS BIGINT) AS lower_limit, limits_applicable, open_at_upper, open_at_lower, close_at_upper, close_at_lower FROM panel""",
    "liquidity": f"WITH {PANEL} SELECT instrument_id, session, floor(adtv20 * 1e4 + 0.5) / 1e4 AS adtv20, floor(adtv60 * 1e4 + 0.5) / 1e4 AS adtv60 FROM panel",
    "ret_vol60": f"""WITH {PANEL},
k AS (SELECT instrument_id, session, CASE WHEN count(*) OVER w = 60 THEN stddev_samp(ret_price) OVER w END AS v FROM panel WHERE ret_price IS NOT NULL
  WINDOW w AS (PARTITION BY instrument_id ORDER BY session ROWS 59 PRECEDING))
SELECT p.instrument_id, p.session, floor(last_value(v IGNORE NULLS) OVER (PARTITION BY p.instrument_id ORDER BY p.session) * 1e6 + 0.5) / 1e6 AS ret_vol60
FROM panel p LEFT JOIN k ON k.instrument_id = p.instrument_id AND k.session = p.session""",
    "limitless_moves": f"""WITH {PANEL} SELECT instrument_id, session, floor(abs(close / nullif(base_price, 0) - 1) * 1e6 + 0.5) / 1e6 AS move FROM panel
WHERE price_state = 'tradable' AND NOT limits_applicable AND NOT first AND base_price > 0 AND abs(close / nullif(base_price, 0) - 1) > 0.30""",
    "instrument_exits": f"""WITH {BARS}
SELECT instrument_id, max(session) AS last_session, arg_max(close, session) AS last_close, arg_max(volume, session) AS last_volume,
  CASE WHEN arg_max(volume, session) = 0 THEN 'halted' ELSE 'traded' END AS exit_kind
FROM bars GROUP BY instrument_id HAVING max(session) < (SELECT max(session) FROM bars)""",
    "panel_summary": f"""WITH {PANEL} SELECT market, count(*) AS rows, count(*) FILTER (gap_before) AS gaps, count(*) FILTER (base_price <> close - change) AS base_conflicts,
  count(*) FILTER (close_at_upper) AS upper_locks, count(*) FILTER (close_at_lower) AS lower_locks, count(*) FILTER (NOT limits_applicable) AS limitless,
  count(*) FILTER (price_state = 'invalid') AS invalid, count(*) FILTER (price_state = 'zero_volume') AS zero_volume FROM panel GROUP BY market""",
    "panel_key_check": f"WITH {PANEL} SELECT session, instrument_id, count(*) AS n FROM panel GROUP BY ALL HAVING count(*) > 1",
    "rule_coverage_check": f"WITH {PANEL} SELECT market, count(*) AS uncovered FROM panel WHERE tick_size IS NULL OR sell_tax_rate IS NULL GROUP BY market",
    "benchmark_equal": _benchmark_sql("1.0"),
    "benchmark_cap": _benchmark_sql("market_cap"),
}

DATES = dict.fromkeys(
    ("daily_bars", "calendar", "price_states", "base_adjusted", "gap_returns", "exchange_rules", "liquidity", "ret_vol60", "limitless_moves", "benchmark_equal", "benchmark_cap"),
    ("session",),
) | {"instrument_exits": ("last_session",)}
