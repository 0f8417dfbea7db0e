"""Feature queries over the dense grid, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.plans.panel import BARS
from tidemark.sources import tables as T


def cells(spark, sf_dir):
    instruments = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instrument_id")).distinct()
    return X.returns(X.densify(T.observed(spark, sf_dir, flows=True), T.sessions(spark, sf_dir), instruments))


def observed_cells(spark, sf_dir):
    """The present cells alone, which all features are made of."""
    return X.returns(T.observed(spark, sf_dir, flows=True).withColumn("present", F.lit(True)))


def _shown(c: str):
    """Clipped and rounded by the same floating-point steps as in the SQL."""
    x = F.least(F.greatest(F.col(c), F.lit(-1e3)), F.lit(1e3))
    return F.when(F.col(c).isNotNull(), F.floor(x * 1e4 + 0.5000001) / 1e4).alias(c)


def _query(features, prepare=lambda c, calendar: c):
    def run(spark, sf_dir):
        named = features()
        return X.select_features(prepare(observed_cells(spark, sf_dir), T.sessions(spark, sf_dir)), named).select("instrument_id", "pos", *map(_shown, named))

    return run


def grid_coverage(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("instrument_id").agg(
        F.count("*").alias("cells"), F.sum(F.col("present").cast("long")).alias("present"), F.count("rcc").alias("known_returns")
    )


def rank_features(spark, sf_dir):
    rows = X.select_features(observed_cells(spark, sf_dir), {"r1": F.col("rcc")})
    return X.rank_normalize(rows, "r1", 5).select("instrument_id", "pos", (F.floor(F.col("rank") * 1e6 + 0.5) / 1e6).alias("rank"))


def winsor_features(spark, sf_dir):
    rows = X.select_features(observed_cells(spark, sf_dir), {"r1": F.col("rcc")})
    return X.winsor_z(rows, "r1", 0.05, 0.95, 5).select("instrument_id", "pos", _shown("z"))


def weekly_sessions(spark, sf_dir):
    return X.weekly_positions(T.sessions(spark, sf_dir))


QUERIES = {
    "grid_coverage": grid_coverage,
    "features_momentum": _query(X.momentum_features),
    "features_levels": _query(X.level_features, lambda c, calendar: X.with_held(c)),
    "features_volatility": _query(X.volatility_features),
    "features_sessions": _query(X.session_features),
    "features_liquidity": _query(X.liquidity_features),
    "features_flows": _query(lambda: X.flow_features("net") | X.flow_features("returned") | X.flow_features("taken")),
    "features_market": _query(X.market_features, X.with_market_return),
    "forward_labels": _query(X.labels, X.unit_open),
    "rank_features": rank_features,
    "winsor_features": winsor_features,
    "weekly_sessions": weekly_sessions,
}

CELLS = BARS + """,
nf AS (
  SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END) AS net,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END) AS returned, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END) AS taken FROM lineitem GROUP BY ALL),
gr AS (SELECT * FROM (SELECT DISTINCT instrument_id FROM bars), (SELECT pos FROM cal)),
ob AS (SELECT * EXCLUDE (session), true AS there FROM bars JOIN cal USING (session) JOIN nf USING (instrument_id, session)),
c0 AS (
  SELECT *, coalesce(there, false) AS present, CASE WHEN base_price > 0 THEN close / base_price - 1 END AS rcc FROM gr LEFT JOIN ob USING (instrument_id, pos)),
c1 AS (
  SELECT *, CASE WHEN coalesce(volume > 0, false) AND base_price > 0 THEN open / base_price - 1 ELSE rcc END AS ron,
    CASE WHEN coalesce(volume > 0, false) AND open > 0 THEN close / open - 1 END AS rid,
    exp(sum(ln(1 + coalesce(rcc, 0))) OVER (PARTITION BY instrument_id ORDER BY pos)) AS adj,
    CASE WHEN market_cap > 0 THEN CAST(market_cap AS DOUBLE) END AS mcap FROM c0),
c AS (SELECT *, CASE WHEN present THEN adj END AS tr FROM c1)"""


def _w(n: int) -> str:
    return f"OVER (PARTITION BY instrument_id ORDER BY pos ROWS {n - 1} PRECEDING)"


def _roll(f: str, x: str, n: int, least: int) -> str:
    return f"(CASE WHEN count({x}) {_w(n)} >= {least} THEN {f}({x}) {_w(n)} END)"


def _mean(x: str, n: int, least: int) -> str:
    return _roll("avg", x, n, least)


def _lag(x: str, k: int) -> str:
    return f"{'lag' if k >= 0 else 'lead'}({x}, {abs(k)}) OVER (PARTITION BY instrument_id ORDER BY pos)"


def _show(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN floor(least(greatest({x}, -1e3), 1e3) * 1e4 + 0.5000001) / 1e4 END"


def _sql(features: dict[str, str], more: str = "", source: str = "c") -> str:
    inner = ", ".join(f"{x} AS {n}" for n, x in features.items())
    return f"WITH {CELLS}{more}, f AS (SELECT instrument_id, pos, present, {inner} FROM {source}) SELECT instrument_id, pos, {', '.join(f'{_show(n)} AS {n}' for n in features)} FROM f WHERE present"


def _ratio(k: int) -> str:
    return f"CASE WHEN {_lag('tr', k)} > 0 THEN tr / {_lag('tr', k)} - 1 END"


_down = "(CASE WHEN rcc IS NOT NULL THEN least(rcc, 0.0) END)"
_span = "ln(high / (CASE WHEN low > 0 THEN low END))"
_m1, _m2, _m3 = (_mean(x, 60, 30) for x in ("rcc", "(rcc * rcc)", "(rcc * rcc * rcc)"))
_tv20 = _mean("value", 20, 10)
_var = f"({_mean('(rm * rm)', 60, 30)} - {_mean('rm', 60, 30)} * {_mean('rm', 60, 30)})"
_beta = f"(CASE WHEN {_var} > 1e-12 THEN ({_mean('(rcc * rm)', 60, 30)} - {_mean('rcc', 60, 30)} * {_mean('rm', 60, 30)}) / {_var} END)"
_vol60 = _roll("stddev_pop", "rcc", 60, 30)
_coalesced = "coalesce({}, 0)"

SQL = {
    "grid_coverage": f"WITH {CELLS} SELECT instrument_id, count(*) AS cells, count(*) FILTER (present) AS present, count(rcc) AS known_returns FROM c GROUP BY instrument_id",
    "features_momentum": _sql(
        {"ret_1d": "rcc"} | {f"ret_{k}": _ratio(k) for k in (5, 10, 21)} | {f"mom_{k}_21": f"CASE WHEN {_lag('tr', k)} > 0 THEN {_lag('tr', 21)} / {_lag('tr', k)} - 1 END" for k in (63, 126, 252)}
    ),
    "features_levels": _sql(
        {"hi52": f"adj / {_roll('max', 'adj', 252, 126)}", "lo52": f"adj / {_roll('min', 'adj', 252, 126)}", "dist_hi20": f"adj / {_roll('max', 'adj', 20, 10)}"}
        | {f"dev_ma{w}": f"adj / {_mean('adj', w, w // 2)} - 1" for w in (20, 60, 120)}
    ),
    "features_volatility": _sql({
        "vol20": _roll("stddev_pop", "rcc", 20, 10), "vol60": _vol60, "vol_ratio": f"{_roll('stddev_pop', 'rcc', 20, 10)} / nullif({_vol60}, 0)",
        "pvol20": f"sqrt({_mean(f'({_span} * {_span} / (4 * ln(2)))', 20, 10)})", "range20": _mean("((high - low) / (CASE WHEN close > 0 THEN close END))", 20, 10),
        "max21": _roll("max", "rcc", 21, 10), "min21": _roll("min", "rcc", 21, 10),
        "skew60": f"({_m3} - 3 * {_m1} * {_m2} + 2 * {_m1} * {_m1} * {_m1}) / pow(greatest({_m2} - {_m1} * {_m1}, 1e-12), 1.5)",
        "dvol60": f"sqrt({_mean(f'({_down} * {_down})', 60, 30)})",
    }),
    "features_sessions": _sql({
        "on20": _mean("ron", 20, 10), "id20": _mean("rid", 20, 10), "on60": _mean("ron", 60, 30), "id60": _mean("rid", 60, 30), "gap1": "ron", "absgap20": _mean("abs(ron)", 20, 10),
    }),
    "features_liquidity": _sql({
        "size": "ln(mcap)", "lnadtv": f"ln({_tv20})", "turn20": f"{_tv20} / mcap", "vol_surge5_60": f"{_mean('value', 5, 3)} / nullif({_mean('value', 60, 30)}, 0)",
        "tv_z1": f"value / nullif({_tv20}, 0)", "amihud20": _mean("(CASE WHEN value > 0 THEN abs(rcc) / (value / 1e9) END)", 20, 10),
        "upvol20": f"sum(coalesce(CASE WHEN rcc > 0 THEN value END, 0)) {_w(20)} / greatest(sum(coalesce(value, 0)) {_w(20)}, 1.0)",
    }),
    "features_flows": _sql({f"fl_{x}_{w}": f"CASE WHEN count({x}) {_w(w)} >= {0.6 * w} THEN sum(coalesce({x}, 0)) {_w(w)} / mcap END" for x in ("net", "returned", "taken") for w in (5, 20, 60)}),
    "features_market": _sql(
        {"beta60": _beta, "ivol60": f"sqrt(greatest({_vol60} * {_vol60} - {_beta} * {_beta} * {_var}, 0))"},
        """, pc AS (SELECT *, lag(mcap) OVER (PARTITION BY instrument_id ORDER BY pos) AS pcap FROM c),
mr AS (SELECT pos, coalesce(sum(CASE WHEN rcc IS NOT NULL THEN pcap * rcc END), 0) / greatest(coalesce(sum(CASE WHEN rcc IS NOT NULL THEN pcap END), 0), 1.0) AS rm FROM pc GROUP BY pos),
cm AS (SELECT * FROM c JOIN mr USING (pos))""", "cm",
    ),
    "forward_labels": _sql(
        {f"y{h}": f"CASE WHEN {_lag('uo', -1)} > 0 THEN {_lag('uo', -1 - h)} / {_lag('uo', -1)} - 1 END" for h in (5, 10, 21)},
        """, cu AS (SELECT *, last_value(tr IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * (1 + coalesce(ron, 0)) AS uo FROM c)""", "cu",
    ),
    "rank_features": f"""WITH {CELLS}, k AS (SELECT instrument_id, pos, rcc, count(rcc) OVER (PARTITION BY pos) AS n, row_number() OVER (PARTITION BY pos, rcc IS NULL ORDER BY rcc, instrument_id) AS r FROM c WHERE present)
SELECT instrument_id, pos, CASE WHEN rcc IS NOT NULL AND n >= 5 THEN floor((r - 0.5) / n * 1e6 + 0.5) / 1e6 END AS rank FROM k""",
    "winsor_features": f"""WITH {CELLS}, q AS (SELECT pos, quantile_cont(rcc, 0.05) AS a, quantile_cont(rcc, 0.95) AS b, count(rcc) AS n FROM c WHERE present GROUP BY pos),
v AS (SELECT instrument_id, pos, n, rcc, greatest(least(rcc, b), CASE WHEN rcc IS NOT NULL THEN a END) AS x FROM c JOIN q USING (pos) WHERE present),
s AS (SELECT *, stddev_pop(x) OVER (PARTITION BY pos) AS sd, avg(x) OVER (PARTITION BY pos) AS m FROM v),
z AS (SELECT instrument_id, pos, CASE WHEN sd > 1e-12 AND n >= 5 AND rcc IS NOT NULL THEN (x - m) / sd END AS z FROM s)
SELECT instrument_id, pos, {_show("z")} AS z FROM z""",
    "weekly_sessions": f"""WITH {BARS}, n AS (SELECT session, pos, lead(session) OVER (ORDER BY pos) AS nx FROM cal)
SELECT session, pos FROM n WHERE nx IS NOT NULL AND yearweek(nx) <> yearweek(session)""",
}

DATES = {"weekly_sessions": ("session",)}
