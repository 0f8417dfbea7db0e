"""Annual releases, report cards, challenges, knobs and slippage over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import fundamentals as K
from tidemark.operators import panel as P
from tidemark.operators import pit
from tidemark.operators import reports as R
from tidemark.plans.evaluation import SQL as EVALUATION_SQL
from tidemark.plans.evaluation import S, bootstrap_given_starts, streams, with_market
from tidemark.plans.panel import PANEL, REGIMES, _tick, panel
from tidemark.plans.pit import NAMES, STEPS, _calendar, _end, _facts, _known
from tidemark.sources import tables as T
from tidemark.sources.scratch import written

METRICS = ["op", "ni", "sales"]


def _released(spark, sf_dir):
    """Every second version is a release; of a year's last quarter it states the year, four times the quarter's value."""
    k = _known(spark, sf_dir).where("version % 2 = 0").where(F.col("fact").isin(*METRICS))
    annual = F.col("quarter") % 4 == 3
    times = F.when(annual, 4.0).otherwise(1.0)
    return k.select(
        "company_id", "quarter", F.col("fact").alias("metric"), "basis", F.when(annual, "annual").otherwise("quarter").alias("span"), "avail_pos", "version",
        F.when(F.col("version") % 6 != 0, F.col("value") * times).alias("value"), F.when(F.col("version") % 10 != 0, F.col("value") * times / 2).alias("prior_value"),
    )


def _quarters(spark, sf_dir, facts):
    return pit.release_quarters(_released(spark, sf_dir), facts)


def _cent(c: str):
    return F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 1e2 + 0.5000001) / 1e2).alias(c)


def annual_releases(spark, sf_dir):
    return _quarters(spark, sf_dir, _facts(spark, sf_dir)).select("company_id", "quarter", "metric", "avail_pos", "version", _cent("value"), _cent("prior_value"))


def release_pairs(spark, sf_dir):
    steps = pit.release_pair_steps(_quarters(spark, sf_dir, _facts(spark, sf_dir)), METRICS)
    return steps.select("company_id", "pos", "quarter", "known_pos", *(_cent(c) for m in METRICS for c in (m, f"{m}_ly")))


def earnings_surprises(spark, sf_dir):
    """At each session, by the newer of filing and release."""
    facts = written(_facts(spark, sf_dir), "facts")
    values = [c for m in METRICS for c in (m, f"{m}_ly")]
    known = K.quarter_complete(facts).select("company_id", "quarter", F.col("pos").alias("known_pos"))
    filed = pit.fact_steps(facts, NAMES).join(known, ["company_id", "quarter"]).select("company_id", "pos", "quarter", "known_pos", *values)
    released = pit.release_pair_steps(_quarters(spark, sf_dir, facts), METRICS)
    changes = pit.changes_of([filed, released], "company_id")
    shown = [pit.asof_steps(x, changes, "company_id").where("quarter is not null") for x in (filed, released)]
    # What is shown changes with a step only, so the choice is made there and held for the sessions up to the next one.
    best = pit.held_steps(pit.best_earnings(*shown), _end(spark, sf_dir), "company_id").join(F.broadcast(_calendar(spark, sf_dir)), "pos").withColumn("age", F.year("session") * 4 + F.quarter("session") - 1 - F.col("quarter"))
    out = pit.earnings_surprise(best.withColumn("mcap", (F.col("company_id") + 1) * 1_000_000.0))
    six = [F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 1e4 + 0.5000001) / 1e4).alias(c) for c in ("sue_op_e", "sue_ni_e", "sue_sales_e")]
    return out.select("company_id", "pos", "quarter", "origin", *six)


def report_cards(spark, sf_dir):
    """Two neighbouring suppliers are a run's stress streams; a stream is whole if it has its first 500 returns, and every seventh run failed a causality check."""
    run, stream = F.expr("instrument_id div 2").alias("run"), F.when(F.col("instrument_id") % 2 == 0, "slippage").otherwise("delay").alias("stream")
    profiles = bootstrap_given_starts(spark, sf_dir).select(run, stream, "g_low", "p_deep", "p_loss")
    s = streams(spark, sf_dir).where("i < 500").select(run, stream, F.col("i").cast("long").alias("pos"), "log_return")
    whole = R.stream_integrity(s, ["run", "stream"], spark.range(500).select(F.col("id").alias("pos")))
    checks = profiles.select("run").distinct().select("run", F.when(F.col("run") % 7 == 3, 1).otherwise(0).alias("mismatches"))
    card = R.report_card(profiles, whole, checks, ["slippage", "delay"], 0.2, 0.5)
    return card.withColumn("failed", F.array_join("failed", ","))


def challenges(spark, sf_dir):
    """Suppliers challenge the mean of all; a supplier's neighbour is the next one, and its knobs are digits of its key."""
    s = streams(spark, sf_dir)
    pairs = with_market(s).select("instrument_id", F.col("i").alias("pos"), "log_return", "market")
    draws = E.paired_lists(pairs, "instrument_id", "log_return", "market", draws=1000, horizon=504, block=63, seed=11, span=21, share=0.05)
    family = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id"), (F.col("s_suppkey") % 5).alias("prior"))
    deltas = written(R.challenge_bounds(draws, "instrument_id", family, 0.05), "deltas")
    asked = deltas.select(F.col("instrument_id").alias("challenger"), (F.col("instrument_id") % 9 != 0).alias("passed"), F.col("growth_mean").alias("objective"), F.lit(0.0).alias("champion_objective"), "growth_lower", "tail_lower")
    near = deltas.select((F.col("instrument_id") - 1).alias("challenger"), F.col("instrument_id").cast("string").alias("neighbour"), F.lit("policy.n").alias("knob"), "growth_mean", "tail_mean")
    knobs = F.array_compact(F.array(F.when(F.col("instrument_id") % 2 == 0, "policy.n"), F.when(F.col("instrument_id") % 11 == 0, "hedge.ratio"), F.lit("scorer.depth")))
    changes = deltas.select(F.col("instrument_id").alias("challenger"), F.explode(knobs).alias("knob"))
    out = R.challenge_decision(asked, near, changes, 0.05)
    return out.select("challenger", "path", F.array_join("reasons", ",").alias("reasons"))


def knob_changes(spark, sf_dir):
    """Specs of orders, by digits of the order's and of the customer's key: numbers, truth values, texts and lists, some of them absent on a side."""
    o, k, c = T.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")

    def spec(n):
        policy = F.struct((n % 5).alias("n"), (n % 3 / 2).alias("keep"), F.when(n % 4 == 0, F.lit(1)).alias("extra"), F.array(n % 7).alias("horizons"))
        hedge = F.struct((n % 2 == 0).alias("on"), F.struct((n % 6).alias("ratio"), F.concat(F.lit("5"), (n % 3).cast("string")).alias("name")).alias("future"))
        return F.to_json(F.struct(policy.alias("policy"), F.when(n % 8 != 0, hedge).alias("hedge")))

    pairs = o.select("o_orderkey", spec(k).alias("challenger"), spec(c).alias("champion"))
    return R.knob_changes(pairs, "o_orderkey", "challenger", "champion")


def slippage(spark, sf_dir):
    """Lines are fills, bars the market; auction quotes are JSON of the open and of prices expected 20, 5 and 1 minutes before it, some of them absent or broken."""
    p = written(panel(spark, sf_dir).select("session", "instrument_id", "open", "market", "adtv20"), "panel")
    fills = T.table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("instrument_id"), "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").cast("long").alias("quantity"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("price"),
    )
    i, opened = F.col("instrument_id"), F.col("open")

    def quote(kind, offset, name, value, payload=None):
        text = F.to_json(F.struct(value.alias(name))) if payload is None else payload
        return F.struct(F.lit(kind).alias("kind"), F.lit(offset).alias("offset"), text.alias("payload"))

    printed = F.when(i % 5 == 0, F.lit("no json")).when(i % 7 == 0, F.to_json(F.struct((opened + 60).cast("string").alias("open")))).otherwise(F.to_json(F.struct(opened.alias("open"))))
    quotes = [quote("open", 0, "", opened, printed), *(quote("expected", o, "expected", F.when((i + o) % 4 != 0, opened + o)) for o in (-20, -5, -1))]
    auction = p.select("session", "instrument_id", F.explode(F.array(*quotes)).alias("quote")).select("session", "instrument_id", "quote.*")
    market = p.withColumn("open", F.when(i % 13 != 0, opened))
    tick = P.tick_for(F.col("open"), F.col("session"), REGIMES)
    got = R.slippage_table(fills, auction, market, [-20, -5, -1], tick)
    cut = [F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("model_minus_open_ticks", "notional_over_adtv20", *(f"expected_minus_open_ticks_m{o}" for o in (20, 5, 1)))]
    names = ("model_minus_open_ticks", "notional_over_adtv20", "m20", "m5", "m1")
    return got.select("l_orderkey", "l_linenumber", "official_open", "captured_open", "tick", "open_mismatch", *(c.alias(n) for c, n in zip(cut, names, strict=True)))


QUERIES = {f.__name__: f for f in (annual_releases, release_pairs, earnings_surprises, report_cards, challenges, knob_changes, slippage)}


def _c(x: str, name: str, scale: str = "1e4") -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN floor(({x}) * {scale} + 0.5000001) / {scale} END AS {name}"


def _less(value: str, back: int) -> str:
    parts = [f"p{back + j}" for j in range(3)]
    due = " AND ".join(f"{p}.avail_pos <= r.avail_pos" for p in parts)
    total = " + ".join(f"{p}.value" for p in reversed(parts))
    return f"CASE WHEN annual THEN CASE WHEN {due} THEN {value} - ({total}) END ELSE {value} END"


# Annual values less three facts, each joined on its own.
QUARTERS = f"""r0 AS (SELECT company_id, quarter, fact AS metric, basis, quarter % 4 = 3 AS annual, avail_pos, version,
  CASE WHEN version % 6 <> 0 THEN value * CASE WHEN quarter % 4 = 3 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END END AS v, CASE WHEN version % 10 <> 0 THEN value * CASE WHEN quarter % 4 = 3 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END / 2 END AS w
  FROM kn WHERE version % 2 = 0 AND fact IN ('op', 'ni', 'sales')),
r1 AS (SELECT * FROM r0 QUALIFY basis = 'consolidated' OR NOT bool_or(basis = 'consolidated') OVER (PARTITION BY company_id, quarter)),
rq AS (SELECT r.company_id, r.quarter, r.metric, r.avail_pos, r.version, {_less("v", 1)} AS value, {_less("w", 5)} AS prior_value FROM r1 r
  {" ".join(f"LEFT JOIN qf p{b} ON p{b}.company_id = r.company_id AND p{b}.fact = r.metric AND p{b}.quarter = r.quarter - {b}" for b in (1, 2, 3, 5, 6, 7))})"""
_PAIRS = ", ".join(f"arg_max(struct_pack(v := value, w := prior_value), (avail_pos, version)) FILTER (metric = '{m}') AS s_{m}" for m in METRICS)
PAIRS = f"""{QUARTERS}, ev AS (SELECT DISTINCT company_id, avail_pos AS pos FROM rq),
bq AS (SELECT ev.company_id, ev.pos, max(rq.quarter) AS quarter FROM ev JOIN rq ON rq.company_id = ev.company_id AND rq.avail_pos <= ev.pos GROUP BY ALL),
rs AS (SELECT bq.company_id, bq.pos, bq.quarter, min(avail_pos) AS known_pos, {_PAIRS} FROM bq JOIN rq ON rq.company_id = bq.company_id AND rq.quarter = bq.quarter AND rq.avail_pos <= bq.pos GROUP BY ALL),
rp AS (SELECT company_id, pos, quarter, known_pos, {", ".join(f"s_{m}.v AS {m}, s_{m}.w AS {m}_ly" for m in METRICS)} FROM rs)"""
_PICK = ", ".join(f"CASE WHEN use THEN f_{c} ELSE r_{c} END AS {c}" for m in METRICS for c in (m, f"{m}_ly"))
_SIDES = ", ".join(f"f.{c} AS f_{c}, r.{c} AS r_{c}" for m in METRICS for c in (m, f"{m}_ly"))


def _leaf(path: str, was: str, now: str) -> str:
    return f"SELECT o_orderkey, '{path}' AS path, CAST({was} AS DOUBLE) AS was, CAST({now} AS DOUBLE) AS now FROM o"


_LEAVES = " UNION ALL ".join(
    _leaf(path, *(x.replace("_", side) for side in ("c", "k")))
    for path, x in (("policy.n", "_ % 5"), ("policy.keep", "_ % 3 / 2"), ("policy.extra", "CASE WHEN _ % 4 = 0 THEN 1 END"), ("hedge.future.ratio", "CASE WHEN _ % 8 <> 0 THEN _ % 6 END"))
)
_GIVEN = EVALUATION_SQL["bootstrap_given_starts"]

SQL = {
    "annual_releases": f"WITH {STEPS}, {QUARTERS} SELECT company_id, quarter, metric, avail_pos, version, {_c('value', 'value', '1e2')}, {_c('prior_value', 'prior_value', '1e2')} FROM rq",
    "release_pairs": f"WITH {STEPS}, {PAIRS} SELECT company_id, pos, quarter, known_pos, {', '.join(_c(c, c, '1e2') for m in METRICS for c in (m, f'{m}_ly'))} FROM rp",
    "earnings_surprises": f"""WITH {STEPS}, {PAIRS}, ce AS (SELECT company_id, pos, session FROM (SELECT DISTINCT company_id FROM qf), cal0),
f AS (SELECT ce.company_id, ce.pos, st.* EXCLUDE (company_id, pos) FROM ce ASOF JOIN st ON ce.company_id = st.company_id AND ce.pos >= st.pos),
r AS (SELECT ce.company_id, ce.pos, rp.* EXCLUDE (company_id, pos) FROM ce ASOF JOIN rp ON ce.company_id = rp.company_id AND ce.pos >= rp.pos),
j AS (SELECT ce.*, f.quarter AS fq, r.quarter AS rq, f.quarter IS NOT NULL AND (r.quarter IS NULL OR f.quarter >= r.quarter) AS use, {_SIDES}
  FROM ce LEFT JOIN f USING (company_id, pos) LEFT JOIN r USING (company_id, pos) WHERE f.quarter IS NOT NULL OR r.quarter IS NOT NULL),
b AS (SELECT company_id, pos, session, CASE WHEN use THEN fq ELSE rq END AS quarter, CASE WHEN use THEN 'filing' ELSE 'release' END AS origin, {_PICK} FROM j),
x AS (SELECT *, year(session) * 4 + quarter(session) - 1 - quarter <= 2 AS fresh FROM b)
SELECT company_id, pos, quarter, origin, {_c("CASE WHEN fresh THEN (op - op_ly) / ((company_id + 1) * 1000000.0::DOUBLE) END", "sue_op_e")},
  {_c("CASE WHEN fresh THEN (ni - ni_ly) / ((company_id + 1) * 1000000.0::DOUBLE) END", "sue_ni_e")}, {_c("CASE WHEN fresh THEN (sales - sales_ly) / nullif(abs(sales_ly), 0) END", "sue_sales_e")} FROM x""",
    "report_cards": f"""WITH pr AS (SELECT instrument_id // 2 AS run, CASE WHEN instrument_id % 2 = 0 THEN 'slippage' ELSE 'delay' END AS stream, g_low, p_deep, p_loss FROM ({_GIVEN})),
n AS (WITH {S} SELECT instrument_id // 2 AS run, CASE WHEN instrument_id % 2 = 0 THEN 'slippage' ELSE 'delay' END AS stream, least(count(*), 500) AS n FROM s GROUP BY ALL),
w AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY run ORDER BY g_low, stream DESC) = 1),
u AS (SELECT run, string_agg('integrity_' || stream, ',' ORDER BY stream) AS bad FROM n WHERE n < 500 GROUP BY run),
c AS (SELECT w.run, stream AS objective_stream, g_low AS objective, p_deep, p_loss, concat_ws(',', CASE WHEN w.run % 7 = 3 THEN 'perturbation_mismatches' END, CASE WHEN p_deep > 0.2 THEN 'p_deep' END,
  CASE WHEN p_loss > 0.5 THEN 'p_loss' END, bad) AS failed FROM w LEFT JOIN u ON u.run = w.run)
SELECT *, failed = '' AS passed FROM c""",
    "knob_changes": f"WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c FROM orders), l AS ({_LEAVES}) SELECT * FROM l WHERE was IS DISTINCT FROM now",
    "slippage": f"""WITH {PANEL}, m AS (SELECT session, instrument_id AS i, open AS o, CASE WHEN instrument_id % 13 <> 0 THEN open END AS official, adtv20 FROM panel),
t AS (SELECT *, CASE WHEN official IS NOT NULL THEN {_tick("official")} END AS tick, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 7 = 0 THEN o + 60 ELSE o END AS captured,
  {", ".join(f"CASE WHEN (i - {d}) % 4 <> 0 AND o - {d} > 0 THEN o - {d} END AS e{d}" for d in (20, 5, 1))} FROM m),
x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS s, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS q, t.*
  FROM lineitem JOIN t ON t.session = CAST(l_shipdate AS DATE) AND t.i = l_suppkey)
SELECT l_orderkey, l_linenumber, official AS official_open, captured AS captured_open, tick, coalesce(abs(captured - official) >= tick, false) AS open_mismatch,
  floor(s * (price - official) / tick * 1e6 + 0.5) / 1e6 AS model_minus_open_ticks, CASE WHEN official IS NOT NULL AND adtv20 > 0 THEN floor(q * price / adtv20 * 1e6 + 0.5) / 1e6 END AS notional_over_adtv20,
  {", ".join(f"floor(s * (e{d} - coalesce(captured, official)) / tick * 1e6 + 0.5) / 1e6 AS m{d}" for d in (20, 5, 1))} FROM x""",
}
DATES: dict[str, tuple[str, ...]] = {}
