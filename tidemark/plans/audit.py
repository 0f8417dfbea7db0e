"""Audit queries over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.plans.evaluation import S, streams
from tidemark.plans.panel import BARS, PANEL, STATES, panel, states
from tidemark.sources import tables as T


def _day(s: str):
    return F.lit(s).cast("date")


def _orders(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


def window_complete(spark, sf_dir):
    w = _orders(spark, sf_dir).groupBy("o_custkey").agg((F.count("*") + F.max((F.col("o_orderkey") % 50 == 0).cast("long"))).alias("declared"))
    return A.window_complete(w, _orders(spark, sf_dir), "o_custkey")


def subject_covered(spark, sf_dir):
    r = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    w = spark.createDataFrame([("1996-01-01", "1996-06-30"), ("1998-01-01", "1998-12-31")], "a string, b string")
    return A.subject_covered(r, w.select(F.to_date("a").alias("window_start"), F.to_date("b").alias("window_end")), "o_custkey")


def unanswered(spark, sf_dir):
    r = T.receipts(spark, sf_dir).where("source = 'click'")
    return A.unanswered(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("natural_key")), r, "natural_key")


def final_sessions(spark, sf_dir):
    return A.final_sessions(T.sessions(spark, sf_dir), _day("2000-01-01"), 20).select("session", F.col("age").cast("long").alias("age"))


def batch_plan(spark, sf_dir):
    f = _orders(spark, sf_dir).select("o_custkey", F.year("day").alias("y"), F.col("day").alias("published"), F.col("o_orderkey").alias("filing"))
    done = f.where("filing % 3 = 0").select("o_custkey", "y").distinct()
    return A.batch_plan(f, done, ["o_custkey", "y"], 100, 200).select("o_custkey", "y", "published", "filing")


def segment_of(spark, sf_dir):
    seg = spark.createDataFrame([("1995-01-01", "1998-01-01", "development"), ("1998-01-01", "2000-01-01", "validation"), ("2000-01-01", "2100-01-01", "holdout")], "a string, b string, segment string")
    seg = seg.select(F.to_date("a").alias("from_day"), F.to_date("b").alias("to_day"), "segment")
    return A.segment_of(_orders(spark, sf_dir).select("day"), seg).groupBy("segment").agg(F.count("*").alias("n"))


def implausible_balance(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("assets"), F.lit(4000.0).alias("equity"))
    return A.implausible_balance(c).select("c_custkey", "labels")


def pay_dates(spark, sf_dir):
    o = _orders(spark, sf_dir).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.date_add("day", 40)).alias("meeting"), F.when(F.col("o_orderstatus") == "F", "year_end").when(F.col("o_orderstatus") == "O", "interim").alias("kind"),
        F.col("day").alias("record"), F.date_add("day", -10).alias("received"),
    )
    return A.pay_date(o).select("o_orderkey", "pay_date")


def fallback_ready(spark, sf_dir):
    s = states(spark, sf_dir)
    r = s.where("pos % 7 <> 3").groupBy("session").agg(F.when(F.max("close") > 300, "pass").otherwise("fail").alias("verdict"))
    return A.fallback_ready(r, T.sessions(spark, sf_dir), 30).select("counted", "passed", "unreported", "ready")


def missing_or_degraded(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).alias("job"), F.to_date("ts").alias("day"), "event_type", "ts", "event_id")
    out = e.groupBy("job", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"))
    days = e.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("job"))
    return A.missing_or_degraded(days, out, ["error"])


def freshness_age(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).alias("job"), F.col("event_type").alias("outcome"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit("2024-02-15 00:00:00").cast("timestamp")
    return A.freshness_age(e.where(F.col("ts") < now), now, ["purchase"], 26)


def universe_mask(spark, sf_dir):
    return A.universe_mask(panel(spark, sf_dir), 60_000.0, 500).select("instrument_id", "session")


def purged_training(spark, sf_dir):
    s = streams(spark, sf_dir).withColumn("target", F.when(F.col("pos") % 3 != 0, F.col("log_return")))
    return A.purged_training(s, 1500, 21, 5).groupBy("instrument_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def decision_rows(spark, sf_dir):
    return A.decision_rows(T.sessions(spark, sf_dir), 10, 5, 2)


def breakeven(spark, sf_dir):
    g = T.table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("cost"), "p_retailprice").groupBy("p_brand", "cost").agg(F.avg("p_retailprice").alias("m"))
    b = A.breakeven(g.select("p_brand", F.col("cost").cast("double").alias("cost"), (950 - F.col("m")).alias("value")), "p_brand")
    return b.select("p_brand", (F.floor(F.col("breakeven") * 1e4 + 0.5000001) / 1e4).alias("breakeven"))


def expiry_sessions(spark, sf_dir):
    return A.expiry_sessions(T.sessions(spark, sf_dir))


def equal_weight_return(spark, sf_dir):
    return A.equal_weight_return(T.observed(spark, sf_dir)).select("pos", "members", (F.floor(F.col("log_return") * 1e6 + 0.5000001) / 1e6).alias("log_return"))


def stream_alignment(spark, sf_dir):
    return A.stream_alignment(streams(spark, sf_dir).withColumn("run", F.col("instrument_id") % 10), "run")


def action_kinds(spark, sf_dir):
    """Documents of each kind, by whole texts."""
    return T.table(spark, sf_dir, "documents").select(A.action_kind(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def flow_targets(spark, sf_dir):
    return states(spark, sf_dir).where("price_state = 'tradable'").select("instrument_id", "session").distinct().groupBy("session").agg(F.count("*").alias("targets"))


def normalized_facts(spark, sf_dir):
    """First row of each company, quarter and fact in input order."""
    o = _orders(spark, sf_dir)
    keys = [F.col("o_custkey"), (F.year("day") * 4 + F.quarter("day") - 1).alias("quarter"), F.col("o_orderpriority")]
    return o.groupBy(*keys).agg(F.min_by("o_totalprice", "o_orderkey").alias("value"), F.min("o_orderkey").alias("first_key"))


def notice_fields(spark, sf_dir):
    """Title and number of links of a page, by patterns over the whole body."""
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


QUERIES = {f.__name__: f for f in (
    window_complete, subject_covered, unanswered, final_sessions, batch_plan, segment_of, implausible_balance, pay_dates, fallback_ready, missing_or_degraded,
    freshness_age, universe_mask, purged_training, decision_rows, breakeven, expiry_sessions, equal_weight_return, stream_alignment, action_kinds, flow_targets,
    normalized_facts, notice_fields,
)}

SQL = {
    "window_complete": """SELECT o_custkey, count(*) + max(CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS declared, count(*) AS stored,
  max(CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) = 0 AS complete FROM orders GROUP BY o_custkey""",
    "subject_covered": """WITH r AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY o_custkey),
w(window_start, window_end) AS (VALUES (DATE '1996-01-01', DATE '1996-06-30'), (DATE '1998-01-01', DATE '1998-12-31'))
SELECT window_start, window_end, count(DISTINCT o_custkey) AS covered, (SELECT count(*) FROM r) AS subjects, count(DISTINCT o_custkey) = (SELECT count(*) FROM r) AS all_covered
FROM w LEFT JOIN r ON s <= window_start AND e >= window_end GROUP BY ALL""",
    "unanswered": """SELECT CAST(c_custkey AS VARCHAR) AS natural_key FROM customer WHERE c_custkey NOT IN (
  SELECT user_id FROM events WHERE event_type = 'click' AND (event_id % 7 = 0 OR event_id % 11 <> 0))""",
    "final_sessions": f"WITH {BARS}, a AS (SELECT session, row_number() OVER (ORDER BY session DESC) AS age FROM cal WHERE session < DATE '2000-01-01') SELECT * FROM a WHERE age <= 20",
    "batch_plan": """WITH f AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderdate AS DATE) AS published, o_orderkey AS filing FROM orders),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey, y ORDER BY published DESC, filing DESC) = 1),
t AS (SELECT *, row_number() OVER (ORDER BY o_custkey, y) AS place FROM l WHERE (o_custkey, y) NOT IN (SELECT (o_custkey, y) FROM f WHERE filing % 3 = 0))
SELECT o_custkey, y, published, filing FROM t WHERE place BETWEEN 101 AND 300""",
    "segment_of": """SELECT CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'development' WHEN o_orderdate < DATE '2000-01-01' THEN 'validation' ELSE 'holdout' END AS segment, count(*) AS n FROM orders GROUP BY ALL""",
    "implausible_balance": """SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal <= 0 THEN 'non_positive_assets' END, CASE WHEN c_acctbal > 0 AND c_acctbal < 1000 THEN 'tiny_assets' END,
  CASE WHEN 4000.0 > c_acctbal * 1.0001 THEN 'equity_exceeds_assets' END) AS labels FROM customer""",
    "pay_dates": """WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN d + 40 + INTERVAL 1 MONTH WHEN o_orderstatus = 'F' THEN d + INTERVAL 4 MONTH WHEN o_orderstatus = 'O' THEN d + INTERVAL 1 MONTH END AS DATE) AS pay_date FROM o""",
    "fallback_ready": f"""WITH {BARS}, r AS (SELECT session, CASE WHEN max(close) > 300 THEN 'pass' ELSE 'fail' END AS verdict FROM bars JOIN cal USING (session) WHERE pos % 7 <> 3 GROUP BY session),
n AS (SELECT * FROM r ORDER BY session DESC LIMIT 30),
g AS (SELECT count(*) AS counted, count(*) FILTER (verdict = 'pass') AS passed, min(session) AS a, max(session) AS b FROM n),
u AS (SELECT counted, passed, (SELECT count(*) FROM cal WHERE session > a AND session < b AND session NOT IN (SELECT session FROM r)) AS unreported FROM g)
SELECT *, counted = 30 AND passed = 30 AND unreported = 0 AS ready FROM u""",
    "missing_or_degraded": """WITH e AS (SELECT user_id % 40 AS job, CAST(ts AS DATE) AS day, arg_max(event_type, row(ts, event_id)) AS outcome FROM events GROUP BY ALL),
x AS (SELECT j.job, d.day FROM range(40) j(job), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d)
SELECT job, day, coalesce(outcome, 'missing') AS outcome FROM x LEFT JOIN e USING (job, day) WHERE outcome IS NULL OR outcome = 'error'""",
    "freshness_age": """WITH l AS (SELECT user_id % 40 AS job, max(ts) FILTER (event_type = 'purchase') AS last FROM events WHERE ts < TIMESTAMP '2024-02-15' GROUP BY ALL),
a AS (SELECT job, CAST(floor((epoch(TIMESTAMP '2024-02-15') - floor(epoch(last))) / 3600) AS BIGINT) AS age_hours, last FROM l)
SELECT job, age_hours, last IS NULL OR age_hours > 26 AS stale FROM a""",
    "universe_mask": f"WITH {PANEL} SELECT instrument_id, session FROM panel WHERE volume > 0 AND adtv20 >= 60000 AND close >= 500",
    "purged_training": f"WITH {S} SELECT instrument_id, count(*) AS n, max(pos) AS last FROM s WHERE pos + 26 < 1500 AND pos % 3 <> 0 GROUP BY instrument_id",
    "decision_rows": f"WITH {BARS} SELECT session, pos FROM cal WHERE pos >= 11 AND (pos - 11) % 5 = 0",
    "breakeven": """WITH g AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS cost, 950 - avg(p_retailprice) AS v FROM part GROUP BY ALL),
n AS (SELECT *, lead(cost) OVER w AS nc, lead(v) OVER w AS nv, row_number() OVER w AS k FROM g WINDOW w AS (PARTITION BY p_brand ORDER BY cost)),
b AS (SELECT p_brand, CASE WHEN max(CASE WHEN k = 1 THEN v END) <= 0 THEN 0.0 ELSE min(CASE WHEN v > 0 AND nv <= 0 THEN cost + (nc - cost) * v / (v - nv) END) END AS x FROM n GROUP BY p_brand)
SELECT p_brand, floor(x * 1e4 + 0.5000001) / 1e4 AS breakeven FROM b""",
    "expiry_sessions": f"""WITH {BARS}, m AS (SELECT DISTINCT CAST(date_trunc('month', session) AS DATE) AS m FROM cal WHERE month(session) IN (3, 6, 9, 12)),
d AS (SELECT m, CAST(m + CAST((4 - isodow(m) + 7) % 7 + 7 AS INTEGER) AS DATE) AS due FROM m)
SELECT due, max(session) AS session FROM cal JOIN d ON CAST(date_trunc('month', session) AS DATE) = m AND session <= due GROUP BY due""",
    "equal_weight_return": f"""WITH {BARS}, o AS (SELECT instrument_id, pos, close FROM bars JOIN cal USING (session)),
r AS (SELECT x.pos, count(*) AS members, ln(1 + avg(x.close / y.close - 1)) AS r FROM o x JOIN o y ON x.instrument_id = y.instrument_id AND x.pos = y.pos + 1 GROUP BY x.pos)
SELECT pos, members, floor(r * 1e6 + 0.5000001) / 1e6 AS log_return FROM r""",
    "stream_alignment": f"WITH {S} SELECT instrument_id % 10 AS run, sha256(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS digest, count(*) AS n FROM s GROUP BY ALL",
    "action_kinds": """WITH t AS (SELECT regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents)
SELECT CASE WHEN contains(t, 'withdraw') THEN 'withdrawal' WHEN contains(t, 'delist') THEN 'delisting' WHEN contains(t, 'liquid') THEN 'liquidation' WHEN contains(t, 'halt') THEN 'halt'
  WHEN contains(t, 'licen') THEN 'licence' WHEN contains(t, 'with') THEN 'designation' ELSE 'other' END AS kind, count(*) AS n FROM t GROUP BY ALL""",
    "flow_targets": f"WITH {STATES} SELECT session, count(*) AS targets FROM states WHERE price_state = 'tradable' GROUP BY session",
    "normalized_facts": """SELECT o_custkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter, o_orderpriority, arg_min(o_totalprice, o_orderkey) AS value, min(o_orderkey) AS first_key
FROM orders GROUP BY ALL""",
    "notice_fields": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""",
}

DATES = {
    "subject_covered": ("window_start", "window_end"), "final_sessions": ("session",), "batch_plan": ("published",), "pay_dates": ("pay_date",), "missing_or_degraded": ("day",),
    "universe_mask": ("session",), "decision_rows": ("session",), "expiry_sessions": ("due", "session"), "flow_targets": ("session",),
}
