"""Catalog and operations queries over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators import lineage as L
from tidemark.sources import tables as T


def _ranges(spark, sf_dir):
    day = F.to_date("ts")
    return T.table(spark, sf_dir, "events").select("user_id", day.alias("start"), F.expr("date_add(to_date(ts), cast(event_id % 3 as int))").alias("end"))


def _span(spark, sf_dir):
    return _ranges(spark, sf_dir).groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _last_day(spark, sf_dir):
    return F.lit(T.table(spark, sf_dir, "events").agg(F.to_date(F.max("ts"))).first()[0])


def latest_receipts(spark, sf_dir):
    return C.latest_by_key(T.receipts(spark, sf_dir), ["source", "natural_key"], "retrieved_at", "event_id")


def receipt_conflicts(spark, sf_dir):
    r = T.receipts(spark, sf_dir).withColumn("retrieved_at", F.date_trunc("day", "retrieved_at"))
    return C.receipt_conflicts(r, ["source", "natural_key"], "retrieved_at", "content_hash")


def upsert_blobs(spark, sf_dir):
    return C.upsert_blobs(T.receipts(spark, sf_dir).withColumn("usable", F.col("source") != "error"))


def successful_keys(spark, sf_dir):
    return latest_receipts(spark, sf_dir).where("status = 'success'").select("source", "natural_key")


def dangling_references(spark, sf_dir):
    r = T.receipts(spark, sf_dir)
    have = r.where("source <> 'error'").select("content_hash").distinct()
    return r.where("status = 'success'").join(have, "content_hash", "left_anti").groupBy("source").agg(F.count("*").alias("dangling"))


def merge_intervals(spark, sf_dir):
    return C.merge_intervals(_ranges(spark, sf_dir), "user_id")


def pending_cells(spark, sf_dir):
    cells = _span(spark, sf_dir).select("user_id", F.explode(F.sequence("start", "end")).alias("day"))
    return C.pending_cells(cells, C.merge_intervals(_ranges(spark, sf_dir), "user_id"), "user_id", "day")


def calendar_span_groups(spark, sf_dir):
    b = T.observed(spark, sf_dir)
    return C.calendar_span_groups(b.select("instrument_id", "pos"), "instrument_id", 100)


def coverage_report(spark, sf_dir):
    r = latest_receipts(spark, sf_dir)
    required = r.select("source").distinct().join(r.select("natural_key").distinct(), F.lit(True))
    return C.coverage_report(required, r)


def quarter_windows(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return C.quarter_windows(o, "o_custkey")


def covered_through(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.last_day("o_orderdate").alias("window_end")).agg((F.min("o_orderstatus") == "F").alias("complete"))
    return C.covered_through(o, "o_orderpriority")


def required_periods(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.year(F.min("o_orderdate")) * 4).alias("start"))
    return C.required_periods(o, "o_custkey", "start", F.lit("2000-08-15").cast("date"))


def quota_usage(spark, sf_dir):
    return C.quota_usage(T.receipts(spark, sf_dir), 500)


def missing_this_week(spark, sf_dir):
    r = T.receipts(spark, sf_dir)
    return C.missing_this_week(r.select("natural_key").distinct(), r, _last_day(spark, sf_dir))


def retention_plan(spark, sf_dir):
    r = T.receipts(spark, sf_dir).select("natural_key", "event_id", "retrieved_at")
    return C.retention_plan(r, "natural_key", 3, 2).select("natural_key", "event_id", "keep")


def reachable_archives(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(97)).alias("archive"))
    bounds = spark.createDataFrame([(100,), (1000,), (5000,)], "boundary long")
    return C.reachable_archives(e, bounds, "path", "seq", "archive")


def dataset_digest(spark, sf_dir):
    return C.dataset_digest(T.receipts(spark, sf_dir), "source", "content_hash")


def lineage(spark, sf_dir):
    n = T.table(spark, sf_dir, "part").where("p_partkey > 0")
    edges = n.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent"))
    roots = T.table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("id"))
    return L.reachable(edges, roots)


def lineage_orphans(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(lineage(spark, sf_dir), "id", "left_anti")


def blob_dedupe(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    return C.blob_dedupe(d, "sha", "path")


def _outcomes(spark, sf_dir):
    return C.latest_outcomes(T.table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).alias("job"), F.col("event_type").alias("outcome"), "ts", "event_id"))


def latest_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def failure_streak(spark, sf_dir):
    return C.failure_streak(_outcomes(spark, sf_dir), ["view"], ["error", "click"])


def weekly_outcomes(spark, sf_dir):
    return C.weekly_outcomes(_outcomes(spark, sf_dir), _last_day(spark, sf_dir))


def alert_suppress(spark, sf_dir):
    return C.alert_suppress(T.table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 24)


def incident_diff(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    cut = e.agg(F.expr("percentile(event_id, 0.5)")).first()[0]
    return C.incident_diff(e.where(F.col("event_id") <= cut).where("value > 40"), e.where(F.col("event_id") > cut).where("value > 40"), ["user_id", "event_type"])


QUERIES = {f.__name__: f for f in (
    latest_receipts, receipt_conflicts, upsert_blobs, successful_keys, dangling_references, merge_intervals, pending_cells, calendar_span_groups,
    coverage_report, quarter_windows, covered_through, required_periods, quota_usage, missing_this_week, retention_plan, reachable_archives,
    dataset_digest, lineage, lineage_orphans, blob_dedupe, latest_outcomes, failure_streak, weekly_outcomes, alert_suppress, incident_diff,
)}

R = """r AS (
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS natural_key,
    CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 11 = 0 THEN 'provider_error' ELSE 'success' END AS status,
    json_extract_string(props, '$.k') AS content_hash, ts AS retrieved_at, event_id FROM events),
latest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, natural_key ORDER BY retrieved_at DESC, event_id DESC) = 1)"""
RANGES = "g AS (SELECT user_id, CAST(ts AS DATE) AS start, CAST(CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS DATE) AS \"end\" FROM events)"
MERGED = RANGES + """,
k AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM g),
i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM k),
merged AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY user_id, island)"""
OUTCOMES = """o AS (
  SELECT user_id % 40 AS job, CAST(ts AS DATE) AS day, arg_max(event_type, row(ts, event_id)) AS outcome, count(*) AS runs FROM events GROUP BY ALL)"""
LINEAGE = """e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
r(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 7 UNION ALL SELECT e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.id),
l AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"""

SQL = {
    "latest_receipts": f"WITH {R} SELECT * FROM latest",
    "receipt_conflicts": f"""WITH {R} SELECT source, natural_key, date_trunc('day', retrieved_at) AS retrieved_at, count(DISTINCT content_hash) AS payloads
FROM r GROUP BY ALL HAVING count(DISTINCT content_hash) > 1""",
    "upsert_blobs": f"""WITH {R} SELECT content_hash, bool_or(source <> 'error') AS usable,
  arg_max(retrieved_at, row(CAST(source <> 'error' AS INTEGER), retrieved_at, event_id)) AS retrieved_at, count(*) AS versions FROM r GROUP BY content_hash""",
    "successful_keys": f"WITH {R} SELECT source, natural_key FROM latest WHERE status = 'success'",
    "dangling_references": f"""WITH {R} SELECT source, count(*) AS dangling FROM r WHERE status = 'success' AND content_hash IS NOT NULL
  AND content_hash NOT IN (SELECT content_hash FROM r WHERE source <> 'error' AND content_hash IS NOT NULL) GROUP BY source""",
    "merge_intervals": f"WITH {MERGED} SELECT * FROM merged",
    "pending_cells": f"""WITH {MERGED}, c AS (SELECT user_id, CAST(unnest(generate_series(min(start), max("end"), INTERVAL 1 DAY)) AS DATE) AS day FROM g GROUP BY user_id)
SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.user_id = c.user_id AND c.day BETWEEN m.start AND m."end")""",
    "calendar_span_groups": """WITH RECURSIVE b AS (SELECT DISTINCT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session FROM lineitem),
cal AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT session FROM b)),
c AS (SELECT instrument_id, pos FROM b JOIN cal USING (session)),
h(instrument_id, first, n) AS (
  SELECT instrument_id, min(pos), CAST(0 AS BIGINT) FROM c GROUP BY instrument_id
  UNION ALL SELECT h.instrument_id, (SELECT min(pos) FROM c WHERE c.instrument_id = h.instrument_id AND c.pos >= h.first + 100), h.n + 1 FROM h
  WHERE EXISTS (SELECT 1 FROM c WHERE c.instrument_id = h.instrument_id AND c.pos >= h.first + 100))
SELECT c.instrument_id, c.pos, h.n AS span_group FROM c JOIN h ON h.instrument_id = c.instrument_id AND c.pos >= h.first AND c.pos < h.first + 100""",
    "coverage_report": f"""WITH {R}, q AS (SELECT * FROM (SELECT DISTINCT source FROM latest), (SELECT DISTINCT natural_key FROM latest))
SELECT source, CASE WHEN status IS NULL THEN 'missing' WHEN status IN ('success', 'empty') THEN 'fulfilled' ELSE 'unresolved' END AS state, count(*) AS n
FROM q LEFT JOIN latest USING (source, natural_key) GROUP BY ALL""",
    "quarter_windows": """WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY o_custkey),
w AS (SELECT o_custkey, s, e, CAST(unnest(generate_series(CAST(date_trunc('month', s) AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS month0 FROM s)
SELECT o_custkey, greatest(month0, s) AS window_start, least(CAST(month0 + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), e) AS window_end FROM w""",
    "covered_through": """WITH w AS (SELECT o_orderpriority, last_day(o_orderdate) AS window_end, min(o_orderstatus) = 'F' AS complete FROM orders GROUP BY ALL),
k AS (SELECT o_orderpriority, max(window_end) FILTER (complete) AS through FROM w GROUP BY ALL)
SELECT *, (SELECT CASE WHEN count(*) = count(through) THEN min(through) END FROM k) AS overall FROM k""",
    "required_periods": """WITH s AS (SELECT o_custkey, year(min(o_orderdate)) * 4 AS s FROM orders GROUP BY o_custkey),
q AS (SELECT o_custkey, CAST(unnest(range(s, 8004)) AS INTEGER) AS k FROM s)
SELECT o_custkey, k AS quarter_key FROM q WHERE CASE WHEN k % 4 = 3 THEN make_date(k // 4 + 1, 3, 30) ELSE make_date(k // 4, k % 4 * 3 + 5, 15) END < DATE '2000-08-15'""",
    "quota_usage": f"""WITH {R} SELECT source, CAST(retrieved_at + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS used, 500 - count(*) AS remaining FROM r GROUP BY ALL""",
    "missing_this_week": f"""WITH {R}, t AS (SELECT CAST(max(retrieved_at) AS DATE) AS today FROM r)
SELECT DISTINCT natural_key FROM r WHERE natural_key NOT IN (SELECT natural_key FROM r, t WHERE status IN ('success', 'empty')
  AND CAST(retrieved_at AS DATE) BETWEEN date_trunc('week', today) AND today)""",
    "retention_plan": f"""WITH {R}, v AS (
  SELECT natural_key, event_id, row_number() OVER (PARTITION BY natural_key, CAST(retrieved_at AS DATE) ORDER BY retrieved_at DESC, event_id DESC) AS od,
    row_number() OVER (PARTITION BY natural_key, date_trunc('month', retrieved_at) ORDER BY retrieved_at DESC, event_id DESC) AS om,
    dense_rank() OVER (PARTITION BY natural_key ORDER BY CAST(retrieved_at AS DATE) DESC) AS dr,
    dense_rank() OVER (PARTITION BY natural_key ORDER BY date_trunc('month', retrieved_at) DESC) AS mr FROM r)
SELECT natural_key, event_id, (od = 1 AND dr <= 3) OR (om = 1 AND mr <= 2) AS keep FROM v""",
    "reachable_archives": """WITH s AS (SELECT event_id % 97 AS archive, event_id AS seq, lead(event_id, 1, 4611686018427387904) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM events)
SELECT DISTINCT archive FROM s JOIN (VALUES (100), (1000), (5000)) b(x) ON x >= seq AND x < upto""",
    "dataset_digest": f"""WITH {R}, h AS (SELECT DISTINCT source, content_hash FROM r WHERE content_hash IS NOT NULL)
SELECT source, sha256(string_agg(content_hash, chr(10) ORDER BY content_hash)) AS digest, count(*) AS members FROM h GROUP BY source""",
    "lineage": f"WITH RECURSIVE {LINEAGE} SELECT * FROM l",
    "lineage_orphans": f"WITH RECURSIVE {LINEAGE} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM l)",
    "blob_dedupe": """WITH d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(text) AS sha FROM documents)
SELECT path, min(path) OVER w AS kept_path, path = min(path) OVER w AS is_kept, count(*) OVER w AS copies FROM d WINDOW w AS (PARTITION BY sha)""",
    "latest_outcomes": f"WITH {OUTCOMES} SELECT * FROM o",
    "failure_streak": f"""WITH {OUTCOMES}, d AS (SELECT job, day, outcome IN ('error', 'click') AS bad FROM o WHERE outcome <> 'view'),
e AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY day DESC) AS ended FROM d)
SELECT job, count(*) FILTER (ended = 0 AND bad) AS streak FROM e GROUP BY job""",
    "weekly_outcomes": f"""WITH {OUTCOMES}, a AS (SELECT job, outcome, date_diff('day', day, (SELECT CAST(max(ts) AS DATE) FROM events)) AS ago FROM o)
SELECT job, {", ".join(f"coalesce(max(outcome) FILTER (ago = {i}), 'none') AS d{i}" for i in range(7))} FROM a WHERE ago BETWEEN 0 AND 6 GROUP BY job""",
    "alert_suppress": """WITH RECURSIVE a AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
s AS (
  SELECT user_id, event_id, ts, n FROM a WHERE n = 1
  UNION ALL SELECT user_id, event_id, ts, n FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.user_id ORDER BY a.n) AS k FROM s JOIN a ON a.user_id = s.user_id AND a.n > s.n AND a.ts >= s.ts + INTERVAL 24 HOUR) WHERE k = 1)
SELECT user_id, event_id FROM s""",
    "incident_diff": """WITH c AS (SELECT quantile_cont(event_id, 0.5) AS cut FROM events),
a AS (SELECT DISTINCT user_id, event_type FROM events, c WHERE event_id <= cut AND value > 40), b AS (SELECT DISTINCT user_id, event_type FROM events, c WHERE event_id > cut AND value > 40)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
  CASE WHEN a.user_id IS NULL THEN 'opened' WHEN b.user_id IS NULL THEN 'resolved' ELSE 'open' END AS state
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
}

DATES = {
    "merge_intervals": ("start", '"end"'), "pending_cells": ("day",), "quarter_windows": ("window_start", "window_end"), "covered_through": ("through", "overall"),
    "quota_usage": ("day",), "latest_outcomes": ("day",),
}
INSTANTS = dict.fromkeys(("latest_receipts", "receipt_conflicts", "upsert_blobs"), ("retrieved_at",))
