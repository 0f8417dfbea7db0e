"""Streaming queries over events, run to the end, and the SQL of their batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import tables as T
from tidemark.streaming import events as S


def _last(drained, keys):
    rest = [c for c in drained.columns if c not in keys and c != "batch"]
    return drained.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def stream_latest_receipts(spark, sf_dir):
    e = S.event_stream(spark, sf_dir).select("event_type", "user_id", "ts", "event_id", "value")
    return S.latest_receipts(e, ["event_type", "user_id"], "ts", "event_id").drop("ts")


def stream_auction_snapshots(spark, sf_dir):
    e = S.event_stream(spark, sf_dir).where("event_type <> 'error'")
    return _last(S.drain(S.auction_snapshots(e, "user_id", "1 hour", "40 days"), "update"), ["slot_start", "user_id"])


def stream_late_split(spark, sf_dir):
    e = S.late_split(S.event_stream(spark, sf_dir), F.date_trunc("day", "ts") + F.expr("interval 18 hours"), F.col("ts"))
    return S.drain(e.select("event_id", "event_type", "late")).groupBy("event_type", "late").agg(F.count("*").alias("n"))


def stream_alert_suppress(spark, sf_dir):
    return S.drain(S.alert_suppress(S.event_stream(spark, sf_dir).where("event_type = 'error'"), "user_id", 24)).drop("batch")


def stream_session_gaps(spark, sf_dir):
    """Hours of the events' first fortnight, and how many users had a first page in each; every purchase arrives twice, and no page of some hours comes."""
    e = S.event_stream(spark, sf_dir).where("hour(ts) % 5 <> 3").withColumn("session", F.date_trunc("hour", "ts"))
    twice = e.withColumn("copy", F.explode(F.when(F.col("event_type") == "purchase", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    days = T.table(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).distinct()
    hours = days.select(F.explode(F.sequence("day", F.col("day") + F.expr("interval 23 hours"), F.expr("interval 1 hour"))).alias("session"))
    return S.session_gaps(twice, ["session", "user_id"], "session", "40 days", hours)


QUERIES = {f.__name__: f for f in (stream_latest_receipts, stream_auction_snapshots, stream_late_split, stream_alert_suppress, stream_session_gaps)}

SQL = {
    "stream_latest_receipts": """SELECT event_type, user_id, max(event_id) FILTER (rn = 1) AS event_id, max(value) FILTER (rn = 1) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY ALL""",
    "stream_auction_snapshots": """SELECT date_trunc('hour', ts) AS slot_start, user_id, arg_max(value, row(ts, event_id)) AS value, count(*) AS quotes
FROM events WHERE event_type <> 'error' GROUP BY ALL""",
    "stream_late_split": """SELECT event_type, ts > date_trunc('day', ts) + INTERVAL 18 HOUR AS late, count(*) AS n FROM events GROUP BY ALL""",
    "stream_alert_suppress": """WITH RECURSIVE a AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
s AS (
  SELECT user_id, event_id, ts, n FROM a WHERE n = 1
  UNION ALL SELECT user_id, event_id, ts, n FROM (
    SELECT a.*, row_number() OVER (PARTITION BY a.user_id ORDER BY a.n) AS k FROM s JOIN a ON a.user_id = s.user_id AND a.n > s.n AND a.ts >= s.ts + INTERVAL 24 HOUR) WHERE k = 1)
SELECT user_id, event_id FROM s""",
    "stream_session_gaps": """WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), h AS (SELECT CAST(day AS TIMESTAMP) + to_hours(CAST(i AS INTEGER)) AS session FROM d, range(24) r(i)),
c AS (SELECT date_trunc('hour', ts) AS session, count(DISTINCT user_id) AS n FROM events WHERE hour(ts) % 5 <> 3 GROUP BY ALL)
SELECT session, coalesce(n, 0) AS arrived FROM h LEFT JOIN c USING (session)""",
}

DATES: dict[str, tuple[str, ...]] = {}
INSTANTS = {"stream_auction_snapshots": ("slot_start",), "stream_session_gaps": ("session",)}
