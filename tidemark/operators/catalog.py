"""Evidence catalog: latest receipts, conflicts, coverage intervals, windows, retention and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], instant: str, tie: str) -> DataFrame:
    """The newest row of each key; ties go to the larger tie value."""
    names = rows.columns
    best = rows.groupBy(*keys).agg(F.max(F.struct(instant, tie, *[c for c in names if c not in (*keys, instant, tie)])).alias("last"))
    return best.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in names])


def receipt_conflicts(rows: DataFrame, keys: list[str], instant: str, payload: str) -> DataFrame:
    """Keys that have different payloads at one instant."""
    return rows.groupBy(*keys, instant).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def upsert_blobs(blobs: DataFrame) -> DataFrame:
    """One row per content hash: the newest, but a usable one is not replaced by an unusable one of the same or earlier time."""
    order = F.struct(F.col("usable").cast("int").alias("u"), "retrieved_at", "event_id")
    return blobs.groupBy("content_hash").agg(
        F.max("usable").alias("usable"), F.max_by("retrieved_at", order).alias("retrieved_at"), F.count("*").alias("versions")
    )


def merge_intervals(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans of a key merged where one starts no later than the earlier ones end."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(key, start, end).withColumn("fresh", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    island = marked.withColumn("island", F.sum("fresh").over(w))
    return island.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def pending_cells(cells: DataFrame, merged: DataFrame, key: str, day: str) -> DataFrame:
    """Cells outside every merged span of their key: spans become days, so the anti join is an equi join."""
    days = merged.select(key, F.explode(F.sequence("start", "end")).alias(day)).distinct()
    return cells.join(days, [key, day], "left_anti")


def calendar_span_groups(cells: DataFrame, key: str, span: int) -> DataFrame:
    """Greedy cover of each key's calendar positions by groups of positions below first + span.

    A key's distinct positions are at most a calendar, so they fit an array; a fold keeps the groups' first positions.
    """

    def onward(starts: Column, pos: Column) -> Column:
        last = F.get(starts, F.size(starts) - 1)
        return F.when(last.isNull() | (pos >= last + span), F.concat(starts, F.array(pos))).otherwise(starts)

    own = cells.groupBy(key).agg(F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias("places"))
    own = own.withColumn("starts", F.aggregate("places", F.array().cast("array<long>"), onward))
    grouped = F.transform("places", lambda p: F.struct(p.alias("pos"), (F.size(F.filter("starts", lambda s: s <= p)) - 1).cast("long").alias("span_group")))
    return own.select(key, F.explode(grouped).alias("g")).select(key, "g.pos", "g.span_group")


def coverage_report(required: DataFrame, latest: DataFrame) -> DataFrame:
    """Required keys by what became of them: missing, fulfilled or unresolved."""
    got = required.join(latest.select("source", "natural_key", "status"), ["source", "natural_key"], "left")
    state = F.when(F.col("status").isNull(), "missing").when(F.col("status").isin("success", "empty"), "fulfilled").otherwise("unresolved")
    return got.withColumn("state", state).groupBy("source", "state").agg(F.count("*").alias("n"))


def quarter_windows(spans: DataFrame, key: str) -> DataFrame:
    """Three-month windows from the first month of each span, clipped to it."""
    starts = F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("interval 3 month"))
    w = spans.select(key, "start", "end", F.explode(starts).alias("at"))
    return w.select(key, F.greatest("at", "start").alias("window_start"), F.least(F.date_sub(F.add_months("at", 3), 1), F.col("end")).alias("window_end"))


def covered_through(windows: DataFrame, key: str) -> DataFrame:
    """Newest complete window end of each key, and the least of these, NULL if a key has none."""
    own = windows.groupBy(key).agg(F.max(F.when(F.col("complete"), F.col("window_end"))).alias("through"))
    whole = own.agg(F.when(F.count("*") == F.count("through"), F.min("through")).alias("overall"))
    return own.join(F.broadcast(whole))


def required_periods(companies: DataFrame, key: str, start: str, today: Column) -> DataFrame:
    """Quarter keys (year * 4 + quarter - 1) from start on whose publication cutoff lies strictly before today.

    Cutoffs: 15 May, 15 August, 15 November, and 30 March of the next year.
    """
    q = companies.select(key, F.explode(F.sequence(F.col(start), F.year(today) * 4 + 3)).alias("quarter_key"))
    year, quarter = F.floor(F.col("quarter_key") / 4).cast("int"), F.pmod("quarter_key", F.lit(4))
    cutoff = F.when(quarter == 3, F.make_date(year + 1, F.lit(3), F.lit(30))).otherwise(F.make_date(year, (quarter * 3 + 5).cast("int"), F.lit(15)))
    return q.where(cutoff < today)


def quota_usage(attempts: DataFrame, limit: int) -> DataFrame:
    """Attempts and what is left of a limit, per provider and Korean day."""
    day = F.to_date(F.from_utc_timestamp(F.col("retrieved_at").cast("timestamp"), "Asia/Seoul"))
    used = attempts.groupBy("source", day.alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.lit(limit) - F.col("used"))


def missing_this_week(subjects: DataFrame, receipts: DataFrame, today: Column) -> DataFrame:
    """Subjects with no answered receipt from Monday of this ISO week to today."""
    day = F.to_date("retrieved_at")
    answered = receipts.where(F.col("status").isin("success", "empty") & (day >= F.to_date(F.date_trunc("week", today))) & (day <= today))
    return subjects.join(answered.select("natural_key").distinct(), "natural_key", "left_anti")


def retention_plan(versions: DataFrame, key: str, daily: int, monthly: int) -> DataFrame:
    """versions with keep: the newest, the last of each of the last `daily` days and of the last `monthly` months."""
    day, month = F.to_date("retrieved_at"), F.trunc("retrieved_at", "MM")
    v = versions.withColumn("day", day).withColumn("month", month)
    newest = F.desc("retrieved_at"), F.desc("event_id")
    v = v.withColumn("of_day", F.row_number().over(Window.partitionBy(key, "day").orderBy(*newest)))
    v = v.withColumn("of_month", F.row_number().over(Window.partitionBy(key, "month").orderBy(*newest)))
    v = v.withColumn("day_rank", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("day"))))
    v = v.withColumn("month_rank", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("month"))))
    keep = ((F.col("of_day") == 1) & (F.col("day_rank") <= daily)) | ((F.col("of_month") == 1) & (F.col("month_rank") <= monthly))
    return v.withColumn("keep", keep).drop("day", "month", "of_day", "of_month", "day_rank", "month_rank")


def reachable_archives(entries: DataFrame, boundaries: DataFrame, path: str, seq: str, archive: str) -> DataFrame:
    """Archives that hold the latest version of some path as of a boundary."""
    upto = F.coalesce(F.lead(seq).over(Window.partitionBy(path).orderBy(seq)), F.lit(2**62))
    # Boundaries come as one array, so a span meets them without a join by range.
    spans = entries.withColumn("upto", upto).join(boundaries.agg(F.array_sort(F.collect_set("boundary")).alias("bounds")))
    return spans.where(F.exists("bounds", lambda b: (b >= F.col(seq)) & (b < F.col("upto")))).select(archive).distinct()


def dataset_digest(hashes: DataFrame, group: str, value: str) -> DataFrame:
    """Order-free identity of the distinct hashes of a group."""
    return hashes.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(value)), "\n"), 256).alias("digest"), F.count_distinct(value).alias("members"))


def blob_dedupe(files: DataFrame, content: str, path: str) -> DataFrame:
    """Each file with the path that keeps its content: the first in order."""
    keeper = files.groupBy(content).agg(F.min(path).alias("kept_path"), F.count("*").alias("copies"))
    return files.join(keeper, content).select(path, "kept_path", (F.col(path) == F.col("kept_path")).alias("is_kept"), "copies")


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """Last outcome of each job and day."""
    day = F.to_date("ts")
    return outcomes.groupBy("job", day.alias("day")).agg(F.max_by("outcome", F.struct("ts", "event_id")).alias("outcome"), F.count("*").alias("runs"))


def failure_streak(outcomes: DataFrame, neutral: list[str], failed: list[str]) -> DataFrame:
    """Failed days that end with each job's newest day that is not neutral; 0 unless that day failed."""
    days = outcomes.where(~F.col("outcome").isin(neutral)).withColumn("bad", F.col("outcome").isin(failed))
    w = Window.partitionBy("job").orderBy(F.desc("day"))
    ended = F.sum((~F.col("bad")).cast("int")).over(w)
    return days.withColumn("ended", ended).groupBy("job").agg(F.sum(((F.col("ended") == 0) & F.col("bad")).cast("long")).alias("streak"))


def weekly_outcomes(outcomes: DataFrame, last_day: Column) -> DataFrame:
    """Outcome of each job on each of the seven days to last_day."""
    recent = outcomes.withColumn("ago", F.datediff(last_day, "day")).where("ago between 0 and 6")
    return recent.groupBy("job").pivot("ago", list(range(7))).agg(F.first("outcome")).select(
        "job", *[F.coalesce(F.col(str(i)), F.lit("none")).alias(f"d{i}") for i in range(7)]
    )


def alert_suppress(alerts: DataFrame, key: str, hours: int) -> DataFrame:
    """Alerts that are sent: a key's alert is dropped within hours of the last one sent, which a plain window cannot tell.

    An alert that comes hours after the one before it is sent whatever came earlier, so a key is cut there; a fold over each part
    keeps the last one sent. A part is a run of alerts without such a gap.
    """
    gap = F.make_interval(hours=F.lit(hours))
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    cut = F.coalesce(F.col("ts") >= F.lag("ts").over(w) + gap, F.lit(True)).cast("int")
    parts = alerts.select(key, "event_id", "ts").withColumn("cut", cut).withColumn("part", F.sum("cut").over(w))
    runs = parts.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("run"))

    def onward(state: Column, alert: Column) -> Column:
        due = state["last"].isNull() | (alert["ts"] >= state["last"] + gap)
        return F.when(due, F.struct(alert["ts"].alias("last"), F.concat(state["sent"], F.array(alert["event_id"])).alias("sent"))).otherwise(state)

    kinds = dict(alerts.dtypes)
    start = F.struct(F.lit(None).cast(kinds["ts"]).alias("last"), F.array().cast(f"array<{kinds['event_id']}>").alias("sent"))
    return runs.select(key, F.explode(F.aggregate("run", start, onward)["sent"]).alias("event_id"))


def incident_diff(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Incidents that opened, stayed or were resolved between two evaluations."""
    a, b = before.select(*keys).distinct().withColumn("was", F.lit(1)), now.select(*keys).distinct().withColumn("is_now", F.lit(1))
    state = F.when(F.col("was").isNull(), "opened").when(F.col("is_now").isNull(), "resolved").otherwise("open")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))
