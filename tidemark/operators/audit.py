"""Plans, completeness and audits over catalogs and streams: what is missing, late, stale or changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_complete(windows: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """windows (declared) with stored rows and whether the two agree."""
    stored = rows.groupBy(key).agg(F.count("*").alias("stored"))
    return windows.join(stored, key, "left").withColumn("stored", F.coalesce("stored", F.lit(0))).withColumn("complete", F.col("stored") == F.col("declared"))


def subject_covered(ranges: DataFrame, windows: DataFrame, subject: str) -> DataFrame:
    """windows with the number of subjects that have one range over all of it, out of all subjects."""
    total = ranges.agg(F.count_distinct(subject).alias("subjects"))
    # Windows come as one array: a range tells which it holds without a join by range.
    asked = windows.agg(F.collect_set(F.struct("window_start", "window_end")).alias("windows"))
    held = F.filter("windows", lambda w: (F.col("start") <= w["window_start"]) & (F.col("end") >= w["window_end"]))
    inside = ranges.join(asked).select(subject, F.explode(held).alias("w")).groupBy("w.window_start", "w.window_end").agg(F.count_distinct(subject).alias("covered"))
    got = windows.select("window_start", "window_end").distinct().join(inside, ["window_start", "window_end"], "left").join(total)
    return got.withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn("all_covered", F.col("covered") == F.col("subjects"))


def unanswered(required: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Keys without an answered receipt."""
    return required.join(receipts.where(F.col("status").isin("success", "empty")).select(key).distinct(), key, "left_anti")


def final_sessions(calendar: DataFrame, now: Column, lookback: int) -> DataFrame:
    """The newest sessions whose day has passed."""
    past = calendar.where(F.col("session") < now)
    return past.withColumn("age", F.row_number().over(Window.orderBy(F.desc("session")))).where(F.col("age") <= lookback)


def batch_plan(filings: DataFrame, done: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Latest filing of each key that is not done, one page of them by position."""
    latest = filings.groupBy(*keys).agg(F.max(F.struct("published", "filing")).alias("last")).select(*keys, "last.*")
    todo = latest.join(done, keys, "left_anti")
    return todo.orderBy(*keys).offset(offset).limit(limit)


def segment_of(days: DataFrame, segments: DataFrame) -> DataFrame:
    """Label of the segment [from_day, to_day) that holds a day."""
    return days.join(F.broadcast(segments), (F.col("day") >= F.col("from_day")) & (F.col("day") < F.col("to_day")), "left").select("day", "segment")


def implausible_balance(rows: DataFrame) -> DataFrame:
    """rows with the labels of what makes a balance implausible."""
    labels = F.array(
        F.when(F.col("assets") <= 0, "non_positive_assets"), F.when((F.col("assets") > 0) & (F.col("assets") < 1000), "tiny_assets"),
        F.when(F.col("equity") > F.col("assets") * 1.0001, "equity_exceeds_assets"),
    )
    return rows.withColumn("labels", F.array_join(F.array_compact(labels), ","))


def pay_date(rows: DataFrame) -> DataFrame:
    """Estimated payment date: a month after the meeting, or four after a year-end record date, or one after an interim's."""
    return rows.withColumn(
        "pay_date",
        F.when(F.col("meeting").isNotNull(), F.add_months("meeting", 1)).when(F.col("kind") == "year_end", F.add_months("record", 4))
        .when(F.col("kind") == "interim", F.add_months(F.greatest("received", "record"), 1)),
    )


def fallback_ready(reports: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """Whether the newest n counted sessions all pass and no session between them is unreported."""
    newest = reports.where("verdict <> 'no_data'").withColumn("age", F.row_number().over(Window.orderBy(F.desc("session")))).where(F.col("age") <= n)
    span = newest.agg(F.count("*").alias("counted"), F.sum((F.col("verdict") == "pass").cast("int")).alias("passed"), F.min("session").alias("a"), F.max("session").alias("b"))
    unreported = calendar.join(reports.select("session"), "session", "left_anti")
    gap = span.join(unreported, (F.col("session") > F.col("a")) & (F.col("session") < F.col("b")), "left").groupBy("counted", "passed", "a", "b").agg(F.count("session").alias("unreported"))
    return gap.withColumn("ready", (F.col("counted") == n) & (F.col("passed") == n) & (F.col("unreported") == 0))


def missing_or_degraded(expected: DataFrame, outcomes: DataFrame, bad: list[str]) -> DataFrame:
    """Expected jobs and days without an outcome, or with a bad one."""
    j = expected.join(outcomes, ["job", "day"], "left")
    return j.where(F.col("outcome").isNull() | F.col("outcome").isin(bad)).select("job", "day", F.coalesce("outcome", F.lit("missing")).alias("outcome"))


def freshness_age(outcomes: DataFrame, now: Column, ok: list[str], hours: int) -> DataFrame:
    """Per job the hours since its last success and whether it is stale."""
    last = outcomes.groupBy("job").agg(F.max(F.when(F.col("outcome").isin(ok), F.col("ts"))).alias("last"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600)
    return last.select("job", age.alias("age_hours"), (F.col("last").isNull() | (age > hours)).alias("stale"))


def universe_mask(panel: DataFrame, least_adtv: float, least_price: float) -> DataFrame:
    return panel.where((F.col("volume") > 0) & (F.col("adtv20") >= least_adtv) & (F.col("close") >= least_price))


def purged_training(rows: DataFrame, test_from: int, horizon: int, purge: int) -> DataFrame:
    """Rows whose label ends, with a purge, before the test positions begin."""
    return rows.where((F.col("pos") + horizon + purge < test_from) & F.col("target").isNotNull())


def decision_rows(positions: DataFrame, first: int, every: int, phase: int) -> DataFrame:
    return positions.where((F.col("pos") >= first - 1 + phase) & (F.pmod(F.col("pos") - (first - 1 + phase), F.lit(every)) == 0))


def breakeven(grid: DataFrame, key: str) -> DataFrame:
    """Cost at which a value first turns negative on a grid, by linear interpolation; 0 or NULL where it starts or stays there."""
    w = Window.partitionBy(key).orderBy("cost")
    g = grid.withColumn("next_cost", F.lead("cost").over(w)).withColumn("next_value", F.lead("value").over(w)).withColumn("n", F.row_number().over(w))
    cross = F.when((F.col("value") > 0) & (F.col("next_value") <= 0), F.col("cost") + (F.col("next_cost") - F.col("cost")) * F.col("value") / (F.col("value") - F.col("next_value")))
    return g.groupBy(key).agg(F.when(F.max(F.when(F.col("n") == 1, F.col("value"))) <= 0, F.lit(0.0)).otherwise(F.min(cross)).alias("breakeven"))


def expiry_sessions(calendar: DataFrame) -> DataFrame:
    """Last session on or before the second Thursday of March, June, September and December."""
    months = calendar.select(F.trunc("session", "MM").alias("m")).distinct().where(F.month("m").isin(3, 6, 9, 12))
    day = F.date_add(F.next_day(F.date_sub("m", 1), "Thursday"), 7)
    due = months.select(day.alias("due"), F.trunc(day, "MM").alias("m"))
    near = calendar.withColumn("m", F.trunc("session", "MM")).join(F.broadcast(due), "m").where("session <= due")
    return near.groupBy("due").agg(F.max("session").alias("session"))


def equal_weight_return(panel: DataFrame) -> DataFrame:
    """log1p of the mean close ratio of consecutive sessions, over instruments present in both."""
    before = panel.select("instrument_id", (F.col("pos") + 1).alias("pos"), F.col("close").alias("before"))
    return panel.join(before, ["instrument_id", "pos"]).groupBy("pos").agg(F.log1p(F.avg(F.col("close") / F.col("before") - 1)).alias("log_return"), F.count("*").alias("members"))


def stream_alignment(streams: DataFrame, key: str) -> DataFrame:
    """Digest of each stream's positions: aligned streams have one."""
    return streams.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("pos")), ","), 256).alias("digest"), F.count("*").alias("n"))


def action_kind(title: Column) -> Column:
    """Kind of a notice by the first vocabulary that its title holds."""
    t = F.regexp_replace(F.lower(title), r"\s+", " ")
    out = F.lit("other")
    for word, kind in reversed((("withdraw", "withdrawal"), ("delist", "delisting"), ("liquid", "liquidation"), ("halt", "halt"), ("licen", "licence"), ("with", "designation"))):
        out = F.when(t.contains(word), kind).otherwise(out)
    return out
