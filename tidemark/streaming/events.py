"""Streams of receipts, auction quotes and alerts.

Every operator takes a streaming DataFrame. `drain` runs one to the end of its source and gives its result as a table: a
batch of results has a folder of its own, written over when the batch is run again, so a retry leaves no row twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.scratch import scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(batch, columns of stream, or of what `each` makes of a batch) of all batches until the source is read."""
    spark = stream.sparkSession
    folder = f"{scratch(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _newest(rows: DataFrame, keys: list[str], instant: str, tie: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, instant, tie)]
    return rows.groupBy(*keys).agg(F.max(F.struct(instant, tie, *rest)).alias("last")).select(*keys, "last.*")


def latest_receipts(stream: DataFrame, keys: list[str], instant: str, tie: str) -> DataFrame:
    """Newest row of each key. A batch is cut to its newest rows and written, and the answer is the newest of those: no state is held
    between batches, so nothing grows with the keys but the table."""
    return _newest(drain(stream, each=lambda batch: _newest(batch, keys, instant, tie)).drop("batch"), keys, instant, tie)


def session_gaps(stream: DataFrame, keys: list[str], session: str, delay: str, calendar: DataFrame) -> DataFrame:
    """(session, arrived) of the calendar: how many pages of each session came, by their first arrivals; 0 is a gap.

    A page is known by its keys. State keeps them for the watermark's delay; what comes again later than that is told by the
    batch's anti join with the calendar of what is there, since a batch is written as distinct keys.
    """
    first = first_arrivals(stream, keys, delay).select(*dict.fromkeys([*keys, session]))
    came = drain(first, each=lambda batch: batch.distinct()).drop("batch").distinct()
    counts = came.groupBy(session).agg(F.count("*").alias("arrived"))
    return calendar.select(session).distinct().join(counts, session, "left").select(session, F.coalesce("arrived", F.lit(0)).alias("arrived"))


def pending_after_each(stream: DataFrame, keys: list[str], session: str, delay: str, calendar: DataFrame) -> DataFrame:
    """(batch, session): after each micro-batch, the calendar's sessions that no page has come for, in it or before.

    The anti join runs in the batch, against the distinct sessions that it and earlier batches have written.
    """
    spark = stream.sparkSession
    folder = f"{scratch(spark)}/streams/{uuid.uuid4().hex}"

    def gaps(batch: DataFrame, number: int) -> None:
        batch.select(session).distinct().write.mode("overwrite").parquet(f"{folder}/seen/part={number}")
        seen = spark.read.schema(batch.select(session).schema).parquet(*[f"{folder}/seen/part={i}" for i in range(number + 1)])
        calendar.select(session).distinct().join(seen, session, "left_anti").write.mode("overwrite").parquet(f"{folder}/gaps/batch={number}")

    query = first_arrivals(stream, keys, delay).writeStream.foreachBatch(gaps).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/gaps")


def auction_snapshots(stream: DataFrame, key: str, slot: str, delay: str) -> DataFrame:
    """Last quote of each key and time slot; quotes later than the watermark's delay are left out."""
    w = F.window("ts", slot)
    return stream.withWatermark("ts", delay).groupBy(w.alias("slot"), key).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("quotes")).select(
        F.col("slot.start").alias("slot_start"), key, "value", "quotes"
    )


def late_split(stream: DataFrame, due: Column, seen: Column) -> DataFrame:
    """stream with `late`: whether a row was seen after it was due."""
    return stream.withColumn("late", seen > due)


def first_arrivals(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row of each key; state is kept for the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def alert_suppress(stream: DataFrame, key: str, hours: int) -> DataFrame:
    """(key, event_id) of alerts that are sent: none within hours of the last one sent for the key."""
    gap = pd.Timedelta(hours=hours)

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        sent = []
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            if last is None or r.ts - last >= gap:
                last = r.ts
                sent.append((group[0], r.event_id))
        if last is not None:
            state.update((last.value // 1000 * 1000,))
        yield pd.DataFrame(sent, columns=[key, "event_id"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)
