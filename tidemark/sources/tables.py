"""The shared tables and what is derived from them: calendar, bars, flows, facts, receipts, return streams.

One row of `bars` is a supplier's trading day. Everything is derived by Spark from the given tables, so the work grows
with them. Timestamps become dates once, here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_dataset(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Requested columns of a dataset; absent ones are NULL strings."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    have = set(found.columns)
    return found.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def _flows() -> list[Column]:
    """Signed quantities of a day, one for each return flag."""
    q = F.col("l_quantity")
    return [F.sum(F.when(F.col("l_returnflag") == flag, q).otherwise(-q)).alias(name) for flag, name in (("A", "net"), ("R", "returned"), ("N", "taken"))]


def bars(spark: SparkSession, sf_dir: str, flows: bool = False) -> DataFrame:
    """(instrument_id, session, open, high, low, close, volume, value, base_price, change, market, market_cap, listed_shares), with
    flows also the day's signed quantities by return flag: net, returned, taken.

    A supplier's lines meet once, by the supplier alone: its days, the price before and what else is windowed by it need no further shuffle,
    and lines are narrower than partial sums, which hardly merge any.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("session"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("place"), "l_quantity", "l_extendedprice", "l_returnflag",
    ).repartition("instrument_id")
    day = li.groupBy("instrument_id", "session").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "place").alias("close"), F.sum("l_quantity").cast("long").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("value"), *(_flows() if flows else ()),
    )
    prev = F.lag("close").over(Window.partitionBy("instrument_id").orderBy("session"))
    day = day.withColumn("base_price", F.coalesce(prev, F.col("close"))).withColumn("change", F.col("close") - F.col("base_price"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    market = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("instrument_id"),
        F.when(F.col("n_regionkey") % 2 == 0, "MAIN").otherwise("GROWTH").alias("market"),
        (F.lit(1_000_000) + F.col("s_suppkey") * 1000).cast("long").alias("listed_shares"),
    )
    return day.join(market, "instrument_id").withColumn("market_cap", F.col("close") * F.col("listed_shares"))


def calendar(bars_: DataFrame) -> DataFrame:
    """(session, pos): distinct sessions in order, pos from 0. One row a day: the window that numbers them is small at any size."""
    days = bars_.select("session").distinct()
    return days.withColumn("pos", (F.row_number().over(Window.orderBy("session")) - 1).cast("long"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar from the dates alone: one column is read and no price is aggregated."""
    return calendar(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")))


def observed(spark: SparkSession, sf_dir: str, flows: bool = False) -> DataFrame:
    """bars with calendar positions. A row a day: the broadcast side does not grow with the instruments."""
    return bars(spark, sf_dir, flows).join(F.broadcast(sessions(spark, sf_dir)), "session")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, natural_key, status, content_hash, retrieved_at) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("natural_key"),
        F.when(F.col("event_id") % 7 == 0, "empty").when(F.col("event_id") % 11 == 0, "provider_error").otherwise("success").alias("status"),
        F.get_json_object("props", "$.k").alias("content_hash"), F.col("ts").alias("retrieved_at"), F.col("event_id"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_id, quarter, fact, value, available): orders of a customer summed by quarter and priority."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    got = o.groupBy(
        F.col("o_custkey").alias("company_id"), (F.year(day) * 4 + F.quarter(day) - 1).cast("long").alias("quarter"),
        F.col("o_orderpriority").alias("fact"),
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.max(day).alias("last_day"))
    return got.withColumn("available", F.expr("date_add(last_day, 30 + cast(company_id % 45 as int))")).drop("last_day")
