"""Traps: gaps against the dense grid, strict parsing, chains, spans, suppression."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import catalog, evaluation, features, panel, silver


def test_strict_parsing(spark):
    df = spark.createDataFrame([("1,234",), (" 12 ",), ("",), ("1.5",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(core.strict_int(F.col("x"))).collect()] == [1234, 12, None, None, None, None]
    days = spark.createDataFrame([("20200229",), ("2020-03-01",), ("20200230",), ("a",)], "x string")
    assert [r[0] for r in days.select(core.parse_day(F.col("x"))).collect()] == [date(2020, 2, 29), date(2020, 3, 1), None, None]


def test_kst_cutoff(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 14, 59),), (datetime(2020, 1, 1, 15, 0),)], "t timestamp")
    assert [r[0] for r in df.select(core.kst_date(F.col("t"))).collect()] == [date(2020, 1, 1), date(2020, 1, 2)]


def test_raise_on(spark):
    core.raise_on(spark.range(0), "none")
    with pytest.raises(core.PointInTimeError):
        core.raise_on(spark.range(1), "one")


def test_grid_windows_count_absent_sessions(spark):
    p = spark.createDataFrame([(1, 0, 10.0), (1, 2, 20.0), (1, 3, 30.0)], "instrument_id long, pos long, x double")
    cal = spark.createDataFrame([(i,) for i in range(4)], "pos long")
    got = features.densify(p, cal).withColumn("m", core.roll_sum(F.col("x"), 2)).withColumn("l", core.shifted(F.col("x"), 1)).orderBy("pos").collect()
    assert [r.m for r in got] == [10.0, 10.0, 20.0, 50.0]
    assert [r.l for r in got] == [None, 10.0, None, 20.0]


def test_tick_and_limits(spark):
    r = [panel.Regime(date(2000, 1, 1), ((100, 1), (None, 5)), {"A": 0.1}, 15, 100)]
    df = spark.createDataFrame([(99, date(2000, 1, 1)), (100, date(2000, 1, 2)), (99, date(1999, 1, 1))], "p long, d date")
    assert [x[0] for x in df.select(panel.tick_for(F.col("p"), F.col("d"), r)).collect()] == [1, 5, None]
    up, down = panel.limit_prices(F.lit(103).cast("long"), F.lit(5).cast("long"), F.lit(date(2001, 1, 1)), r)
    assert df.select(up, down).first() == (118, 88)
    assert df.select(panel.snap_down(F.lit(118).cast("long"), F.lit(5).cast("long")), panel.snap_up(F.lit(88).cast("long"), F.lit(1).cast("long"))).first() == (115, 88)


def test_merge_intervals_touching(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 8), ("a", 1, 2), ("b", 0, 0)], "k string, start int, end int")
    assert sorted(tuple(r) for r in catalog.merge_intervals(df, "k").collect()) == [("a", 1, 5), ("a", 7, 8), ("b", 0, 0)]


def test_alerts_since_last_sent(spark):
    t = [datetime(2020, 1, 1, 0), datetime(2020, 1, 1, 20), datetime(2020, 1, 2, 0), datetime(2020, 1, 2, 23)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "k long, event_id long, ts timestamp")
    assert sorted(r.event_id for r in catalog.alert_suppress(df, "k", 24).collect()) == [0, 2]


def test_flow_resolve_drops_conflicts(spark):
    df = spark.createDataFrame([("a", 1, "h2"), ("a", 1, "h1"), ("b", 1, "h1"), ("b", 2, "h2")], "k string, v int, h string")
    assert [tuple(r) for r in silver.flow_resolve(df, ["k"], ["v"], "h").collect()] == [("a", 1)]


def test_asof_targets_after_the_end(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 4, 20), (1, 9, 30)], "k long, pos long, target long")
    p = spark.createDataFrame([(0,), (3,), (5,)], "pos long")
    got = sorted((r.pos, r.target) for r in evaluation.asof_targets(d, p, "k").collect())
    assert got == [(0, 10), (3, 10), (5, 20)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, start int, end int")
    assert catalog.merge_intervals(e, "k").count() == 0
    s = spark.createDataFrame([], "k string, pos long, log_return double")
    assert evaluation.point_metrics(s, "k").count() == 0
