"""Holdings that stay, contracts, dividends, alerts, contracts of receipts, and what reads and writes datasets, on made cases."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import audit, catalog, evaluation, fundamentals, orders, silver, sleeves
from tidemark.sources import datasets, tables


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def held(scores, n, multiple):
    keep, out, now = int(n * multiple), {}, []
    for pos in sorted(scores):
        ranked = sorted((-s, i) for i, s in scores[pos].items() if s is not None)
        ids = [i for _, i in ranked]
        if len(ids) < n:
            now = []
        else:
            stay = [i for i in ids[:keep] if i in now]
            now = (stay + [i for i in ids if i not in stay])[:n]
        out |= {(pos, r): i for r, i in enumerate(now, 1)}
    return out


@pytest.mark.parametrize(("n", "multiple"), [(3, 0.0), (3, 2.0), (4, 1.5)])
def test_select_held(spark, n, multiple):
    rng = random.Random(n)
    scores = {p: {i: rng.choice([None, *range(6)]) for i in range(rng.choice([9, 9, 9, 2]))} for p in range(25)}
    rows = [("s", p, i, None if x is None else float(x)) for p, own in scores.items() for i, x in own.items()] + [("t", 0, 1, 1.0)]
    got = evaluation.select_held(spark.createDataFrame(rows, "sleeve string, pos int, instrument_id int, score double"), n, multiple).collect()
    assert {(r.pos, r["rank"]): r.instrument_id for r in got if r.sleeve == "s"} == held(scores, n, multiple) and not [r for r in got if r.sleeve == "t"]


@pytest.mark.parametrize(("signal", "nav", "level", "want"), [(1.0, 5.0, 2.0, 1), (1.0, 6.0, 2.0, 1), (1.0, 6.1, 2.0, 2), (-1.0, 6.0, 2.0, -1), (-1.0, 6.1, 2.0, -2), (0.0, 9.0, 2.0, 0), (1.0, 9.0, 0.0, None), (1.0, 9.0, None, None)])
def test_contract_target(spark, signal, nav, level, want):
    df = spark.createDataFrame([(signal, nav, level)], "s double, n double, l double")
    assert df.select(orders.contract_target(F.lit(0.5), F.col("s"), F.lit(1.0), F.col("n"), F.lit(1), F.col("l"))).first()[0] == want


def test_impact(spark):
    df = spark.createDataFrame([(0.02, 400.0, 100.0), (0.02, 400.0, 0.0), (None, 1.0, 1.0)], "v double, n double, a double")
    assert [r[0] for r in df.select(orders.impact(0.1, F.col("v"), F.col("n"), F.col("a"))).collect()] == [pytest.approx(0.004), None, None]


def test_dividend_days_and_returns(spark):
    cal = spark.createDataFrame([(day(n), i) for i, n in enumerate((10, 11, 14, 20))], "session date, pos long")
    rows = [(1, day(14), day(16), day(9)), (2, day(13), day(50), day(10)), (3, day(10), day(9), day(19)), (4, day(5), None, day(20)), (5, day(60), day(10), day(99))]
    got = {r.k: (r.ex_session, r.pay_session, r.avail_session) for r in silver.dividend_days(spark.createDataFrame(rows, "k int, record_date date, pay_date date, received date"), cal).collect()}
    assert got == {1: (day(11), day(14), day(10)), 2: (day(10), day(20), day(11)), 3: (None, None, day(20)), 4: (None, None, None), 5: (day(14), day(10), None)}
    paid = spark.createDataFrame([(1, day(1), 10.0), (1, day(1), 5.0), (2, day(1), 5.0)], "instrument_id int, ex_session date, dps double")
    bars = spark.createDataFrame([(1, day(1), 100), (2, day(1), 0)], "instrument_id int, session date, base_price int")
    assert [(r.instrument_id, r.dividend_return) for r in fundamentals.dividend_return(paid, bars, 0.2).collect()] == [(1, pytest.approx(0.12))]


def test_dividend_resolve(spark):
    rows = [
        (1, 10, day(0), "cash", False), (1, 11, day(40), "cash", False), (1, 12, day(20), "cash", True), (1, 13, day(20), "stock", False), (1, 14, day(21), "stock", True), (1, 15, day(90), None, False), (1, 16, day(95), None, True),
        (1, 17, day(95), "cash", None), (2, 20, day(0), "cash", True), (2, 21, day(31), "cash", True),
    ]
    got = silver.dividend_resolve(spark.createDataFrame([(*r, 1.0) for r in rows], "company_id int, receipt int, record_date date, kind string, correction boolean, amount double"), 30)
    # 12 replaces 11, the latest within 30 days; 13 has its record date and replaces it; 14 corrects 13; 16 corrects 15 of no kind; 17 has 16's record date.
    assert {(r.company_id, r.receipt) for r in got.collect()} == {(1, 10), (1, 14), (1, 17), (2, 20), (2, 21)}
    assert silver.dividend_resolve(spark.createDataFrame([], "company_id int, receipt int, record_date date, kind string, correction boolean, amount double"), 30).count() == 0


def test_alerts_and_span_groups(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, datetime(2024, 1, 1) + timedelta(hours=rng.choice([0, 5, 23, 24, 25, 47, 48, 49, 200, *range(300)]))) for i in range(150)]
    want = set()
    for k in range(3):
        last = None
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is None or t - last >= timedelta(hours=24):
                last = t
                want.add((k, i))
    got = catalog.alert_suppress(spark.createDataFrame(rows, "k int, event_id int, ts timestamp"), "k", 24)
    assert {(r.k, r.event_id) for r in got.collect()} == want
    cells = [(rng.randrange(4), rng.randrange(120)) for _ in range(200)]
    groups = {}
    for k in range(4):
        first, g = None, -1
        for p in sorted({p for j, p in cells if j == k}):
            if first is None or p >= first + 10:
                first, g = p, g + 1
            groups[k, p] = g
    assert {(r.k, r.pos): r.span_group for r in catalog.calendar_span_groups(spark.createDataFrame(cells, "k int, pos int"), "k", 10).collect()} == groups


def test_windows_and_boundaries(spark):
    ranges = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 5, 25)], "s int, start int, end int")
    windows = spark.createDataFrame([(6, 9), (6, 22), (40, 50)], "window_start int, window_end int")
    assert {(r.window_start, r.window_end): (r.covered, r.all_covered) for r in audit.subject_covered(ranges, windows, "s").collect()} == {(6, 9): (2, True), (6, 22): (1, False), (40, 50): (0, False)}
    entries = spark.createDataFrame([("p", 1, "a"), ("p", 5, "b"), ("q", 3, "c")], "path string, seq long, archive string")
    at = lambda *b: sorted(r.archive for r in catalog.reachable_archives(entries, spark.createDataFrame([(x,) for x in b], "boundary long"), "path", "seq", "archive").collect())
    assert at(4) == ["a", "c"] and at(5) == ["b", "c"] and at(0) == [] and at(1, 9) == ["a", "b", "c"]


def test_contract_violations(spark):
    rows = [(1, '{"k": 1}', "a", '{"d": 1, "p": 2}'), (2, "x", "a", '{"d": 1}'), (3, '{"k": null, "z": 1}', " ", "[]"), (4, None, None, None)]
    got = sleeves.contract_violations(spark.createDataFrame(rows, "i int, payload string, natural_key string, query string"), "payload", ["k"], ["natural_key"], ("query", ["p", "d"]))
    assert {r.i: r.missing for r in got.collect()} == {2: "k,query:p", 3: "envelope:natural_key,query:d,query:p", 4: "k,envelope:natural_key,query:d,query:p"}


def test_flow_checks(spark):
    rows = [(day(1), 5, -5, 0, 9, False, False), (None, 5, -4, 0, 3, True, False), (day(2), -5, 5, 0, 4, None, True)]
    f = spark.createDataFrame(rows, "session date, a long, b long, total long, volume long, con boolean, tail boolean")
    got = sleeves.quality_counts(f.withColumn("g", F.lit(1)), ["g"], sleeves.flow_checks(["a", "b"], "total", "a", "volume", "con", "tail")).first()
    assert tuple(got)[1:] == (3, 1, 1, 1, 1, 2)


def test_strict_decimal(spark):
    cases = {"1,234.5": "1234.500000", " 7 ": "7.000000", "-0.25": "-0.250000", "": None, "1.2.3": None, "x": None, ",": None, None: None, "9" * 40: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: None if r.d is None else str(r.d) for r in df.select("t", core.strict_decimal(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_scan_and_publish(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{tmp_path}/d/p=1")
    spark.createDataFrame([(2, "b", 5)], "k int, v string, more int").write.parquet(f"{tmp_path}/d/p=2")
    got = tables.scan_dataset(spark, f"{tmp_path}/d", ["k", "more", "absent"])
    assert sorted(map(tuple, got.collect())) == [(1, None, None), (2, 5, None)] and dict(got.dtypes)["absent"] == "string"
    df = spark.createDataFrame([(1, 2)], "v int, year int")
    one = datasets.publish_identity(df, str(tmp_path), "k", {"a": 1}, ["x", "y"], ["year"])
    assert one == datasets.publish_identity(df, str(tmp_path), "k", {"a": 1}, ["y", "x"], ["year"]) and datasets.identity("k", {"a": 1}, ["x", "y"]) in one
    with pytest.raises(core.PointInTimeError):
        datasets.publish_identity(df.withColumn("v", F.lit(9)), str(tmp_path), "k", {"a": 1}, ["x", "y"], ["year"])
    assert datasets.publish_identity(df.withColumn("v", F.lit(9)), str(tmp_path), "k", {"a": 2}, ["x", "y"], ["year"]) != one


def test_priced_orders(spark):
    """One case of each reason, a fill in part, both sides, and a price held by the day's limit."""
    row = {"open": 1000, "close": 1000, "volume": 5, "upper_limit": 1300, "lower_limit": 700, "open_at_upper": False, "open_at_lower": False, "entry_blocked": False, "adtv20": 40000.0, "ret_vol60": 0.01}
    cases = {
        1: ("buy", 10, {}, {}, (10, 1012, None, 0)), 2: ("sell", 10, {}, {}, (10, 988, None, 0)), 3: ("buy", 25, {}, {}, (20, 1013, "capacity", 5)), 4: ("buy", 5, {"volume": 0}, {}, (0, None, "halted", 5)),
        5: ("buy", 5, {"entry_blocked": True}, {}, (0, None, "entry_blocked", 5)), 6: ("sell", 5, {"entry_blocked": True}, {"adtv20": 1e9}, (5, 988, None, 0)), 7: ("buy", 5, {"open": 0}, {}, (0, None, "missing_price", 5)),
        8: ("buy", 5, {"open_at_upper": True}, {}, (0, None, "limit_locked", 5)), 9: ("buy", 5, {"open_at_lower": True}, {"adtv20": 1e9}, (5, 1012, None, 0)), 10: ("buy", 5, {}, {"adtv20": None}, (0, None, "capacity", 5)),
        11: ("buy", 5, {}, {"ret_vol60": None}, (0, None, "no_volatility", 5)), 12: ("buy", 5, None, {}, (0, None, "missing_price", 5)), 13: ("buy", 5, {"upper_limit": 1005}, {}, (5, 1005, None, 0)), 14: ("sell", 5, {"lower_limit": 999}, {}, (5, 999, None, 0)),
    }
    rows, asked = [], []
    for i, (side, quantity, later, before, _) in cases.items():
        asked.append((i, 3, side, quantity))
        rows.append((i, 3, *(row | before).values()))
        if later is not None:
            rows.append((i, 4, *(row | later).values()))
    schema = "instrument_id int, pos int, open long, close long, volume long, upper_limit long, lower_limit long, open_at_upper boolean, open_at_lower boolean, entry_blocked boolean, adtv20 double, ret_vol60 double"
    got = orders.priced_orders(spark.createDataFrame(asked, "instrument_id int, pos int, side string, quantity long"), spark.createDataFrame(rows, schema), 0.5, 0.2, 0.01, 0.2, F.lit(5))
    assert {r.instrument_id: (r.filled, r.price, r.reject, r.rest) for r in got.collect()} == {i: want for i, (*_, want) in cases.items()}
