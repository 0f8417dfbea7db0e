"""Point-in-time rules against values worked out by hand, and entry blocks against a walk over the sessions."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import actions, evaluation, fundamentals, pit, sleeves, universe


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([(day(n), i) for i, n in enumerate((10, 11, 14, 20))], "session date, pos long")


def test_basis_is_preferred_for_each_fact(spark):
    rows = [(1, 9, "ni", "consolidated", 3, 1, 5.0), (1, 9, "ni", "separate", 8, 2, 6.0), (1, 9, "equity", "separate", 2, 3, 7.0), (1, 9, "equity", "separate", 4, 4, 8.0)]
    v = pit.preferred_versions(spark.createDataFrame(rows, "company_id long, quarter long, fact string, basis string, avail_pos long, version long, value double"))
    assert {(r.fact, r.value) for r in v.collect()} == {("ni", 5.0), ("equity", 7.0), ("equity", 8.0)}
    assert {(r.fact, r.value, r.avail_pos) for r in pit.quarter_facts(v).collect()} == {("ni", 5.0, 3), ("equity", 8.0, 4)}


def test_days_long_before_the_calendar_count_as_its_first(spark, calendar):
    days = spark.createDataFrame([(i, day(n)) for i, n in enumerate((-3000, 9, 10, 11, 13, 20, 21))] + [(99, None)], "i long, d date")
    assert {r.i: r.avail_pos for r in fundamentals.avail_index(days, calendar, "d").collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    facts = days.withColumn("receipt", F.lit("x"))
    assert {r.i: r.avail_pos for r in pit.effective_availability(facts, calendar, "d", "receipt").collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    sealed = days.select((F.col("i") - 5).alias("pos"), F.col("d").cast("timestamp").alias("sealed_at"))
    got = {r.pos + 5: r.effective for r in evaluation.effective_position(sealed, calendar, 9).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


def test_instants_meet_the_decision_at_18(spark, calendar):
    rows = [(i, datetime(2020, 1, d, h, m, s)) for i, (d, h, m, s) in enumerate([(12, 8, 59, 59), (12, 9, 0, 0), (12, 9, 0, 1), (11, 9, 0, 0), (11, 20, 0, 0)])]
    df = spark.createDataFrame(rows, "i long, t timestamp")  # UTC: 9:00 is 18:00 in Seoul
    assert {r.i: r.d.day for r in df.select("i", core.decision_day(F.col("t")).alias("d")).collect()} == {0: 12, 1: 12, 2: 13, 3: 11, 4: 12}
    assert {r.i: r.avail_pos for r in fundamentals.avail_index(df, calendar, "t").collect()} == {0: 1, 1: 1, 2: 2, 3: 0, 4: 1}
    assert {r.i: r.d.day for r in df.select("i", actions.open_day(F.col("t"), 18).alias("d")).collect()} == {0: 12, 1: 13, 2: 13, 3: 12, 4: 12}


@pytest.mark.parametrize(("signal", "vol", "want"), [
    (-0.5, 0.0, (-0.5, 1.0, 0.25)), (-1.0, 0.2, (-1.0, 1.0, 0.5)), (-1.0, 0.6, (-1.0, 0.5, 1 / 3)), (1.0, 0.6, (1.0, 0.5, 0.0)), (-1.0, None, (0.0, 1.0, 0.0)), (None, 0.6, (0.0, 0.5, 0.0)), (0.0, 0.1, (0.0, 1.0, 0.0)),
])
def test_overlay_fractions(spark, signal, vol, want):
    got = sleeves.overlay_fractions(spark.createDataFrame([(signal, vol)], "signal double, vol double"), 0.3, 0.2, 0.5).first()
    assert (got.trend_signal, got.vol_scale, got.regime_fraction) == pytest.approx(want)


def test_an_old_release_does_not_beat_a_newer_filing(spark):
    schema = "company_id long, pos long, quarter long, known_pos long, value double"
    filed = pit.newest_steps(spark.createDataFrame([(1, 8, 2, 1.0), (1, 10, 4, 2.0), (1, 9, 6, 3.0)], "company_id long, quarter long, avail_pos long, value double"))
    released = spark.createDataFrame([(1, 3, 9, 3, 30.0), (1, 5, 10, 5, 31.0), (1, 7, 11, 7, 32.0)], schema)
    cells = spark.createDataFrame([(1, p) for p in range(9)], "company_id long, pos long")
    shown = [pit.asof_steps(x, cells, "company_id").where("quarter is not null") for x in (filed, released)]
    got = {r.pos: (r.quarter, r.value, r.known_pos, r.origin) for r in pit.best_earnings(*shown).collect()}
    assert got == {
        2: (8, 1.0, 2, "filing"), 3: (9, 30.0, 3, "release"), 4: (10, 2.0, 4, "filing"), 5: (10, 2.0, 4, "filing"), 6: (10, 2.0, 4, "filing"), 7: (11, 32.0, 7, "release"), 8: (11, 32.0, 7, "release"),
    }


def test_capture_symbols(spark):
    w = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (4, "a", 0.5), (4, "c", 0.3), (4, "d", 0.2)], "pos long, instrument_id string, weight double")
    held = spark.createDataFrame([(4, "a"), (4, "z"), (5, "a"), (0, "q")], "pos long, instrument_id string")
    got = {(r.pos, r["rank"]): r.instrument_id for r in sleeves.capture_symbols(w, held, 5).collect()}
    assert got == {(0, 1): "a", (0, 2): "b", (0, 3): "q", (4, 1): "b", (4, 2): "c", (4, 3): "d", (4, 4): "a", (4, 5): "z"}
    assert sleeves.capture_symbols(w, held, 2).count() == 4


def test_quarantine_is_by_filing(spark):
    rows = [(1, "f1", "ni", 3, False), (1, "f1", "eq", 5, True), (1, "f2", "ni", 4, False), (1, "f2", "eq", 6, None)]
    sound, bad = pit.fact_quarantine(spark.createDataFrame(rows, "company_id long, filing string, fact string, avail_pos long, ok boolean"), ["company_id", "filing"], F.col("ok"))
    assert [tuple(r) for r in bad.collect()] == [(1, "f2", 6, 2)] and sound.count() == 1


def walked(events, sessions, cap, administrative):
    """Cells by one walk over the sessions with the state carried along."""
    out = {}
    for inst in {e[0] for e in events}:
        todo = sorted((e[1], e[2], e[3], e) for e in events if e[0] == inst)
        delisting = liquidation = flagged = False
        last, windows = -1, []
        for pos, session in enumerate(sessions):
            while todo and todo[0][0] <= pos:
                _, _, kind, (*_, cancel, start, end) = todo.pop(0)
                if cancel:
                    delisting = liquidation = False
                    windows = []
                elif kind in (actions.DELISTING, actions.LIQUIDATION):
                    if end is not None:
                        windows.append((start, end))
                    else:
                        last = pos
                        delisting, liquidation = delisting or kind == actions.DELISTING, liquidation or kind == actions.LIQUIDATION
                elif kind in (actions.DESIGNATED, actions.RELEASED):
                    flagged = kind == actions.DESIGNATED
            if pos - last > cap:
                delisting = liquidation = False
            on = [w for w in windows if session <= w[1]]
            if on:
                out[inst, pos] = actions.LIQUIDATION if any(s is not None and session >= s for s, _ in on) else actions.DELISTING
            elif delisting or liquidation:
                out[inst, pos] = actions.DELISTING if delisting else actions.LIQUIDATION
            elif flagged and administrative:
                out[inst, pos] = actions.DESIGNATED
    return out


@pytest.mark.parametrize(("seed", "cap", "administrative"), [(1, 6, True), (2, 3, False), (3, 12, True)])
def test_entry_blocks(spark, seed, cap, administrative):
    rng = random.Random(seed)
    sessions = [day(n) for n in range(120) if n % 7 < 5]
    kinds = [actions.DELISTING, actions.LIQUIDATION, actions.DESIGNATED, actions.RELEASED, actions.HALTED]
    events = []
    for i in range(90):
        kind, pos = rng.choice(kinds), rng.choice([0, 0, *range(len(sessions))])
        cancel = kind == actions.DELISTING and rng.random() < 0.3
        end = sessions[pos] + timedelta(days=rng.randrange(-3, 25)) if kind in kinds[:2] and rng.random() < 0.4 else None
        start = end - timedelta(days=rng.randrange(0, 9)) if end and rng.random() < 0.7 else None
        events.append((rng.randrange(4), pos, f"{i:03d}", kind, cancel, start, end))
    df = spark.createDataFrame(events, "instrument_id long, avail_pos long, receipt string, kind string, cancellation boolean, effective_start date, effective_end date")
    cal = spark.createDataFrame([(s, i) for i, s in enumerate(sessions)], "session date, pos long")
    got = {(r.instrument_id, r.pos): r.reason for r in actions.entry_blocks(df, cal, cap, administrative).collect()}
    assert got == walked(events, sessions, cap, administrative) and got
    assert actions.entry_blocks(df.limit(0), cal, cap).count() == 0


@pytest.mark.parametrize(("gap", "blocked"), [(3, 7), (4, 8), (5, 8)])
def test_a_notice_at_the_lapse_goes_on(spark, gap, blocked):
    """Two notices of one kind, then of either: the second meets a block of three sessions before, at or after its lapse."""
    e = [(1, 0, "a", actions.DELISTING, False, None, None), (1, gap, "b", actions.LIQUIDATION, False, None, None)]
    df = spark.createDataFrame(e, "instrument_id long, avail_pos long, receipt string, kind string, cancellation boolean, effective_start date, effective_end date")
    cal = spark.createDataFrame([(day(i), i) for i in range(30)], "session date, pos long")
    got = {r.pos: r.reason for r in actions.entry_blocks(df, cal, 3).collect()}
    assert len(got) == blocked and got == {p: r for (_, p), r in walked(e, [day(i) for i in range(30)], 3, True).items()}
    assert got[gap] == (actions.LIQUIDATION if gap == 5 else actions.DELISTING)


@pytest.mark.parametrize(("title", "kind", "cancelled"), [
    ("[기재정정] 주권 상장폐지 결정 ", actions.DELISTING, False), ("상장폐지 결정 철회", None, True), ("가처분 결정 취소에 따른 상장폐지 정리매매 재개", actions.LIQUIDATION, False), ("상장폐지 효력정지 가처분 인용", None, True),
    ("매매거래정지 및 정지해제", actions.HALTED, False), ("상장폐지 우려 매매거래정지 해제", actions.RESUMED, False), ("관리종목 지정사유 일부해제", actions.DESIGNATED, False), ("관리종목 지정사유 추가", None, False), ("", None, False), (None, None, False),
])
def test_titles(spark, title, kind, cancelled):
    if title == "관리종목 지정사유 일부해제":
        kind = None  # a cause is no designation, and a part of it no release
    r = spark.createDataFrame([(title,)], "t string").select(actions.action_kind(F.col("t")).alias("k"), actions.delisting_cancelled(F.col("t")).alias("c")).first()
    assert (r.k, r.c) == (kind, cancelled)


def test_exchange_notices(spark, calendar):
    pages = spark.createDataFrame([(day(2), 1), (day(2), 41), (day(6), 1)], "session date, instrument_id long")
    at = datetime(2020, 1, 4, 1)  # day 3 in Seoul, after the open
    later = datetime(2020, 1, 8, 1)
    main, desk = "유가증권시장본부", "코스닥시장본부"
    rows = [
        ("a", "상장폐지", main, 1, at, [1, 41, 7], day(5), day(9), True), ("b", "상장폐지", main, 1, at, [1], day(1), day(3), True), ("c", "관리종목지정", main, 1, at, None, day(4), None, False),
        ("d", "관리종목 지정", main, 41, at, None, day(4), None, True), ("e", "관리종목지정해제", desk, 1, at, None, None, None, True), ("f", "상장폐지 결정 철회", main, 41, at, None, None, None, True),
        ("g", "관리종목 해제", desk, 1, at, None, None, None, True), ("h", "상장폐지 결정", "회사", 1, at, None, None, None, True), ("i", "상장폐지 결정", main, None, at, None, None, None, True),
        ("j", "주권 매매거래정지", main, 41, later, None, None, None, True),
    ]
    n = spark.createDataFrame(rows, "receipt string, title string, submitter string, instrument_id long, disclosed_at timestamp, listed_ids array<long>, form_start date, form_end date, is_common boolean")
    got = sorted((r.receipt, r.instrument_id, r.kind, r.effective_end, r.cancellation) for r in actions.exchange_actions(n, pages).collect())
    assert got == [("a", 1, actions.DELISTING, day(9), False), ("a", 41, actions.DELISTING, day(9), False), ("b", 1, actions.DELISTING, None, False), ("d", 41, actions.DESIGNATED, None, False), ("f", 41, actions.DELISTING, None, True)]
    assert {r.avail_pos for r in actions.market_actions([actions.exchange_actions(n, pages)], calendar).collect()} == {0}


def test_universe_reasons(spark):
    base = {"share_kind": "보통주", "security_group": "주권", "market": "KOSPI", "section": None, "name": "x", "short_name": None, "english_name": None, "session": day(5), "ticker": "1", "isin": "K", "listed_on": day(5)}
    cases = [
        ({}, "eligible"), ({"share_kind": " "}, "unknown_share_kind"), ({"share_kind": None, "market": ""}, "unknown_share_kind"), ({"share_kind": "우선주"}, "non_ordinary_share"), ({"security_group": None}, "unknown_security_group"),
        ({"security_group": "투자회사"}, "non_equity_security_group"), ({"market": ""}, "unknown_market"), ({"market": "KONEX"}, "excluded_market"), ({"section": "SPAC(소속부없음)"}, "spac"), ({"english_name": "A Spac"}, "spac"),
        ({"name": "하나 스팩"}, "spac"), ({"listed_on": day(6)}, "not_listed_yet"), ({"listed_on": None}, "eligible"), ({"listed_on": day(6), "market": "KONEX"}, "excluded_market"),
    ]
    schema = "share_kind string, security_group string, market string, section string, name string, short_name string, english_name string, session date, ticker string, isin string, listed_on date, i int"
    rows = [tuple((base | change).values()) + (i,) for i, (change, _) in enumerate(cases)]
    got, bad = universe.universe_snapshot(spark.createDataFrame(rows, schema))
    assert {r.i: r.exclusion_reason for r in got.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    assert {(r.violation, r.code) for r in bad.collect()} == {("duplicate_ticker", "1")}
    at = got.select(F.date_format("available_at", "yyyy-MM-dd HH:mm").alias("t")).first().t
    assert at == "2020-01-06 06:30"
    pages = spark.createDataFrame([(day(1),), (day(2),), (day(2),)], "session date")
    want = spark.createDataFrame([(day(1),), (day(2),), (day(3),)], "session date")
    assert {(r.session, r.problem) for r in universe.snapshot_completeness(pages, want).collect()} == {(day(2), "ambiguous"), (day(3), "missing")}
