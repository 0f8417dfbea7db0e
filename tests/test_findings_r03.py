"""Findings of the third round: each test would have failed before its change."""

import time
from datetime import date, timedelta

import pytest

from tests.conftest import SF
from tidemark.operators import evaluation, fundamentals, modeling, reports, silver, universe
from tidemark.plans import market


def day(n):
    return date(1970, 1, 1) + timedelta(days=n)


@pytest.mark.parametrize("days", [0, 3, 365])
def test_dividend_ttm_makes_no_row_a_day(spark, days):
    paid = [(k, 10 * k + n, day(n)) for k in (1, 2) for n in (-800, -366, -365, -1, 0, 1, 3, 4, 364, 365, 366, 1000) if n % (k + 1)]
    seen = [(k, day(n)) for k in (1, 2, 3) for n in range(-900, 1500, 1 if days < 9 else 7)]
    got = fundamentals.dividend_ttm(spark.createDataFrame(paid, "instrument_id long, dps long, ex_day date"), spark.createDataFrame(seen, "instrument_id long, session date"), days)
    want = {}
    for k, s in seen:
        own = [d for i, d, ex in paid if i == k and ex <= s <= ex + timedelta(days=days)]
        if own:
            want[k, s] = (sum(own), len(own))
    assert {(r.instrument_id, r.session): (r.dps_ttm, r.paid) for r in got.collect()} == want
    # A row for each day of a span looked small to the planner, which sent all of them to every task.
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_current_universe_shows_a_blank_ticker_as_empty(spark):
    rows = [(day(1), "a", True), (day(9), "  b ", True), (day(9), " ", True), (day(9), "", True), (day(9), None, True), (day(9), "c", False)]
    got = universe.current_universe(spark.createDataFrame(rows, "session date, ticker string, eligible boolean"))
    assert sorted(r.ticker for r in got.collect()) == ["", "b"]


@pytest.mark.parametrize("name", ["features_market", "features_levels", "forward_labels"])
def test_features_lay_out_no_grid(spark, name):
    # A row for each slot of the calendar is several times the observed rows.
    plan = market.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_ranked_design_neither_copies_nor_joins(spark):
    rows = [(i, 0, float(v), None) for i, v in enumerate((5, 5, 1, "nan", 9))] + [(7, 0, None, 2.0)]
    got = modeling.ranked_design(spark.createDataFrame(rows, "instrument_id long, pos long, a double, b double"), ["a", "b"], 2)
    assert {r.instrument_id: (r.a, r.b) for r in got.collect()} == {0: (0.375, -1.0), 1: (0.625, -1.0), 2: (0.125, -1.0), 3: (-1.0, -1.0), 4: (0.875, -1.0), 7: (-1.0, -1.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_walk_forward_joins_no_rows_by_instrument(spark, monkeypatch):
    # The design, whose size the planner underestimates, was joined with the labels and went broadcast.
    plans = {}

    class Seen(Exception):
        pass

    def written(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        if label == "labelled":
            raise Seen
        return df

    monkeypatch.setattr(modeling, "written", written)
    calendar = spark.createDataFrame([(date(2019, 12, 2) + timedelta(days=n), n) for n in range(60)], "session date, pos long")
    rows = spark.createDataFrame([(i, n, float(i * n % 7), float(i)) for i in range(6) for n in range(60)], "instrument_id long, pos long, a double, y5 double")
    with pytest.raises(Seen):
        modeling.walk_forward_scores(rows, calendar, ["a"], {5: "y5"}, [2020], last=59)
    assert set(plans) == {"design", "labelled"}
    assert not [x for p in plans.values() for x in p.splitlines() if "Join" in x and "instrument_id" in x]


def test_a_level_back_at_its_peak_is_not_under_water(spark):
    # -0.1 - 0.2 + 0.3 ends a little below 0.
    rows = spark.createDataFrame([(1, n, m) for n, m in enumerate((-0.1, -0.2, 0.3, 0.1))], "instrument_id long, pos long, log_return double")
    assert evaluation.longest_underwater(rows, "instrument_id").first()["longest"] == 2


def test_knob_changes_parses_each_spec_once(spark):
    rows = [(1, '{"a": {"b": 1, "c": 2}, "a.b": 5, "t": "1", "x": 1e400}', '{"a": {"b": 1}, "a.b": 6}'), (2, '{"a": 1, "a": 2}', '{"a": NaN}'), (3, '{"a": 9007199254740993}', '{"a": 9007199254740992.0, "b": true}')]
    got = reports.knob_changes(spark.createDataFrame(rows, "k long, l string, r string"), "k", "l", "r")
    assert sorted((r.k, r.path, r.was, r.now) for r in got.collect() if r.was is not None and r.now is not None) == [(1, "a.b", 1.0, 5.0), (1, "a.b", 6.0, 1.0), (1, "a.b", 6.0, 5.0)]
    assert {(r.path, r.now) for r in got.where("was is null").collect()} == {("a.c", 2.0), ("x", float("inf"))}
    # Each of seven levels opened the texts anew, and both sides met in a join.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def _stream_plan(spark, name):
    return market.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["bootstrap_profile", "paired_growth_tail_delta", "challenges"])
def test_draws_stay_where_they_are_made(spark, name):
    # Starts were made by interpreted functions for each stream anew, streams copied for each part of the draws, and each draw was a row of an aggregate.
    plan = _stream_plan(spark, name)
    assert "xxhash64" not in plan and "percentile(" not in plan and "sequence(" not in plan


def test_profiles_equal_outcomes(spark):
    rows = [(k, i, ((i * 7919 + len(k)) % 101 - 50) / 4e3, ((i * 6007) % 97 - 40) / 3e3) for k, n in (("a", 90), ("bb", 63), ("short", 62)) for i in range(n)]
    s = spark.createDataFrame(rows, "key string, pos long, log_return double, market double")
    one, two = ["key", 33, 200, 63, 7], ["key", "log_return", "market", 33, 200, 63, 7, 14, 0.2]
    found = [
        (evaluation.bootstrap_profile(s, *one, 0.05, -0.3, chunk=8), evaluation.outcome_profile(evaluation.bootstrap_outcomes(s, *one), "key", 0.05, -0.3)),
        (evaluation.paired_profile(s, *two, 0.05, chunk=8), evaluation.paired_delta(evaluation.paired_outcomes(s, *two), "key", 0.05)),
    ]
    family = spark.createDataFrame([("a", 0), ("bb", 4)], "key string, prior int")
    found.append((reports.challenge_bounds(evaluation.paired_lists(s, *two, chunk=8), "key", family, 0.05), reports.challenge_deltas(evaluation.paired_outcomes(s, *two), "key", family, 0.05)))
    for got, want in found:
        got, want = ([r.asDict() for r in x.select(*sorted(want.columns)).orderBy("key").collect()] for x in (got, want))
        assert len(got) == 2 and all(a == pytest.approx(b, abs=1e-12) for a, b in zip(got, want, strict=True))


def test_dividend_resolve_searches_once_a_decision(spark):
    # The search stood inside the filter: the cube of a company's decisions, minutes for these.
    n = 1200
    rows = [(1, i, day(40 * (i // 2) + 35 * (i % 2)), "cash", i % 3 == 0, 1.0) for i in range(n)]
    standing = {}
    for _, receipt, record, _, correction, _ in rows:
        near = [r for r, d in standing.items() if correction and abs((d - record).days) <= 30]
        standing = {r: d for r, d in standing.items() if r != max(near, default=None) and d != record} | {receipt: record}
    began = time.monotonic()
    got = silver.dividend_resolve(spark.createDataFrame(rows, "company_id int, receipt int, record_date date, kind string, correction boolean, amount double"), 30)
    assert {r.receipt for r in got.collect()} == set(standing) and len(standing) < n
    assert time.monotonic() - began < 40


def _shuffles(spark, name):
    plan = market.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return [x[x.index("hashpartitioning(") :] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]


@pytest.mark.parametrize("name", ["daily_bars", "rolling_beta", "liquidity"])
def test_bars_meet_once_by_instrument(spark, name):
    # Lines went by instrument and day as partial sums, which merge next to nothing, and days once more by instrument.
    found = [x.split("), ")[0] for x in _shuffles(spark, name) if "instrument_id" in x]
    assert found and not [x for x in found if "session" in x]


def test_announcement_features_join_no_cells(spark):
    plan = _stream_plan(spark, "announcement_features")
    assert "LeftOuter" not in plan and "explode(sequence(0" not in plan


@pytest.mark.parametrize("name", ["earnings_surprises", "best_earnings", "asof_fundamentals"])
def test_steps_are_held_not_looked_up(spark, name):
    # Each company's sessions were laid out first, shuffled for each side and joined.
    assert "explode(sequence(0" not in _stream_plan(spark, name)


def test_causality_compares_families_together(spark):
    assert _stream_plan(spark, "causality_check").count("Join FullOuter") == 2


def test_ensemble_shuffles_by_session_once(spark):
    found = [x for x in _shuffles(spark, "ensemble_average") if "horizon" in x or "seed" in x or "hashpartitioning(pos" in x]
    assert len(found) == 1 and "horizon" not in found[0]


def test_quotes_of_a_session_are_one_row_apart(spark):
    plan = _stream_plan(spark, "slippage")
    assert "Union" not in plan and "pivot" not in plan.lower()


def test_paths_are_not_shuffled(spark):
    assert not [x for x in _shuffles(spark, "bootstrap_given_starts") if "draw" in x or "pos" in x.split("), ")[0]]


def test_priced_orders_computes_rows_once(spark):
    # The panel was computed for both sides of the orders, and the bars once more for the orders.
    assert "l_suppkey" not in _stream_plan(spark, "priced_orders")
