"""Annual releases, report cards, challenges, knobs, slippage and walk-forward folds on made cases."""

import json
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import modeling, pit, reports, sleeves

RELEASE = "company_id long, quarter long, metric string, basis string, span string, avail_pos long, version long, value double, prior_value double"


def facts(spark, rows):
    return spark.createDataFrame(rows, "company_id long, quarter long, fact string, avail_pos long, value double")


def test_annual_release_less_three_quarters(spark):
    f = facts(spark, [(1, q, "ni", 10 * i, float(i + 1)) for i, q in enumerate((4, 5, 6, 8, 9, 10))] + [(2, 8, "ni", 1, 1.0), (2, 9, "ni", 99, 1.0), (2, 10, "ni", 2, 1.0), (3, 8, "ni", 1, 1.0), (3, 10, "ni", 1, 1.0)])
    rows = [
        (1, 11, "ni", "consolidated", "annual", 50, 1, 100.0, 40.0), (1, 11, "ni", "consolidated", "annual", 49, 0, 100.0, 40.0), (1, 10, "ni", "consolidated", "quarter", 45, 2, 7.0, None),
        (2, 11, "ni", "consolidated", "annual", 50, 1, 9.0, 9.0), (3, 11, "ni", "consolidated", "annual", 50, 1, 9.0, None), (1, 10, "ni", "separate", "quarter", 46, 3, 8.0, 1.0), (4, 10, "op", "separate", "quarter", 46, 3, 8.0, 1.0),
    ]
    got = {(r.company_id, r.quarter, r.avail_pos): (r.value, r.prior_value) for r in pit.release_quarters(spark.createDataFrame(rows, RELEASE), f).collect()}
    assert got == {
        (1, 11, 50): (100.0 - 15.0, 40.0 - 6.0), (1, 11, 49): (None, 34.0), (1, 10, 45): (7.0, None), (2, 11, 50): (None, None), (3, 11, 50): (None, None), (4, 10, 46): (8.0, 1.0),
    }


def test_versions_replace_both_values_of_the_metrics_they_name(spark):
    rows = [(1, 10, "ni", 5, 1, 1.0, 0.5), (1, 10, "op", 5, 1, 2.0, None), (1, 10, "ni", 7, 2, None, 0.6), (1, 9, "ni", 8, 3, 9.0, 9.0), (1, 11, "op", 9, 4, 3.0, 1.0), (1, 10, "op", 12, 5, 7.0, 7.0)]
    steps = pit.release_pair_steps(spark.createDataFrame(rows, "company_id long, quarter long, metric string, avail_pos long, version long, value double, prior_value double"), ["ni", "op"])
    assert {r.pos: (r.quarter, r.known_pos, r.ni, r.ni_ly, r.op, r.op_ly) for r in steps.collect()} == {
        5: (10, 5, 1.0, 0.5, 2.0, None), 7: (10, 5, None, 0.6, 2.0, None), 8: (10, 5, None, 0.6, 2.0, None), 9: (11, 9, None, None, 3.0, 1.0), 12: (11, 9, None, None, 3.0, 1.0),
    }


def test_report_card(spark):
    p = [(1, "slip", 0.1, 0.1, 0.3), (1, "delay", 0.05, 0.3, 0.2), (2, "slip", 0.1, 0.0, 0.0), (2, "delay", 0.1, 0.9, 0.9), (3, "slip", 0.1, 0.0, 0.0), (3, "delay", None, None, None), (4, "base", 0.0, 1.0, 1.0), (4, "slip", 1.0, 0.2, 0.4)]
    i = [(1, "slip", True), (1, "base", False), (2, "slip", True), (4, "slip", None)]
    m = [(1, 0), (2, 0), (4, 3)]
    card = reports.report_card(spark.createDataFrame(p, "run int, stream string, g_low double, p_deep double, p_loss double"), spark.createDataFrame(i, "run int, stream string, aligned boolean"), spark.createDataFrame(m, "run int, mismatches int"), ["slip", "delay"], 0.2, 0.4)
    assert {r.run: (r.objective_stream, r.failed, r.passed) for r in card.collect()} == {
        1: ("delay", ["p_deep", "integrity_base"], False), 2: ("slip", [], True), 3: ("delay", ["perturbation_mismatches", "p_deep", "p_loss"], False), 4: ("slip", ["perturbation_mismatches", "integrity_slip"], False),
    }


def test_stream_integrity(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.1), ("b", 1, math.nan), ("c", 0, 0.1), ("c", 2, 0.1), ("d", 0, 0.1), ("d", 0, 0.1), ("e", 0, 0.1), ("f", 0, 0.1), ("f", 1, None)]
    got = reports.stream_integrity(spark.createDataFrame(rows, "s string, pos int, log_return double"), ["s"], spark.createDataFrame([(0,), (1,)], "pos int"))
    assert {r.s for r in got.where("aligned").collect()} == {"a"} and got.count() == 6


def test_quantile_at(spark):
    values = [5.0, 1.0, 4.0, 2.0]
    for share in (0.0, 0.05, 0.5, 0.9, 1.0):
        got = spark.createDataFrame([(values, share)], "v array<double>, s double").select(reports.quantile_at(F.col("v"), F.col("s"))).first()[0]
        assert got == pytest.approx(np.quantile(values, share))


def decided(spark, asked, near=(), changes=(), margin=0.02):
    a = spark.createDataFrame([asked], "challenger string, passed boolean, objective double, champion_objective double, growth_lower double, tail_lower double")
    n = spark.createDataFrame(list(near), "challenger string, neighbour string, knob string, growth_mean double, tail_mean double")
    c = spark.createDataFrame(list(changes), "challenger string, knob string")
    r = reports.challenge_decision(a, n, c, margin).first()
    return r.path, r.reasons


def test_challenge_decision(spark):
    assert decided(spark, ("a", True, 1.0, 1.0, 0.01, -1.0)) == ("superiority", [])
    assert decided(spark, ("a", True, 1.0, 1.0, 0.0, 0.01)) == ("noninferiority", [])
    assert decided(spark, ("a", True, 1.0, 1.0, 0.0, 0.01), margin=None) == ("none", ["superiority:lower_bound"])
    assert decided(spark, ("a", True, 1.0, 1.0, -0.02, 0.01)) == ("none", ["superiority:lower_bound", "noninferiority:growth_margin"])
    assert decided(spark, ("a", False, 0.9, 1.0, 1.0, 1.0)) == ("none", ["report_failed", "objective"])
    assert decided(spark, ("a", True, None, 1.0, 1.0, 1.0)) == ("none", ["objective"])
    near = [("a", "n1", "policy.n", -0.01, 0.1), ("a", "n2", "policy.n", 0.1, 0.1)]
    assert decided(spark, ("a", True, 1.0, 1.0, 0.1, 0.1), near, [("a", "policy.n")]) == ("noninferiority", [])
    assert decided(spark, ("a", True, 1.0, 1.0, 0.1, 0.1), near) == ("superiority", [])  # nothing changed
    assert decided(spark, ("a", True, 1.0, 1.0, 0.1, 0.1), near[1:], [("a", "policy.n"), ("a", "scorer.depth")]) == ("superiority", [])
    path, against = decided(spark, ("a", True, 1.0, 1.0, 0.1, 0.1), [("a", "n3", "policy.n", -0.5, None)], [("a", "policy.n"), ("a", "policy.keep")])
    assert path == "none" and against == ["neighbours_missing:policy.keep", "superiority:neighbour_not_better:n3", "noninferiority:neighbour_growth:n3", "noninferiority:neighbour_tail:n3"]


def test_family_bounds(spark):
    draws = [("a", i, float(i), float(-i)) for i in range(101)] + [("b", i, float(i), float(-i)) for i in range(101)]
    d = spark.createDataFrame(draws, "k string, draw int, growth double, tail double")
    got = reports.challenge_deltas(d, "k", spark.createDataFrame([("a", 0), ("b", 4)], "k string, prior int"), 0.1)
    assert {r.k: (r.alpha, r.growth_lower, r.growth_mean) for r in got.collect()} == {"a": (0.1, 10.0, 50.0), "b": (pytest.approx(0.02), pytest.approx(2.0), 50.0)}


def test_knob_changes(spark):
    left = {"policy": {"n": 5, "keep": 1.5, "same": 3, "new": 0, "deep": {"x": {"y": 1}}}, "flag": True, "name": "5", "list": [1], "none": None, "kind": 1}
    right = {"policy": {"n": 6, "keep": 1.5, "same": 3.0, "deep": {"x": {"y": 2}, "gone": -1}}, "flag": False, "name": "6", "list": [2], "none": None, "kind": "1"}
    pairs = spark.createDataFrame([(1, json.dumps(left), json.dumps(right)), (2, "no json", "{}"), (3, None, json.dumps({"a": 1e3}))], "k int, l string, r string")
    got = {(r.k, r.path): (r.was, r.now) for r in reports.knob_changes(pairs, "k", "l", "r").collect()}
    assert got == {(1, "policy.n"): (6.0, 5.0), (1, "policy.new"): (None, 0.0), (1, "policy.deep.x.y"): (2.0, 1.0), (1, "policy.deep.gone"): (-1.0, None), (1, "kind"): (None, 1.0), (3, "a"): (1000.0, None)}
    nested = {"v": 1}
    for _ in range(8):
        nested = {"o": nested}
    with pytest.raises(Exception, match="too deeply"):
        reports.knob_changes(spark.createDataFrame([(1, json.dumps(nested), "{}")], "k int, l string, r string"), "k", "l", "r").collect()


def test_slippage(spark):
    d = date(2020, 1, 2)
    fills = spark.createDataFrame([(d, 1, "buy", 10, 105), (d, 1, "sell", 10, 105), (d, 2, "buy", 1, 100), (d, 3, "buy", 1, 50)], "session date, instrument_id int, side string, quantity long, price long")
    market = spark.createDataFrame([(d, 1, 100, "MAIN", 500.0), (d, 2, 0, "MAIN", 0.0), (d, 3, 40, "MAIN", None)], "session date, instrument_id int, open long, market string, adtv20 double")
    quotes = [(1, "open", 0, '{"open": "110"}'), (1, "expected", -5, '{"expected": 120}'), (1, "expected", -1, "{"), (2, "expected", -5, '{"expected": 9}'), (3, "open", 0, '{"open": 0}'), (3, "expected", -5, '{"expected": 42}'), (3, "expected", -9, '{"expected": 1}')]
    auction = spark.createDataFrame([(d, *q) for q in quotes], "session date, instrument_id int, kind string, offset int, payload string")
    got = reports.slippage_table(fills, auction, market, [-5, -1], F.lit(5)).orderBy("instrument_id", "side").collect()
    assert [tuple(r)[5:] for r in got] == [
        (100, 110, 5, 1.0, 2.1, True, 2.0, None), (100, 110, 5, -1.0, 2.1, True, -2.0, None), (None, None, None, None, None, False, None, None), (40, None, 5, 2.0, None, False, 0.4, None),
    ]


def test_feature_sets_and_seals():
    assert modeling.feature_set(["b", "a"], ["a", "b", "c"]) == ["b", "a"]
    with pytest.raises(ValueError, match="repeated"):
        modeling.feature_set(["a", "a"], ["a"])
    with pytest.raises(ValueError, match="unknown"):
        modeling.feature_set(["a", "z"], ["a"])


def test_ensemble_needs_known_scores(spark):
    rows = [(0, i, 5, 1, float(i)) for i in range(3)] + [(1, i, 5, 1, float(i) if i < 2 else None) for i in range(3)]
    got = sleeves.ensemble_average(spark.createDataFrame(rows, "pos int, instrument_id int, horizon int, seed int, score double"), 3)
    assert {(r.pos, r.instrument_id): r.score is not None for r in got.collect()} == {(p, i): p == 0 for p in (0, 1) for i in range(3)}


@pytest.fixture(scope="module")
def market(spark):
    days = [d for i in range(900) if (d := date(2018, 1, 1) + timedelta(days=i)).weekday() < 5]
    rng = np.random.default_rng(0)
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "session date, pos long")
    rows = []
    for pos in range(len(days)):
        for inst in range(12):
            x = float(rng.normal())
            rows.append((inst, pos, x, float(rng.normal()), x + 0.1 * float(rng.normal())))
    return calendar, spark.createDataFrame(rows, "instrument_id long, pos long, a double, b double, y5 double").repartition(4, "instrument_id"), days


def test_walk_forward(spark, market):
    calendar, rows, days = market
    last = max(i for i, d in enumerate(days) if d.year == 2019)

    def scores(r, **more):
        got = modeling.walk_forward_scores(r, calendar, ["a", "b"], {5: "y5"}, [2019], last=last, least_rows=100, trees=3, depth=2, **more)
        return {(x.pos, x.instrument_id): x.score for x in got.collect()}

    plain = scores(rows)
    first = min(i for i, d in enumerate(days) if d.year == 2019)
    assert {p for p, _ in plain} == set(range(first, last + 1)) and len(plain) == 12 * (last - first + 1)
    by = {(r.pos, r.instrument_id): r.a for r in rows.where(F.col("pos") >= first).collect()}
    assert np.corrcoef([by[k] for k in plain], [plain[k] for k in plain])[0, 1] > 0.7
    # Labels from the purge on, features after the seal, and other years: nothing of it may reach a score.
    spoiled = rows.withColumn("y5", F.when(F.col("pos") + 5 + 5 >= first, F.col("y5") * -100).otherwise(F.col("y5"))).withColumn("a", F.when(F.col("pos") > last, -F.col("a")).otherwise(F.col("a")))
    assert scores(spoiled) == plain
    early = rows.withColumn("y5", F.when(F.col("pos") + 40 < first, -F.col("y5")).otherwise(F.col("y5")))
    assert scores(early) != plain
    with pytest.raises(ValueError, match="training rows"):
        modeling.walk_forward_scores(rows, calendar, ["a"], {5: "y5"}, [2019], last=last, least_rows=10**6)
    with pytest.raises(ValueError, match="sealed"):
        modeling.walk_forward_scores(rows, calendar, ["a"], {5: "y5"}, [2020], last=last)


def test_authorized_windows(market):
    calendar, _, days = market
    assert modeling.authorized(calendar, days[3], days[7], days[9]).count() == 5
    for start, end in ((days[0] - timedelta(days=1), days[5]), (days[2], days[10]), (days[5], days[4])):
        with pytest.raises(ValueError, match="outside"):
            modeling.authorized(calendar, start, end, days[9])
