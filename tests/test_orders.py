"""Order arithmetic, blocks, signals and bootstrap by hand."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import audit, evaluation, fundamentals, orders
from tidemark.plans import market, research


def test_rounding_and_costs(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.6,), (-2.6,), (0.0,)], "x double")
    assert [r[0] for r in df.select(orders.nearest_toward_zero(F.col("x"))).collect()] == [2, -2, 3, -3, 0]
    one = spark.createDataFrame([(1_000_000.0, 0.0023)], "n double, r double")
    assert one.select(orders.fill_cost(F.col("n"), F.col("r"))).first()[0] == 2300


def test_target_orders_band_and_exit(spark):
    t = spark.createDataFrame([(0, 1, 100, 0.5), (0, 2, 100, 0.5)], "pos long, instrument_id long, close long, weight double")
    h = spark.createDataFrame([(0, 1, 48), (0, 3, 7)], "pos long, instrument_id long, held long")
    got = {r.instrument_id: r.order for r in orders.target_orders(t, h, 10_000.0, 0.0, 0.1).collect()}
    assert got == {1: 0, 2: 50, 3: -7}


def test_notice_blocks(spark):
    p = spark.createDataFrame([(1, i) for i in range(10)], "instrument_id long, pos long")
    a = spark.createDataFrame([(1, 1, "notice"), (1, 3, "notice"), (1, 5, "cancel"), (1, 8, "notice"), (1, 8, "cancel")], "instrument_id long, pos long, kind string")
    got = [r.blocked for r in fundamentals.notice_blocks(a, p, 3).orderBy("pos").collect()]
    assert got == [False, True, True, True, True, False, False, False, False, False]


def test_late_quarter_does_not_replace_newer(spark):
    c = spark.createDataFrame([(1, 8, 2), (1, 9, 4), (1, 7, 6)], "company_id long, quarter long, pos long")
    p = spark.createDataFrame([(i,) for i in (1, 2, 5, 7)], "pos long")
    assert sorted((r.pos, r.quarter) for r in fundamentals.shown_quarter(c, p).collect()) == [(2, 8), (5, 9), (7, 9)]


def test_bootstrap_paths(spark):
    s = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "k string, pos long, log_return double")
    starts = spark.createDataFrame([("a", 0, 0, 2), ("a", 0, 1, 5)], "k string, draw int, k2 int, start int").withColumnRenamed("k2", "j")
    starts = starts.select("k", "draw", F.col("j").alias("n"), "start")
    lengths = s.groupBy("k").agg(F.count("*").alias("n"))
    own = evaluation.bootstrap_starts(lengths.withColumnRenamed("k", "key"), "key", 50, 6, 4, 1)
    assert own.where("start < 0 or start > 6").isEmpty() and own.count() == 100
    paths = evaluation.block_bootstrap(s.withColumnRenamed("k", "key"), starts.toDF("key", "draw", "k", "start"), "key", 6, 4)
    assert [r.log_return for r in paths.orderBy("i").collect()] == [2.0, 3.0, 4.0, 5.0, 5.0, 6.0]


def test_breakeven(spark):
    g = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 1.0), ("a", 2.0, -1.0), ("b", 0.0, -1.0), ("b", 1.0, 1.0), ("c", 0.0, 1.0)], "k string, cost double, value double")
    assert {r.k: r.breakeven for r in audit.breakeven(g, "k").collect()} == {"a": 1.5, "b": 0.0, "c": None}


def test_hash_chain(spark):
    r = spark.createDataFrame([(1, i, f"p{i}") for i in range(4)], "k long, i long, p string")
    chain = evaluation.hash_chain(r, "k", "i", F.col("p"))
    assert evaluation.chain_breaks(chain, "k", "i", F.col("p")).isEmpty()
    bad = chain.withColumn("p", F.when(F.col("i") == 2, "x").otherwise(F.col("p")))
    assert [x.i for x in evaluation.chain_breaks(bad, "k", "i", F.col("p")).collect()] == [2]


def test_bootstrap_outcomes_equal_paths(spark):
    s = spark.createDataFrame([(k, i, ((i * 7919 + len(k) * 31) % 101 - 50) / 400.0 + 0.000123) for k, n in (("a", 90), ("bb", 63), ("short", 62)) for i in range(n)], "k string, pos long, log_return double")
    s = s.withColumnRenamed("k", "key")
    starts = evaluation.bootstrap_starts(s.groupBy("key").agg(F.count("*").alias("n")), "key", 30, 200, 63, 7)
    want = evaluation.growth_profile(evaluation.block_bootstrap(s, starts, "key", 200, 63), "key", 0.05, -0.3).orderBy("key").collect()
    got = evaluation.outcome_profile(evaluation.bootstrap_outcomes(s, "key", 30, 200, 63, 7, chunk=8), "key", 0.05, -0.3).orderBy("key").collect()
    assert [r.key for r in got] == ["a", "bb"]
    for a, b in zip(got, want, strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), abs=1e-12)


def test_bootstrap_profile_draws(spark):
    got = market.QUERIES["bootstrap_profile"](spark, SF).select("draws").distinct().collect()
    assert [r.draws for r in got] == [4000]


def test_paired_outcomes_equal_paths(spark):
    x = {("a", i): (((i * 7919) % 101 - 50) / 400.0 + 0.000123, ((i * 6007) % 97 - 40) / 300.0) for i in range(90)}
    pairs = spark.createDataFrame([(k, i, *v) for (k, i), v in x.items()], "key string, pos long, a double, b double")
    starts = evaluation.bootstrap_starts(pairs.groupBy("key").agg(F.count("*").alias("n")), "key", 20, 200, 63, 7).orderBy("draw", "k").collect()
    want = {}
    for d in range(20):
        at = [r.start + o for r in starts if r.draw == d for o in range(63)][:200]
        path = [[x["a", i][c] for i in at] for c in (0, 1)]
        growth = [sum(p) / 200 * 252 for p in path]
        tail = [sum(sorted(sum(p[j * 14 : j * 14 + 14]) for j in range(14))[:3]) / 3 for p in path]
        want[d] = (growth[0] - growth[1], tail[0] - tail[1])
    got = {r.draw: (r.growth, r.tail) for r in evaluation.paired_outcomes(pairs, "key", "a", "b", 20, 200, 63, 7, 14, 0.2, chunk=8).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def test_paired_query(spark):
    got = market.QUERIES["paired_growth_tail_delta"](spark, SF).collect()
    assert got and all(r.draws == 4000 and r.growth_lower <= r.growth_mean <= r.growth_upper and r.tail_lower <= r.tail_upper for r in got)


def test_every_session_has_its_quarter(spark):
    got = market.QUERIES["shown_quarter"](spark, SF).toPandas()
    facts = research._facts(spark, SF).groupBy("company_id", "quarter").agg(F.max("avail_pos").alias("p")).collect()
    last, known = int(got.pos.max()), {}
    for r in facts:
        known.setdefault(r.company_id, []).append((r.p, r.quarter))
    want = {(c, pos, max(q for p, q in ks if p <= pos)) for c, ks in known.items() for pos in range(min(p for p, _ in ks), last + 1)}
    assert set(zip(got.company_id.tolist(), got.pos.tolist(), got.quarter.tolist(), strict=True)) == want


def test_notice_word_in_a_later_line(spark, tmp_path):
    spark.createDataFrame([(1, "A notice\nThe shares are delisted."), (2, "A notice\nNothing.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.kind, r.n) for r in market.QUERIES["action_kinds"](spark, str(tmp_path)).collect()} == {("delisting", 1), ("other", 1)}
