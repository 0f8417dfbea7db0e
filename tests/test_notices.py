"""Notices, filings, corporate actions and benchmarks on made cases."""

import zlib
from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import notices


def test_shards_are_those_of_any_process(spark):
    keys = ["a", "", "00126380:2019:11011", "é", None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", notices.shard_of(F.col("k"), 7).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: None if k is None else zlib.crc32(k.encode()) % 7 for k in keys}


def test_forms_and_titles(spark):
    cases = [("[정정] 관리종목 지정해제(회생절차 종결결정)", "관리종목지정해제"), (None, ""), ("상장 폐지", "상장폐지")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", notices.notice_form(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: f for i, (_, f) in enumerate(cases)}
    d = [("[기재정정][기재정정]현금ㆍ현물배당 결정", True), ("현금·현물배당결정", True), ("현금.현물배당결정", True), ("현물배당결정", False), (None, False)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(d)], "i int, t string").select("i", notices.is_dividend_decision(F.col("t")).alias("d")).collect()
    assert {r.i: r.d for r in got} == {i: x for i, (_, x) in enumerate(d)}


def test_notice_dedupe(spark):
    rows = [("n1", "old", "t", 1, "w1"), ("n1", "new", "t", 2, "w0"), ("n2", "a", "t", 1, "w"), ("n2", "a", None, 1, "w"), ("n3", "a", None, 1, "x"), ("n3", "b", None, 1, "y")]
    kept, bad = notices.notice_dedupe(spark.createDataFrame(rows, "n string, name string, title string, at int, w string"), "n", "name", ["at", "w"])
    assert sorted((r.n, r["name"], r.title) for r in kept.collect()) == [("n1", "new", "t"), ("n3", "b", None)] and [r.n for r in bad.collect()] == ["n2"]


def test_relevant_identities(spark):
    ids = spark.createDataFrame([("c1", "2019", "11011"), ("c1", "2020", "11011"), ("c1", "2021", "11011"), ("c2", "2020", "11011"), ("c9", "2020", "11011")], "company_id string, year string, report_code string")
    bridge = spark.createDataFrame([("c1", "t1"), ("c2", "t2")], "company_id string, ticker string")
    universe = spark.createDataFrame([("t1", date(2020, 5, 1), True), ("t1", date(2022, 5, 1), False), ("t2", date(2019, 1, 1), True)], "ticker string, session date, eligible boolean")
    assert {(r.company_id, r.year) for r in notices.relevant_identities(ids, bridge, universe).collect()} == {("c1", "2019"), ("c1", "2020")}


def test_release_benchmark(spark):
    rel = [(1, 7, "op", "consolidated", "annual", 101.0), (1, 7, "op", "consolidated", "quarter", 900.0), (1, 6, "op", "consolidated", "quarter", 104.0), (1, 5, "op", "consolidated", "quarter", 0.0), (1, 4, "op", "consolidated", "quarter", 5.0), (2, 6, "op", "separate", "quarter", 1.0), (2, 6, "op", "consolidated", "quarter", None)]
    facts = [(1, 7, "op", 100.0), (1, 6, "op", 100.0), (1, 5, "op", 0.0), (1, 4, "op", 0.0), (2, 6, "op", 1.0)]
    got = notices.release_benchmark(spark.createDataFrame(rel, "company_id int, quarter int, metric string, basis string, span string, value double"), spark.createDataFrame(facts, "company_id int, quarter int, metric string, value double"), ["op", "ni"])
    assert {r.metric: (r.matched, r.within_1pct, r.within_5pct, round(r.median_error, 9)) for r in got.collect()} == {"op": (4, 0.5, 0.75, 0.01), "ni": (0, 0.0, 0.0, 0.0)}


def test_nothing_to_compare(spark):
    labels = spark.createDataFrame([], "filing int, fact string, basis string, value long")
    parsed = spark.createDataFrame([], "filing int, place int, fact string, basis string, value long")
    assert [tuple(r) for r in notices.document_benchmark(parsed, labels).collect()] == [(0, 0, 0, None, None)]
