"""Lineage, staleness, raw pages, files, industries and the stream of session gaps on made cases."""

import json
import os
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import lineage, silver
from tidemark.sources import pages
from tidemark.streaming import events


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def reached(spark, pairs, roots):
    got = lineage.reachable(edges(spark, pairs), spark.createDataFrame([(r,) for r in roots], "id string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_reachable(spark):
    assert reached(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")], ["a"]) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert reached(spark, [("a", "b"), ("b", "a"), ("a", "a"), (None, "z"), ("b", None)], ["a", "a", None]) == {"a": 0, "b": 1}
    assert reached(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)], ["n0", "n5"]) == {f"n{i}": min(i, i - 5 if i >= 5 else i) for i in range(13)}
    assert reached(spark, [], []) == {}


def test_stale_datasets(spark):
    schema = "kind string, identity struct<layer:string,policy:string,inputs:map<string,string>,params:map<string,string>>"

    def of(kind, policy="v1", inputs=None, params=None):
        return (kind, ("gold", policy, inputs or {"a": "1", "b": "2"}, params or {"n": "5", "decision_time": kind}))

    expected = [of("raw"), of("bars"), of("panel"), of("cube"), of("flows", inputs={"a": "1"}), of("alone"), ("unread", None), of("moved", params={"n": "5", "decision_time": "now"}), of("size", params={"n": "6"})]
    registry = [of("raw"), of("panel"), of("cube"), of("flows"), of("alone"), of("unread"), of("moved", inputs={"b": "2", "a": "1"}), of("size"), of("gone")]
    up = [("bars", "raw"), ("panel", "bars"), ("cube", "panel"), ("panel", "cube"), ("moved", "raw")]
    stale, unknown = lineage.stale_datasets(spark.createDataFrame(expected, schema), spark.createDataFrame(registry, schema), spark.createDataFrame(up, "kind string, input string"))
    assert {r.kind: (r.reason, r.depth) for r in stale.collect()} == {
        "bars": ("unregistered", 0), "flows": ("identity_differs", 0), "unread": ("identity_differs", 0), "size": ("identity_differs", 0), "panel": ("upstream_stale", 1), "cube": ("upstream_stale", 2),
    }
    assert [r.kind for r in unknown.collect()] == ["gone"]


def test_raw_pages(spark):
    d = date(2020, 1, 2)
    good = [{"day": "20200102", "code": " A ", "price": 1.5}, {"day": "2020-01-02", "code": "B"}]
    cases = {
        1: json.dumps({"records": good, "more": 1}), 2: "{", 3: None, 4: "[]", 5: json.dumps({"records": []}), 6: json.dumps({"records": [{"day": "20200103", "code": "A"}]}), 7: json.dumps({"records": [{"day": "20200102"}]}),
        8: json.dumps({"records": [good[0], {"day": "20200102", "code": "A"}]}), 9: json.dumps({"records": [None]}), 10: json.dumps({"records": {"day": "20200102"}}), 11: "", 12: json.dumps({"records": [{"code": "A"}]}),
    }
    frame = spark.createDataFrame([(d + timedelta(days=0), p, i) for i, p in cases.items()], "session date, payload string, i int")
    want = {2: "malformed", 3: "malformed", 4: "malformed", 5: "empty", 6: "wrong_day", 7: "lacks_key", 8: "repeated_key", 9: "malformed", 10: "malformed", 11: "malformed", 12: "wrong_day"}
    for i, payload in cases.items():
        rows, bad = pages.scan_raw_pages(frame.where(F.col("i") == i), "day string, code string, price double", "day", "code")
        assert [r.reason for r in bad.collect()] == ([want[i]] if i in want else []), payload
        assert sorted((r.code, r.price) for r in rows.collect()) == ([("A", 1.5), ("B", None)] if i == 1 else [])


def test_files(spark, tmp_path):
    for name, age in (("a/x.json", 40), ("a/y.json", 3), ("packs/z.json", 90), ("w", 16)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"12345")
        then = (datetime(2026, 1, 1) - timedelta(days=age)).timestamp()
        os.utime(path, (then, then))
    found = pages.files(spark, str(tmp_path))
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    old = pages.stale_files(found, F.to_timestamp(F.lit("2026-01-01")), 15, ("packs",))
    assert {(os.path.basename(r.path), r.age_days) for r in old.collect()} == {("x.json", 40), ("w", 16)}
    assert [tuple(r) for r in pages.footprint(found, 19).collect()] == [(4, 20, True)] and not pages.footprint(found, 20).first().over
    assert pages.footprint(found.limit(0), 1).first().bytes == 0


def test_page_headers(spark):
    body = json.dumps({"status": "000", "records": [{"receipt": "R1", "account": "x", "statement": "BS"}, {"receipt": "R2"}]})
    got = pages.page_headers(spark.createDataFrame([("00126380:2019:11011:multi", body), ("1:x", "nothing"), ("2:2020:11013:single", json.dumps({"status": "013"}))], "natural_key string, payload string"))
    assert {tuple(r)[1:] for r in got.collect()} == {("multi", "000", "11011", 2019, "R1", True, True), (None, None, None, None, None, False, False), ("single", "013", "11013", 2020, None, False, False)}


def test_industry_snapshot(spark):
    q = [("a", 1, "h2", "I1", "K"), ("a", 1, "h1", "I9", "K"), ("b", 5, "h", "I1", "Q"), ("d", 1, "h", "I2", "K"), ("e", 1, "h", "I3", "K")]
    s = [("a", 2, "s", "C1"), ("b", 3, "s", "C1"), ("c", 1, "s1", "C1"), ("c", 1, "s0", "C2"), ("d", 1, "s", "C2"), ("e", 1, "s", "C2"), ("f", 1, "s", "C2"), ("g", 9, "s", "C7")]
    got = silver.industry_snapshot(spark.createDataFrame(q, "ticker string, collected_at int, hash string, industry string, market string"), spark.createDataFrame(s, "ticker string, collected_at int, hash string, code string"))
    assert {r.ticker: (r.industry, r.basis, r.code, r.support, r.available, r.source) for r in got.collect()} == {
        "a": ("I1", "observed", "C1", None, 2, "h2"), "b": ("I1", "observed", "C1", None, 5, "h"), "c": ("I1", "inferred", "C1", 2, 1, "s1"), "d": ("I2", "observed", "C2", None, 1, "h"),
        "e": ("I3", "observed", "C2", None, 1, "h"), "f": (None, "unmapped", "C2", None, 1, "s"), "g": (None, "unmapped", "C7", None, 9, "s"),
    }


def test_session_gaps_in_any_order_of_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(datetime(2024, 1, 1 + i % 9, rng.randrange(24)), i % 9, i % 4) for i in range(60) if i % 9 != 4]
    calendar = spark.createDataFrame([(i,) for i in range(9)], "session int")
    want = {s: len({k for _, t, k in rows if t == s}) for s in range(9)}
    for run in range(2):
        rng.shuffle(rows)
        folder = tmp_path / str(run)
        for i in range(0, len(rows), 15):
            spark.createDataFrame(rows[i : i + 15], "ts timestamp, session int, key int").coalesce(1).write.mode("append").parquet(str(folder))

        def stream(at=folder):
            return spark.readStream.schema("ts timestamp, session int, key int").option("maxFilesPerTrigger", 1).parquet(str(at))

        got = {r.session: r.arrived for r in events.session_gaps(stream(), ["session", "key"], "session", "60 days", calendar).collect()}
        assert got == want and got[4] == 0
        pending = events.pending_after_each(stream(), ["session", "key"], "session", "60 days", calendar)
        last = pending.agg(F.max("batch")).first()[0]
        assert last >= 3 and [r.session for r in pending.where(F.col("batch") == last).collect()] == [4]
        sizes = [pending.where(F.col("batch") == b).count() for b in range(last + 1)]
        assert sizes == sorted(sizes, reverse=True)
        newest = events.latest_receipts(stream(), ["key"], "ts", "session").collect()
        assert {r.key: (r.ts, r.session) for r in newest} == {k: max((t, s) for t, s, j in rows if j == k) for k in {j for _, _, j in rows}}
