"""Notices, filings, coverage and benchmarks over the shared tables, and their SQL. Orders play filings, their keys' digits their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import forms as O
from tidemark.operators import notices as N
from tidemark.plans.pit import FACTS, _facts, _known
from tidemark.sources import tables as T

#: Titles with their release kind and whether they are a dividend decision.
TITLES = [
    ("[기재정정] 연결재무제표기준 영업(잠정)실적 (공정공시)", "preliminary", False), ("매출액 또는 손익구조 30% 이상 변동", "profit_change", False), ("자회사의 주요경영사항 영업(잠정)실적", None, False), ("현금ㆍ현물 배당 결정", None, True),
    ("[기재정정]현금·현물배당결정", None, True), ("현금배당결정", None, True), ("현금배당결정 (자회사)", None, False), ("영업실적 등에 대한 전망 매출액또는손익구조 변경", None, False), ("매출액또는손익구조", None, False), ("", None, False),
]
FORMS = ["관리종목 지정", "상장폐지(주권)", "[정정]관리종목지정해제(회생절차 종결결정)", "관리종목 지정사유 추가", "매매거래정지"]
WANTED = ["관리종목지정", "상장폐지", "관리종목지정해제"]
REPORTS = ["사업보고서", "반기보고서", "분기보고서", "[기재정정]사업보고서", "주요사항보고서"]
MONTHS = ["03", "06", "09", "12"]


def _of(values, index):
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def notice_titles(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(_of([t for t, *_ in TITLES], F.col("o_orderkey") % len(TITLES)).alias("title"))
    return o.groupBy("title", N.release_kind(F.col("title")).alias("kind"), N.is_dividend_decision(F.col("title")).alias("dividend")).agg(F.count("*").alias("n"))


def _notices(spark, sf_dir):
    k = F.col("o_orderkey")
    key = k % 3000
    return T.table(spark, sf_dir, "orders").select(
        key.alias("notice"), F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")).alias("company_name"), F.when(key % 50 == 0, k % 11).otherwise(key % 7).alias("submitter_code"),
        F.when(key % 3 == 0, "x").alias("note"), F.col("o_orderdate").alias("retrieved_at"), k.alias("window_key"),
    )


def notice_dedupe(spark, sf_dir):
    return N.notice_dedupe(_notices(spark, sf_dir), "notice", "company_name", ["retrieved_at", "window_key"])[0]


def notice_contradictions(spark, sf_dir):
    return N.notice_dedupe(_notices(spark, sf_dir), "notice", "company_name", ["retrieved_at", "window_key"])[1]


def document_targets(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select((k % 4000).alias("notice"), k.alias("place"), _of(FORMS, F.expr("o_orderkey div 7") % 5).alias("title"), _of(["유가증권시장본부", "주식회사"], F.expr("o_orderkey div 3") % 2).alias("submitter"))
    return N.document_targets(rows, WANTED, "notice", "place")


def _identities(spark, sf_dir):
    k = F.col("o_orderkey")
    title = F.concat(_of(REPORTS, k % 5), F.when(k % 17 != 0, F.concat(F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit("."), _of(MONTHS, F.expr("o_orderkey div 5") % 4), F.lit(")"))).otherwise(F.lit("")))
    filed = T.table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("company_id"), (F.expr("o_orderkey div 2") * 2).cast("string").alias("filing_id"), title.alias("title"), F.to_date("o_orderdate").alias("received"))
    return N.periodic_identities(filed)


def periodic_identities(spark, sf_dir):
    return _identities(spark, sf_dir)


def relevant_identities(spark, sf_dir):
    bridge = T.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("company_id"), (F.col("c_custkey") % 100 + 1).alias("ticker"))
    universe = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("session"), (F.year("l_shipdate") % 3 == F.col("l_suppkey") % 3).alias("eligible"))
    return N.relevant_identities(_identities(spark, sf_dir), bridge, universe)


def coverage_gaps(spark, sf_dir):
    """Quarters that are over by the end of 2000, of each customer segment; an answer is complete on three days in four."""
    o = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    end = F.date_sub(F.add_months(start, 3), 1)
    windows = o.select(start.alias("start"), end.alias("end")).distinct()
    answers = o.where("o_orderkey % 97 = 0").select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("subject"), start.alias("start"), end.alias("end"), (F.col("o_orderkey") % 4 != 1).alias("complete"))
    subjects = o.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("subject"))
    return N.coverage_gaps(windows, subjects, answers, F.to_date(F.lit("2000-12-31")))


def _records(spark, sf_dir):
    k = F.col("o_orderkey")
    return T.table(spark, sf_dir, "orders").select(
        k.alias("place"), F.when(k % 61 != 0, F.col("o_custkey") % 50).alias("instrument_id"), F.to_date("o_orderdate").alias("effective"), (k % 3).cast("string").alias("action_id"),
        _of(["split", "dividend", "bonus_issue", "no_action", "tender", "merger"], k % 6).alias("type"), _of(["verified", "unresolved", None, "maybe", "verified"], k % 5).alias("status"),
        _of([None, " ", "why"], k % 7 % 3).alias("reason"), F.when(k % 4 != 0, F.to_date("o_orderdate")).alias("listing"), F.when(k % 9 != 0, k).alias("delta"),
    )


def corporate_actions(spark, sf_dir):
    return N.corporate_actions(_records(spark, sf_dir))[0]


def corporate_violations(spark, sf_dir):
    return N.corporate_actions(_records(spark, sf_dir))[1].groupBy("violation").agg(F.count("*").alias("n"), F.max("place").alias("last"))


def pending_bars(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"), "l_suppkey", "l_linenumber")
    row = F.struct(F.lpad(F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 11 == 0, 5).otherwise(6), F.lit("0")).alias("code"), F.when(F.col("l_suppkey") % 4 == 0, "bond").otherwise("stock").alias("kind"))
    masters = li.groupBy("session").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload")).withColumn("status", F.when(F.dayofyear("session") % 9 == 0, "error").otherwise("success"))
    answered = li.where("l_linenumber = 1").select("session", F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ticker"))
    return N.pending_bars(masters, answered, ["stock"])


def sharded_units(spark, sf_dir):
    """Customers by shard; CRC-32 is no function of SQL engines, so a test compares shards with another implementation."""
    c = T.table(spark, sf_dir, "customer").select("c_custkey", N.shard_of(F.col("c_custkey"), 8).alias("shard"))
    return c.groupBy("shard").agg(F.count("*").alias("units"), F.max("c_custkey").alias("last"))


def release_benchmark(spark, sf_dir):
    k, annual = _known(spark, sf_dir).where("version % 2 = 0"), F.col("quarter") % 4 == 3
    value = F.col("value") * F.when(F.col("version") % 5 == 0, 1.004).when(F.col("version") % 3 == 0, 1.04).otherwise(1.0)
    span = F.when(annual, F.when(F.col("version") % 8 == 0, "quarter").otherwise("annual")).otherwise(F.when(F.col("version") % 8 == 2, "cumulative").otherwise("quarter"))
    releases = k.select("company_id", "quarter", F.col("fact").alias("metric"), "basis", span.alias("span"), value.alias("value"))
    got = N.release_benchmark(releases, _facts(spark, sf_dir).withColumnRenamed("fact", "metric"), ["sales", "op", "none"])
    return got.select("metric", "matched", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("within_1pct", "within_5pct", "median_error")))


def document_benchmark(spark, sf_dir):
    k = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders").select((k % 900).alias("filing"), k.alias("place"), (k % 7).cast("string").alias("fact"), F.when(k % 2 == 0, "stock").otherwise("flow").alias("basis"), F.col("o_custkey"))
    labels = o.where("o_custkey % 3 <> 0").select("filing", "fact", "basis", F.when(F.col("filing") % 10 == 0, F.col("place") % 4).otherwise(F.col("filing") * 3).alias("value"))
    parsed = o.where("filing % 4 <> 1 and o_custkey % 5 <> 0").select("filing", "place", "fact", "basis", (F.col("filing") * 3 + F.when(F.col("place") % 13 == 0, 1).otherwise(0)).alias("value"))
    got = N.document_benchmark(parsed, labels)
    return got.select("labels", "compared", "exact", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("precision", "coverage")))


def _bodies(spark, sf_dir):
    """Delisting forms of orders: digits of the key tell what a form lacks, how it writes a date and whether it has a period."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")

    def shown(day):
        return F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyy.MM.dd")).otherwise(F.date_format(day, "yyyy년 MM월 dd일"))

    code = F.when(k % 11 == 0, F.lit("<td>코드 없음</td>")).when(k % 11 == 1, F.concat(F.lit("<td>종목코드 : KR7"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("003</td>"))).otherwise(
        F.concat(F.lit("<td>단축코드</td><td>A"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(" <b>A00000X</b></td><td>상장폐지 사유 A999999 등</td>"))
    )
    period = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<p>정리매매 허용기간<br>시작일 "), shown(d), F.when(k % 13 != 0, F.concat(F.when(k % 2 == 0, "&nbsp;종료일 ").otherwise(" 만료일: "), shown(F.date_add(d, 10)))).otherwise(""), F.lit("</p>")))
    day = F.when(k % 17 == 0, "").when(k % 7 == 0, "<p>상장폐지일 : -</p>").otherwise(F.concat(F.lit("<p>상장폐지일 "), shown(F.date_add(d, 11)), F.lit("</p>")))
    day = F.when(k % 7 == 0, F.when(k % 17 == 0, "").otherwise("<p>상장폐지일 -</p>")).otherwise(day)
    return T.table(spark, sf_dir, "orders").select(k.alias("notice"), F.concat(F.lit("<html>"), code, period, day).alias("html"))


def delisting_forms(spark, sf_dir):
    forms, _ = O.delisting_forms(_bodies(spark, sf_dir))
    return forms.withColumn("tickers", F.array_join("tickers", ","))


def unread_forms(spark, sf_dir):
    _, unread = O.delisting_forms(_bodies(spark, sf_dir))
    return unread


#: Account ids and labels with the fact that they should give.
ACCOUNTS = [
    ("ifrs-full_Assets", "x", "assets"), (None, "I. 매출액 (주석 29)", "sales"), ("", "(1)영업이익", "operating_profit"), (" dart_Revenue ", None, "sales"), ("other", "가. 유형자산의 취득", "capex"), ("other", "[자본총계]", "equity"),
    ("other", "자산총계 및 부채", None), ("ifrs-full_Equity", "자산총계", "equity"), (None, "수익(매출액)", None), (None, None, None),
]


def account_facts(spark, sf_dir):
    n = F.col("o_orderkey") % len(ACCOUNTS)
    o = T.table(spark, sf_dir, "orders").select(_of([a for a, *_ in ACCOUNTS], n).alias("account_id"), _of([b for _, b, _ in ACCOUNTS], n).alias("label"))
    return o.groupBy("account_id", "label", O.account_fact(F.col("account_id"), F.col("label")).alias("fact")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    notice_titles, notice_dedupe, notice_contradictions, document_targets, periodic_identities, relevant_identities, coverage_gaps, corporate_actions, corporate_violations, pending_bars, sharded_units,
    release_benchmark, document_benchmark, delisting_forms, unread_forms, account_facts,
)}


def _list(words) -> str:
    return "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in words) + "]"


_TITLE_ROWS = ", ".join(f"({i}, '{t}', {'NULL' if k is None else repr(k)}, {str(d).lower()})" for i, (t, k, d) in enumerate(TITLES))
NOTICES = """n0 AS (SELECT o_orderkey % 3000 AS notice, 'c' || o_custkey % 9 AS company_name, CASE WHEN o_orderkey % 3000 % 50 = 0 THEN o_orderkey % 11 ELSE o_orderkey % 3000 % 7 END AS submitter_code,
  CASE WHEN o_orderkey % 3000 % 3 = 0 THEN 'x' END AS note, o_orderdate, o_orderkey FROM orders),
n1 AS (SELECT *, max(submitter_code) OVER (PARTITION BY notice) <> min(submitter_code) OVER (PARTITION BY notice) AS bad FROM n0)"""
IDENTITIES = f"""i0 AS (SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(o_orderkey // 2 * 2 AS VARCHAR) AS filing_id, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey % 5 AS r, o_orderkey // 5 % 4 AS m, CAST(o_orderdate AS DATE) AS published
  FROM orders WHERE o_orderkey % 17 <> 0),
i1 AS (SELECT *, CASE WHEN r IN (0, 3) THEN '11011' WHEN r = 1 THEN '11012' WHEN r = 2 AND m = 0 THEN '11013' WHEN r = 2 AND m = 2 THEN '11014' END AS report_code FROM i0),
id AS (SELECT DISTINCT company_id, filing_id, year, report_code, year || 'Q' || CASE report_code WHEN '11011' THEN 4 WHEN '11012' THEN 2 WHEN '11013' THEN 1 ELSE 3 END AS fiscal_period, published FROM i1 WHERE report_code IS NOT NULL)"""
RECORDS = """c0 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 61 <> 0 THEN o_custkey % 50 END AS instrument_id, CAST(o_orderdate AS DATE) AS effective, CAST(o_orderkey % 3 AS VARCHAR) AS action_id,
  list_extract(['split', 'dividend', 'bonus_issue', 'no_action', 'tender', 'merger'], CAST(o_orderkey % 6 AS INTEGER) + 1) AS type, list_extract(['verified', 'unresolved', NULL, 'maybe', 'verified'], CAST(o_orderkey % 5 AS INTEGER) + 1) AS status,
  list_extract([NULL, ' ', 'why'], CAST(o_orderkey % 7 % 3 AS INTEGER) + 1) AS reason FROM orders),
c1 AS (SELECT *, CASE WHEN k % 6 = 4 THEN 'unsupported_type' WHEN k % 6 = 2 AND (k % 4 = 0 OR k % 9 = 0) THEN 'bonus_without_listing' WHEN k % 6 = 3 OR status IS NULL THEN 'no_evidence' WHEN status = 'maybe' THEN 'unknown_status'
  WHEN status = 'verified' AND reason = 'why' THEN 'verified_with_reason' WHEN status = 'unresolved' AND coalesce(reason, '') <> 'why' THEN 'unresolved_without_reason' WHEN instrument_id IS NULL THEN 'no_instrument' END AS violation FROM c0)"""
FORM = """d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT k AS notice, CASE WHEN k % 11 = 0 THEN '' WHEN k % 11 = 1 THEN lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') ELSE lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || ',00000X' END AS tickers,
  CASE WHEN k % 5 <> 0 THEN d END AS liquidation_start, CASE WHEN k % 5 <> 0 AND k % 13 <> 0 THEN d + 10 END AS liquidation_end, CASE WHEN k % 17 <> 0 AND k % 7 <> 0 THEN d + 11 END AS delisting_date,
  CASE WHEN k % 11 = 0 THEN 'no_code' WHEN k % 17 = 0 THEN 'no_day' WHEN k % 5 <> 0 AND k % 13 = 0 THEN 'half_a_period' END AS reason FROM d)"""
_SUBJECT = "c_mktsegment || '-' || c_nationkey"

SQL = {
    "notice_titles": f"WITH t(i, title, kind, dividend) AS (VALUES {_TITLE_ROWS}) SELECT title, kind, dividend, count(*) AS n FROM orders JOIN t ON i = o_orderkey % {len(TITLES)} GROUP BY ALL",
    "notice_dedupe": f"WITH {NOTICES} SELECT notice, company_name, submitter_code, note FROM n1 WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY notice ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "notice_contradictions": f"WITH {NOTICES} SELECT DISTINCT notice FROM n1 WHERE bad",
    "document_targets": f"""WITH d AS (SELECT o_orderkey % 4000 AS notice, o_orderkey AS place, o_orderkey // 7 % 5 AS f, '유가증권시장본부' AS submitter FROM orders WHERE o_orderkey // 3 % 2 = 0)
SELECT notice, place, list_extract({_list(FORMS)}, CAST(f AS INTEGER) + 1) AS title, submitter FROM d WHERE f < 3 QUALIFY row_number() OVER (PARTITION BY notice ORDER BY place) = 1""",
    "periodic_identities": f"WITH {IDENTITIES} SELECT * FROM id",
    "relevant_identities": f"""WITH {IDENTITIES}, u AS (SELECT DISTINCT l_suppkey AS ticker, year(l_shipdate) AS y FROM lineitem WHERE year(l_shipdate) % 3 = l_suppkey % 3)
SELECT DISTINCT company_id, year, report_code FROM id JOIN customer ON CAST(c_custkey AS VARCHAR) = company_id AND c_custkey % 4 <> 0
WHERE EXISTS (SELECT 1 FROM u WHERE u.ticker = c_custkey % 100 + 1 AND (u.y = CAST(year AS INTEGER) OR u.y = CAST(year AS INTEGER) + 1))""",
    "coverage_gaps": f"""WITH o AS (SELECT {_SUBJECT} AS subject, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT s.subject, w.start, CAST(w.start + INTERVAL 3 MONTH AS DATE) - 1 AS "end" FROM (SELECT DISTINCT subject FROM o) s, (SELECT DISTINCT start FROM o WHERE start < DATE '2001-01-01') w
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.subject = s.subject AND o.start = w.start AND k % 97 = 0 AND k % 4 <> 1)""",
    "corporate_actions": f"""WITH {RECORDS} SELECT instrument_id, effective, action_id, k AS place, type, status, reason, CASE WHEN k % 4 <> 0 THEN effective END AS listing, CASE WHEN k % 9 <> 0 THEN k END AS delta FROM c1 WHERE violation IS NULL
QUALIFY row_number() OVER (PARTITION BY instrument_id, effective, action_id ORDER BY k) = 1""",
    "corporate_violations": f"WITH {RECORDS} SELECT violation, count(*) AS n, max(k) AS last FROM c1 WHERE violation IS NOT NULL GROUP BY violation",
    "pending_bars": """WITH l AS (SELECT CAST(l_shipdate AS DATE) AS session, l_suppkey AS s, bool_or(l_linenumber = 1) AS done FROM lineitem GROUP BY ALL)
SELECT session, lpad(CAST(s AS VARCHAR), 6, '0') AS ticker FROM l WHERE NOT done AND s % 4 <> 0 AND s % 11 <> 0 AND dayofyear(session) % 9 <> 0""",
    "release_benchmark": f"""WITH {FACTS}, r AS (SELECT company_id, quarter, fact AS metric, value * CASE WHEN version % 5 = 0 THEN 1.004::DOUBLE WHEN version % 3 = 0 THEN 1.04::DOUBLE ELSE 1.0::DOUBLE END AS value FROM kn
  WHERE version % 2 = 0 AND basis = 'consolidated' AND CASE WHEN quarter % 4 = 3 THEN version % 8 <> 0 ELSE version % 8 <> 2 END),
e AS (SELECT metric, abs(r.value - qf.value) / abs(qf.value) AS e FROM r JOIN qf ON qf.company_id = r.company_id AND qf.quarter = r.quarter AND qf.fact = r.metric)
SELECT m.metric, count(e) AS matched, coalesce(floor(avg(CASE WHEN e <= 0.01 THEN 1.0::DOUBLE WHEN e IS NOT NULL THEN 0 END) * 1e6 + 0.5) / 1e6, 0) AS within_1pct,
  coalesce(floor(avg(CASE WHEN e <= 0.05 THEN 1.0::DOUBLE WHEN e IS NOT NULL THEN 0 END) * 1e6 + 0.5) / 1e6, 0) AS within_5pct, coalesce(floor(quantile_cont(e, 0.5) * 1e6 + 0.5) / 1e6, 0) AS median_error
FROM (VALUES ('sales'), ('op'), ('none')) m(metric) LEFT JOIN e ON e.metric = m.metric GROUP BY m.metric""",
    "document_benchmark": """WITH o AS (SELECT o_orderkey % 900 AS f, o_orderkey AS k, o_orderkey % 7 AS fact, o_orderkey % 2 AS b, o_custkey AS c FROM orders),
l AS (SELECT f, fact, b, any_value(v) AS v FROM (SELECT f, fact, b, CASE WHEN f % 10 = 0 THEN k % 4 ELSE f * 3 END AS v FROM o WHERE c % 3 <> 0) GROUP BY ALL HAVING count(DISTINCT v) = 1),
p AS (SELECT f, fact, b, f * 3 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS v FROM o WHERE f % 4 <> 1 AND c % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY f, fact, b ORDER BY k) = 1),
n AS (SELECT count(*) AS labels, count(p.v) AS compared, count(*) FILTER (p.v = l.v) AS exact FROM l LEFT JOIN p USING (f, fact, b) WHERE f IN (SELECT f FROM p))
SELECT *, floor(exact / compared * 1e6 + 0.5) / 1e6 AS precision, floor(compared / labels * 1e6 + 0.5) / 1e6 AS coverage FROM n""",
}
_rows = ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else f"'{x}'" for x in r)]) + ")" for i, r in enumerate(ACCOUNTS))
SQL |= {
    "delisting_forms": f"WITH {FORM} SELECT notice, tickers, liquidation_start, liquidation_end, delisting_date FROM f WHERE reason IS NULL",
    "unread_forms": f"WITH {FORM} SELECT notice, reason FROM f WHERE reason IS NOT NULL",
    "account_facts": f"WITH a(i, account_id, label, fact) AS (VALUES {_rows}) SELECT account_id, label, fact, count(*) AS n FROM orders JOIN a ON i = o_orderkey % {len(ACCOUNTS)} GROUP BY ALL",
}
DATES = {"delisting_forms": ("liquidation_start", "liquidation_end", "delisting_date"), "periodic_identities": ("published",), "coverage_gaps": ("start", '"end"'), "corporate_actions": ("effective", "listing"), "pending_bars": ("session",)}
