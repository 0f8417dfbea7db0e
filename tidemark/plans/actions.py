"""Universe and market actions over the shared tables, and their SQL.

Orders play the filings and the exchange's notices: their key picks a title of the exchange's vocabulary, a company and an hour.
A supplier's trading day is its row on a daily page, and a day on which it took returns only is flagged. Parts play master rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import actions as A
from tidemark.operators import panel as P
from tidemark.operators import universe as U
from tidemark.plans.panel import BARS, panel
from tidemark.sources import tables as T

#: Titles that meet every rule of the classifier, each in one way at least.
TITLES = [
    "[기재정정] 주권 상장폐지 결정", "상장폐지결정 효력정지 가처분 결정 취소에 따른 정리매매 재개", "상장폐지 결정 철회", "상장폐지결정 효력정지 가처분 인용", "해외증권시장 상장폐지 결정", "코스닥시장 이전상장 결정",
    "주권 정리매매 개시", "매매거래정지 및 정지해제", "상장폐지 우려에 따른 매매거래정지", "상장폐지 여부 결정 안내", "관리종목 지정", "관리종목 지정사유 추가", "관리종목 지정해제", "관리종목지정사유일부해제",
    "투자주의환기종목 지정", "매매거래정지 해제", "주권매매거래정지", "자회사의 상장폐지 결정", "유상증자 결정", "", "상장폐지", "관리종목 지정 해제 (사유 해소)", "매매 거래재개", "상장폐지 무효 소송 가처분 신청",
]
DESKS = ["유가증권시장본부", "코스닥시장본부", "주식회사"]


def _orders(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    # Half a year earlier, so that some come before the first session.
    day = F.date_sub(F.to_date("o_orderdate"), 180)
    title = F.get(F.array(*map(F.lit, TITLES)), (F.expr("o_orderkey div 3") % len(TITLES)).cast("int"))
    return o.select("o_orderkey", "o_custkey", day.alias("day"), title.alias("title"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("receipt"))


def action_titles(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.groupBy("title", F.coalesce(A.action_kind(F.col("title")), F.lit("none")).alias("kind"), A.delisting_cancelled(F.col("title")).alias("cancelled")).agg(F.count("*").alias("n"))


def _pages(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("instrument_id")).distinct()


def _actions(spark, sf_dir):
    o = _orders(spark, sf_dir)
    filed = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("company_id"), "title", "receipt", F.col("day").alias("announced_on"))
    bridge = T.table(spark, sf_dir, "customer").where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") % 50 + 1).alias("instrument_id"))
    name = F.col("o_custkey") % 40 + 1
    notices = o.where("o_orderkey % 3 = 1").select(
        F.concat(F.lit("N"), "receipt").alias("receipt"), "title", F.get(F.array(*map(F.lit, DESKS)), (F.col("o_orderkey") % 7 % 3).cast("int")).alias("submitter"),
        F.when(F.col("o_orderkey") % 19 != 0, name).alias("instrument_id"), (F.col("day").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("disclosed_at"),
        F.array(name, name + 40).alias("listed_ids"), F.date_add("day", 8).alias("form_start"), F.date_add("day", (F.col("o_orderkey") % 5 * 10 - 5).cast("int")).alias("form_end"),
        (F.col("o_orderkey") % 4 != 0).alias("is_common"),
    )
    flags = T.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("instrument_id")).agg((F.min("l_returnflag") == "R").alias("flagged"))
    channels = [A.filed_actions(filed, bridge), A.exchange_actions(notices, _pages(spark, sf_dir)), A.flag_actions(flags)]
    return A.market_actions(channels, T.sessions(spark, sf_dir))


def market_actions(spark, sf_dir):
    return _actions(spark, sf_dir)


def coverage_staleness(spark, sf_dir):
    covered = T.table(spark, sf_dir, "orders").select(F.date_sub(F.to_date("o_orderdate"), 5).alias("covered_through"))
    return A.coverage_staleness(T.sessions(spark, sf_dir), covered, 300)


def entry_blocks(spark, sf_dir):
    return A.entry_blocks(_actions(spark, sf_dir), T.sessions(spark, sf_dir), cap=60)


def _master(spark, sf_dir):
    """A page of parts for each of the last days of four quarters; three digits of the key pick what is wrong with a row."""
    p, k = T.table(spark, sf_dir, "part"), F.col("p_partkey")
    days = F.array(*(F.to_date(F.lit(d)) for d in ("1997-03-31", "1997-06-30", "1997-09-30", "1997-12-31")))
    code = F.lpad(k.cast("string"), 6, "0")

    def one_of(values, by, n):
        return F.get(F.array(*map(F.lit, values)), (by % n).cast("int"))

    return p.select(
        F.explode(days).alias("session"), k.alias("part"), F.when(k % 501 == 0, F.lit(" ")).otherwise(F.when(k % 499 == 0, "000001").otherwise(code)).alias("ticker"),
        F.when(k % 503 == 0, "KR0000007").otherwise(F.concat(F.lit("KR"), code)).alias("isin"), F.date_add(F.to_date(F.lit("1996-06-01")), (k % 500).cast("int")).alias("listed_on"),
        one_of(["보통주", " 보통주 ", "우선주", "", None, "보통주", "보통주"], k, 7).alias("share_kind"), one_of(["주권", "주권", "투자회사", "", "주권"], k, 5).alias("security_group"),
        one_of(["KOSPI", "KOSDAQ", "KONEX", "", "KOSPI", "KOSDAQ", "KOSPI", "KOSDAQ", "KOSPI", "KOSDAQ", "KOSPI"], k, 11).alias("market"),
        F.when(k % 13 == 0, "spac부").alias("section"), F.when(k % 17 == 0, F.concat("p_name", F.lit(" 스팩 1호"))).otherwise(F.col("p_name")).alias("name"), F.col("p_name").alias("short_name"),
        F.when(k % 19 == 0, "some Spac Inc").alias("english_name"),
    )


def ordinary_universe(spark, sf_dir):
    rows, _ = U.universe_snapshot(_master(spark, sf_dir))
    return rows.select("session", "part", "eligible", "exclusion_reason", "available_at")


def universe_violations(spark, sf_dir):
    _, bad = U.universe_snapshot(_master(spark, sf_dir))
    return bad.select("session", "violation", F.trim("code").alias("code"))


def snapshot_completeness(spark, sf_dir):
    """Daily pages are the days of orders whose key ends in 1, one for each, against the calendar."""
    pages = T.table(spark, sf_dir, "orders").where("o_orderkey % 10 = 1").select(F.to_date("o_orderdate").alias("session"))
    return U.snapshot_completeness(pages, T.sessions(spark, sf_dir))


def current_universe(spark, sf_dir):
    rows, _ = U.universe_snapshot(_master(spark, sf_dir))
    return U.current_universe(rows)


def panel_universe(spark, sf_dir):
    """The panel with the eligibility of each trading day; a supplier has no universe row on days whose first line is its seventh."""
    li = T.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("instrument_id")).agg(F.min("l_linenumber").alias("first"), F.min("l_returnflag").alias("flag"))
    universe = li.where("first < 7").select("session", "instrument_id", (F.col("flag") != "R").alias("eligible"), F.when(F.col("flag") == "R", "non_ordinary_share").otherwise("eligible").alias("exclusion_reason"))
    return P.join_universe(panel(spark, sf_dir).select("session", "instrument_id", "close"), universe)


QUERIES = {f.__name__: f for f in (
    action_titles, market_actions, coverage_staleness, entry_blocks, ordinary_universe, universe_violations, snapshot_completeness, current_universe, panel_universe,
)}


def _sql_list(words) -> str:
    return "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in words) + "]"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_RESUMES = "(contains(cp, '정리매매') AND (contains(cp, '재개') OR contains(cp, '개시')) AND contains(cp, '상장폐지'))"
_HALT = "CASE WHEN (contains(b, '매매거래정지') AND contains(b, '해제')) OR contains(b, '거래재개') THEN 'trading_resumed' WHEN contains(b, '매매거래정지') THEN 'trading_halted' END"
_WATCH = "(contains(b, '관리종목') OR contains(b, '투자주의환기종목'))"
_KIND = f"""CASE WHEN {_RESUMES} THEN 'liquidation_trading' WHEN {_any("b", A.WITHDRAWN)} THEN NULL
  WHEN {_any("b", A.ELSEWHERE)} OR (contains(b, '가처분') AND NOT contains(b, '정리매매')) THEN NULL WHEN contains(b, '정리매매') THEN 'liquidation_trading'
  WHEN contains(cp, '매매거래정지및정지해제') THEN 'trading_halted' WHEN {_any("b", A.TENTATIVE)} THEN {_HALT} WHEN contains(b, '상장폐지') AND contains(b, '결정') THEN 'delisting_decided'
  WHEN {_WATCH} AND contains(b, '해제') AND NOT contains(b, '일부해제') THEN 'administrative_released' WHEN {_WATCH} AND contains(b, '지정') AND NOT contains(b, '사유') THEN 'administrative_designated'
  ELSE {_HALT} END"""
_CANCELLED = f"contains(b, '상장폐지') AND NOT {_RESUMES} AND ({_any('b', A.WITHDRAWN)} OR (contains(b, '가처분') AND contains(b, '인용')))"
ORDERS = f"""o0 AS (SELECT o_orderkey AS k, o_custkey AS ck, CAST(o_orderdate AS DATE) - 180 AS day, list_extract({_sql_list(TITLES)}, CAST(o_orderkey // 3 % {len(TITLES)} AS INTEGER) + 1) AS title,
  lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS receipt FROM orders),
o1 AS (SELECT *, trim(regexp_replace(title, '\\[[^\\[\\]]*\\]', '', 'g')) AS b, regexp_replace(regexp_replace(title, '\\[[^\\[\\]]*\\]', '', 'g'), '\\s+', '', 'g') AS cp FROM o0),
o2 AS (SELECT *, {_KIND} AS kind, {_CANCELLED} AS cancelled, regexp_replace(cp, '\\([^()]*\\)', '', 'g') AS fm FROM o1)"""
CAL = "cal0 AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem))"
ACTIONS = f"""{ORDERS}, {CAL}, pg AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session, l_suppkey AS instrument_id FROM lineitem),
fi AS (SELECT ck % 50 + 1 AS instrument_id, coalesce(kind, 'delisting_decided') AS kind, 'filing' AS source, receipt, day AS announced_on, day + 1 AS known_day, NULL::DATE AS effective_start, NULL::DATE AS effective_end,
  kind IS NULL AS cancellation FROM o2 WHERE k % 3 = 0 AND ck % 3 = 1 AND (kind IS NOT NULL OR cancelled)),
n0 AS (SELECT *, ck % 40 + 1 AS name, list_extract({_sql_list(DESKS)}, CAST(k % 7 % 3 AS INTEGER) + 1) AS desk, day + CAST(k % 24 + 9 >= 24 AS INTEGER) AS kst,
  CASE WHEN (k % 24 + 9) % 24 < 9 THEN day + CAST(k % 24 + 9 >= 24 AS INTEGER) ELSE day + CAST(k % 24 + 9 >= 24 AS INTEGER) + 1 END AS known, day + 8 AS fs, day + CAST(k % 5 * 10 - 5 AS INTEGER) AS fe FROM o2 WHERE k % 3 = 1),
n1 AS (SELECT * FROM n0 WHERE desk <> '주식회사' AND k % 19 <> 0),
nx AS (
  SELECT unnest([name, name + 40]) AS instrument_id, 'delisting_decided' AS kind, receipt, kst, known, CASE WHEN fe > kst THEN fs END AS s, CASE WHEN fe > kst THEN fe END AS e, false AS c FROM n1 WHERE fm = '상장폐지'
  UNION ALL SELECT name, CASE fm WHEN '관리종목지정' THEN 'administrative_designated' ELSE 'administrative_released' END, receipt, kst, known, fs, NULL, false FROM n1
    WHERE fm IN ('관리종목지정', '관리종목지정해제') AND k % 4 <> 0 AND NOT (fm = '관리종목지정해제' AND desk = '코스닥시장본부')
  UNION ALL SELECT name, coalesce(kind, 'delisting_decided'), receipt, kst, known, NULL, NULL, kind IS NULL FROM n1
    WHERE fm NOT IN ('상장폐지', '관리종목지정', '관리종목지정해제') AND (kind IS NOT NULL OR cancelled) AND NOT (coalesce(kind, '') = 'administrative_released' AND desk = '코스닥시장본부')),
ny AS (SELECT nx.*, p.session AS page FROM nx ASOF JOIN (SELECT DISTINCT session FROM pg) p ON nx.kst >= p.session),
fl AS (SELECT CAST(l_shipdate AS DATE) AS session, l_suppkey AS instrument_id, min(l_returnflag) = 'R' AS f FROM lineitem GROUP BY ALL),
fg AS (SELECT *, lag(f, 1, false) OVER (PARTITION BY instrument_id ORDER BY session) AS was FROM fl),
aa AS (
  SELECT * FROM fi
  UNION ALL SELECT instrument_id, kind, 'exchange', 'N' || receipt, kst, known, s, e, c FROM ny WHERE (page, instrument_id) IN (SELECT (session, instrument_id) FROM pg)
  UNION ALL SELECT instrument_id, CASE WHEN f THEN 'administrative_designated' ELSE 'administrative_released' END, 'flag', 'FLAG-' || instrument_id || '-' || session, session, session + 1, session, NULL, false FROM fg WHERE f <> was),
ac AS (SELECT aa.*, c.pos AS avail_pos FROM aa ASOF JOIN cal0 c ON aa.known_day <= c.session)"""
MASTER = """ma AS (
  SELECT session, p_partkey AS k, CASE WHEN p_partkey % 501 = 0 THEN '' WHEN p_partkey % 499 = 0 THEN '000001' ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS ticker,
    CASE WHEN p_partkey % 503 = 0 THEN 'KR0000007' ELSE 'KR' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS isin, DATE '1996-06-01' + CAST(p_partkey % 500 AS INTEGER) AS listed
  FROM part, (VALUES (DATE '1997-03-31'), (DATE '1997-06-30'), (DATE '1997-09-30'), (DATE '1997-12-31')) d(session)),
un AS (SELECT session, k AS part, ticker, CASE WHEN k % 7 IN (3, 4) THEN 'unknown_share_kind' WHEN k % 7 = 2 THEN 'non_ordinary_share' WHEN k % 5 = 3 THEN 'unknown_security_group'
  WHEN k % 5 = 2 THEN 'non_equity_security_group' WHEN k % 11 = 3 THEN 'unknown_market' WHEN k % 11 = 2 THEN 'excluded_market' WHEN k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 THEN 'spac'
  WHEN listed > session THEN 'not_listed_yet' ELSE 'eligible' END AS exclusion_reason FROM ma)"""

SQL = {
    "action_titles": f"WITH {ORDERS} SELECT title, coalesce(kind, 'none') AS kind, cancelled, count(*) AS n FROM o2 GROUP BY ALL",
    "market_actions": f"WITH {ACTIONS} SELECT * EXCLUDE (known_day) FROM ac",
    "coverage_staleness": f"""WITH {CAL}, c AS (SELECT max(CAST(o_orderdate AS DATE)) - 5 AS covered_through FROM orders)
SELECT covered_through, count(*) FILTER (session > covered_through) AS stale, count(*) FILTER (session > covered_through) <= 300 AS fresh FROM cal0, c GROUP BY ALL""",
    # A state machine, one action of each instrument a step: notice flags, the last notice, stated windows and the designation.
    "entry_blocks": f"""WITH RECURSIVE {ACTIONS}, ev AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY avail_pos, receipt, kind) AS n FROM ac),
st(instrument_id, n, pos, d, l, a, noticed, w) AS (
  SELECT DISTINCT instrument_id, 0::BIGINT, -1::BIGINT, false, false, false, -1::BIGINT, CAST([] AS STRUCT(s DATE, e DATE)[]) FROM ev
  UNION ALL
  SELECT e.instrument_id, e.n, e.avail_pos,
    CASE WHEN e.cancellation THEN false WHEN e.kind = 'delisting_decided' AND e.effective_end IS NULL THEN true ELSE st.d AND e.avail_pos - 1 - st.noticed <= 60 END,
    CASE WHEN e.cancellation THEN false WHEN e.kind = 'liquidation_trading' AND e.effective_end IS NULL THEN true ELSE st.l AND e.avail_pos - 1 - st.noticed <= 60 END,
    CASE WHEN NOT e.cancellation AND e.kind = 'administrative_designated' THEN true WHEN NOT e.cancellation AND e.kind = 'administrative_released' THEN false ELSE st.a END,
    CASE WHEN NOT e.cancellation AND e.kind IN ('delisting_decided', 'liquidation_trading') AND e.effective_end IS NULL THEN e.avail_pos ELSE st.noticed END,
    CASE WHEN e.cancellation THEN CAST([] AS STRUCT(s DATE, e DATE)[])
      WHEN e.kind IN ('delisting_decided', 'liquidation_trading') AND e.effective_end IS NOT NULL THEN list_append(st.w, struct_pack(s := e.effective_start, e := e.effective_end)) ELSE st.w END
  FROM st JOIN ev e ON e.instrument_id = st.instrument_id AND e.n = st.n + 1),
ls AS (SELECT * FROM st WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY instrument_id, pos ORDER BY n DESC) = 1),
sp AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY instrument_id ORDER BY pos), 1000000000) AS next FROM ls),
ce AS (SELECT sp.*, c.pos AS p, list_filter(w, lambda x: c.session <= x.e) AS cover, c.session FROM sp JOIN cal0 c ON c.pos >= sp.pos AND c.pos < sp.next),
re AS (SELECT instrument_id, p AS pos, CASE
  WHEN len(cover) > 0 THEN CASE WHEN len(list_filter(cover, lambda x: x.s IS NOT NULL AND session >= x.s)) > 0 THEN 'liquidation_trading' ELSE 'delisting_decided' END
  WHEN d AND p - noticed <= 60 THEN 'delisting_decided' WHEN l AND p - noticed <= 60 THEN 'liquidation_trading' WHEN a THEN 'administrative_designated' END AS reason FROM ce)
SELECT * FROM re WHERE reason IS NOT NULL""",
    "ordinary_universe": f"WITH {MASTER} SELECT session, part, exclusion_reason = 'eligible' AS eligible, exclusion_reason, session + INTERVAL '6 hours 30 minutes' AS available_at FROM un",
    "universe_violations": f"""WITH {MASTER} SELECT session, 'lacks_code' AS violation, ticker AS code FROM ma WHERE ticker = '' UNION ALL
SELECT session, 'duplicate_ticker', ticker FROM ma GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT session, 'conflicting_isin', isin FROM ma GROUP BY ALL HAVING count(DISTINCT ticker) > 1""",
    "snapshot_completeness": f"""WITH {CAL}, p AS (SELECT CAST(o_orderdate AS DATE) AS session, count(*) AS n FROM orders WHERE o_orderkey % 10 = 1 GROUP BY ALL)
SELECT session, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS problem FROM cal0 LEFT JOIN p USING (session) WHERE n IS NULL OR n > 1""",
    "current_universe": f"WITH {MASTER} SELECT DISTINCT ticker FROM un WHERE session = DATE '1997-12-31' AND exclusion_reason = 'eligible'",
    "panel_universe": f"""WITH {BARS}, u AS (SELECT CAST(l_shipdate AS DATE) AS session, l_suppkey AS instrument_id, min(l_linenumber) AS first, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
SELECT session, instrument_id, close, first < 7 AND flag <> 'R' AS eligible, CASE WHEN first >= 7 THEN 'absent_from_universe' WHEN flag = 'R' THEN 'non_ordinary_share' ELSE 'eligible' END AS exclusion_reason
FROM bars JOIN u USING (session, instrument_id)""",
}

DATES = {
    "market_actions": ("announced_on", "effective_start", "effective_end"), "coverage_staleness": ("covered_through",), "ordinary_universe": ("session",), "universe_violations": ("session",),
    "snapshot_completeness": ("session",), "panel_universe": ("session",),
}
INSTANTS = {"ordinary_universe": ("available_at",)}
