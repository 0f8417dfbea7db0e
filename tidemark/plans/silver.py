"""Silver queries over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import silver as V
from tidemark.plans.panel import BARS, STATES, states
from tidemark.sources import tables as T

FACTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flows(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("session")).agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).cast("long").alias(n) for f, n in (("A", "individual"), ("N", "foreign_net"), ("R", "institution"))],
        F.sum("l_quantity").cast("long").alias("whole"),
    )


def classify_parts(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    rules = [(F.col("p_type").isNull(), "unknown_kind"), (F.col("p_type") == "PROMO", "non_ordinary"), (F.col("p_size") > 40, "excluded_market"), (F.col("p_name").contains("ring"), "spac")]
    return p.select("p_partkey", V.ordered_reason(rules, "eligible").alias("reason"))


def flow_identities(spark, sf_dir):
    kept, bad = V.flow_identities(_flows(spark, sf_dir), {"whole": ["individual", "foreign_net", "institution"]})
    return kept.groupBy("instrument_id").agg(F.count("*").alias("kept")).join(bad.groupBy("instrument_id").agg(F.count("*").alias("bad")), "instrument_id", "left")


def flow_resolve(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderkey")
    return V.flow_resolve(o, ["o_custkey", "y"], ["o_orderstatus"], "o_orderkey")


def availability_lag(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    return V.available_after(b.select("instrument_id", "session"), T.calendar(b), 2)


def flow_gap(spark, sf_dir):
    t = states(spark, sf_dir).where("price_state = 'tradable'").select("instrument_id", "session")
    gap = V.flow_gap(t, _flows(spark, sf_dir).where("institution > 0"))
    return gap.select("instrument_id", F.array_join("sessions", ",").alias("sessions"))


def flow_freshness(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").alias("instrument_id"), F.col("l_linenumber").alias("retrieved_at"))
    need = li.select("session", "instrument_id").distinct().withColumn("seal", F.lit(4))
    return V.freshness(need, li.where("retrieved_at > 2"), "seal").withColumn("missing_fraction", F.floor(F.col("missing_fraction") * 1e6 + 0.5) / 1e6)


def merge_facts(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority", F.to_date("o_orderdate").alias("available"))
    kept, conflicts = V.merge_facts(o, ["o_custkey", "y"], ["o_orderpriority"], "available")
    return kept.join(conflicts, ["o_custkey", "y"], "left")


def financial_quality(spark, sf_dir):
    return V.facts_seen(T.facts(spark, sf_dir), ["company_id", "quarter"], FACTS)


def eligible_companies(spark, sf_dir):
    return V.eligible_companies(V.facts_seen(T.facts(spark, sf_dir), ["company_id", "quarter"], FACTS[:1]), F.lit("1999-06-30").cast("date"))


def flag_transitions(spark, sf_dir):
    f = _flows(spark, sf_dir).withColumn("flag", F.col("institution") > F.col("individual"))
    return V.flag_transitions(f, "instrument_id", "flag")


def unanimous_mapping(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return V.learn_unanimous(p.withColumn("code", F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))), "code", "p_type", "p_partkey")


def mapping_disagreement(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return V.disagreement_leave_one_out(p.withColumn("code", F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))), "code", "p_type", "p_partkey")


def disclosure_dedupe(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return V.disclosure_dedupe(p.select(F.pmod("p_partkey", F.lit(300)).alias("k"), F.col("p_name").alias("title")), "k", "title")


def backfill_plan(spark, sf_dir):
    return V.backfill_chunks(states(spark, sf_dir).where("price_state = 'tradable'"), "instrument_id", 120)


def reconcile_sessions(spark, sf_dir):
    s = states(spark, sf_dir).where("price_state = 'tradable'")
    o = T.table(spark, sf_dir, "lineitem").where("l_linenumber < 6").groupBy(F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("session")).agg(
        F.max(F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")).alias("o_close"), F.sum("l_quantity").cast("long").alias("o_volume")
    )
    r = V.reconcile(s.select("instrument_id", "session", "close", "volume"), o, 0.8)
    return r.select("session", "rows", "verdict", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("coverage", "close_match", "volume_match")])


def stratified_sample(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return V.stratified_sample(p.select("p_partkey", "p_brand"), ["p_brand"], "p_partkey", 60, F.sha2(F.col("p_partkey").cast("string"), 256)).select("p_partkey", "p_brand", F.col("rank").cast("long").alias("rank"))


def dividend_days(spark, sf_dir):
    """Records and receipts reach back before the first session, pay days past the last one."""
    day = F.to_date("o_orderdate")
    e = T.table(spark, sf_dir, "orders").select("o_orderkey", F.date_sub(day, 20).alias("record_date"), F.date_add(day, 200).alias("pay_date"), F.date_add(day, (F.col("o_orderkey") % 300 - 60).cast("int")).alias("received"))
    return V.dividend_days(e, T.sessions(spark, sf_dir)).select("o_orderkey", "ex_session", "pay_session", "avail_session")


def dividend_resolve(spark, sf_dir):
    """Twenty customers are a company; every third order is a correction, of one of two kinds or of none."""
    k = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders").select(
        F.expr("o_custkey div 20").alias("company_id"), k.alias("receipt"), F.to_date("o_orderdate").alias("record_date"), F.when(k % 5 < 2, "cash").when(k % 5 < 4, "stock").alias("kind"),
        (k % 3 == 0).alias("correction"), F.col("o_totalprice").alias("amount"),
    )
    return V.dividend_resolve(o, 30)


def price_audit(spark, sf_dir):
    return states(spark, sf_dir).groupBy("market").pivot("price_state", ["invalid", "zero_volume", "tradable"]).count().na.fill(0)


QUERIES = {f.__name__: f for f in (
    classify_parts, flow_identities, flow_resolve, availability_lag, flow_gap, flow_freshness, merge_facts, financial_quality, eligible_companies,
    flag_transitions, unanimous_mapping, mapping_disagreement, disclosure_dedupe, backfill_plan, reconcile_sessions, stratified_sample, dividend_days,
    dividend_resolve, price_audit,
)}

FLOWS = """fl AS (
  SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS individual,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS foreign_net,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS institution, CAST(sum(l_quantity) AS BIGINT) AS whole FROM lineitem GROUP BY ALL)"""
FACT = """fz AS (
  SELECT o_custkey AS company_id, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS quarter, o_orderpriority AS fact,
    round(sum(o_totalprice), 2) AS value, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY ALL),
f0 AS (SELECT company_id, quarter, fact, value, CAST(last_day + CAST(30 + company_id % 45 AS INTEGER) AS DATE) AS available FROM fz)"""


def _quality(required: list[str]) -> str:
    own = ", ".join(f"bool_or(fact = '{f}') AS h{i}" for i, f in enumerate(required))
    missing = ", ".join(f"CASE WHEN NOT bool_or(h{i}) OVER w THEN '{f}' END" for i, f in enumerate(required))
    return f"""{FACT}, h AS (SELECT company_id, quarter, available, {own} FROM f0 GROUP BY company_id, quarter, available),
q AS (SELECT company_id, quarter, available, concat_ws(',', {missing}) AS missing FROM h WINDOW w AS (PARTITION BY company_id, quarter ORDER BY available))"""


SQL = {
    "classify_parts": """SELECT p_partkey, CASE WHEN p_type IS NULL THEN 'unknown_kind' WHEN p_type = 'PROMO' THEN 'non_ordinary' WHEN p_size > 40 THEN 'excluded_market'
  WHEN contains(p_name, 'ring') THEN 'spac' ELSE 'eligible' END AS reason FROM part""",
    "flow_identities": f"""WITH {FLOWS} SELECT instrument_id, count(*) FILTER (whole = individual + foreign_net + institution) AS kept,
  nullif(count(*) FILTER (whole <> individual + foreign_net + institution), 0) AS bad FROM fl GROUP BY instrument_id""",
    "flow_resolve": "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 1",
    "availability_lag": f"""WITH {BARS}, l AS (SELECT session, lead(session, 2) OVER (ORDER BY pos) AS available_session FROM cal)
SELECT instrument_id, session, available_session FROM bars JOIN l USING (session)""",
    "flow_gap": f"""WITH {STATES}, {FLOWS} SELECT instrument_id, string_agg(strftime(session, '%Y-%m-%d'), ',' ORDER BY session) AS sessions FROM states
WHERE price_state = 'tradable' AND (instrument_id, session) NOT IN (SELECT (instrument_id, session) FROM fl WHERE institution > 0) GROUP BY instrument_id""",
    "flow_freshness": """WITH n AS (SELECT CAST(l_shipdate AS DATE) AS session, l_suppkey, min(l_linenumber) FILTER (l_linenumber > 2) AS s FROM lineitem GROUP BY ALL)
SELECT session, count(*) AS required, count(*) FILTER (s <= 4) AS present, count(*) FILTER (s > 4) AS late, count(*) - count(*) FILTER (s <= 4) AS missing,
  floor((count(*) - count(*) FILTER (s <= 4)) / count(*) * 1e6 + 0.5) / 1e6 AS missing_fraction FROM n GROUP BY session""",
    "merge_facts": """WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority, CAST(max(o_orderdate) AS DATE) AS available FROM orders GROUP BY ALL)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY o_custkey, y) > 1 THEN count(*) OVER (PARTITION BY o_custkey, y) END AS kinds FROM o""",
    "financial_quality": f"WITH {_quality(FACTS)} SELECT company_id, quarter, available, missing = '' AS complete, missing FROM q",
    "eligible_companies": f"""WITH {_quality(FACTS[:1])}
SELECT company_id, quarter FROM q WHERE available <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY quarter DESC, available DESC) = 1 AND missing = ''""",
    "flag_transitions": f"""WITH {FLOWS}, b AS (SELECT instrument_id, session, institution > individual AS flag,
  lag(institution > individual, 1, false) OVER (PARTITION BY instrument_id ORDER BY session) AS before FROM fl)
SELECT instrument_id, session, CASE WHEN flag THEN 'designated' ELSE 'released' END AS change FROM b WHERE flag <> before""",
    "unanimous_mapping": """SELECT p_brand || '/' || p_size AS code, min(p_type) AS p_type, count(DISTINCT p_partkey) AS support FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1""",
    "mapping_disagreement": """WITH p AS (SELECT p_brand || '/' || p_size AS code, p_type, p_partkey FROM part)
SELECT code, p_partkey, p_type FROM p x WHERE (SELECT count(DISTINCT p_type) FROM p y WHERE y.code = x.code) = 2
  AND (SELECT count(*) FROM p y WHERE y.code = x.code AND y.p_type = x.p_type) = 1""",
    "disclosure_dedupe": """WITH t AS (SELECT DISTINCT p_partkey % 300 AS k, regexp_replace(p_name, '\\s+', ' ', 'g') AS t FROM part),
b AS (SELECT k, arg_max(t, row(length(t), t)) AS kept_title FROM t GROUP BY k)
SELECT k, kept_title, bool_and(starts_with(kept_title, t)) AS consistent, count(*) AS titles FROM t JOIN b USING (k) GROUP BY ALL""",
    "backfill_plan": f"""WITH {STATES}, n AS (SELECT instrument_id, session, (row_number() OVER (PARTITION BY instrument_id ORDER BY session) - 1) // 120 AS chunk FROM states WHERE price_state = 'tradable')
SELECT instrument_id, chunk, min(session) AS first_session, max(session) AS last_session, count(*) AS sessions FROM n GROUP BY ALL""",
    "reconcile_sessions": f"""WITH {STATES}, o AS (SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session, max(CAST(floor(l_extendedprice / l_quantity) AS BIGINT)) AS oc,
  CAST(sum(l_quantity) AS BIGINT) AS ov FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL),
r AS (SELECT session, count(*) AS rows, avg(CASE WHEN oc IS NOT NULL THEN 1.0 ELSE 0 END) AS coverage, avg(CASE WHEN oc = close THEN 1.0 WHEN oc IS NOT NULL THEN 0 END) AS close_match,
  avg(CASE WHEN ov = volume THEN 1.0 WHEN ov IS NOT NULL THEN 0 END) AS volume_match FROM states LEFT JOIN o USING (instrument_id, session) WHERE price_state = 'tradable' GROUP BY session)
SELECT session, rows, CASE WHEN close_match IS NULL THEN 'no_data' WHEN coverage >= 0.8 AND close_match >= 0.8 THEN 'pass' ELSE 'fail' END AS verdict,
  floor(coverage * 1e6 + 0.5) / 1e6 AS coverage, floor(close_match * 1e6 + 0.5) / 1e6 AS close_match, floor(volume_match * 1e6 + 0.5) / 1e6 AS volume_match FROM r""",
    "stratified_sample": """WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(CAST(p_partkey AS VARCHAR)), p_partkey) AS rank FROM part)
SELECT * FROM r ORDER BY rank, p_brand LIMIT 60""",
    "dividend_days": f"""WITH {BARS}, c AS (SELECT session, lag(session) OVER (ORDER BY pos) AS before FROM cal), l AS (SELECT max(session) AS last FROM cal),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) - 20 AS rec, CAST(o_orderdate AS DATE) + 200 AS pay, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 - 60 AS INTEGER) AS got FROM orders)
SELECT o_orderkey, r.before AS ex_session, p.session AS pay_session, (SELECT min(session) FROM cal WHERE session > got) AS avail_session
FROM o ASOF LEFT JOIN c r ON rec >= r.session ASOF LEFT JOIN c p ON pay >= p.session""",
    # A state machine: the decisions that stand, one receipt of each company a step.
    "dividend_resolve": """WITH RECURSIVE d AS (SELECT o_custkey // 20 AS company_id, o_orderkey AS receipt, CAST(o_orderdate AS DATE) AS record_date, CASE WHEN o_orderkey % 5 < 2 THEN 'cash' WHEN o_orderkey % 5 < 4 THEN 'stock' END AS kind,
  o_orderkey % 3 = 0 AS correction, o_totalprice AS amount, row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) AS n FROM orders),
e AS (SELECT company_id, n, struct_pack(r := receipt, t := record_date, k := kind, a := amount) AS x, correction AS c FROM d),
s(company_id, n, l) AS (
  SELECT DISTINCT company_id, 0::BIGINT, CAST([] AS STRUCT(r BIGINT, t DATE, k VARCHAR, a DOUBLE)[]) FROM d
  UNION ALL
  SELECT s.company_id, e.n, list_append(list_filter(s.l, lambda y: y.t <> e.x.t AND NOT coalesce(
    e.c AND y.r = list_max(list_transform(list_filter(s.l, lambda z: z.k IS NOT DISTINCT FROM e.x.k AND abs(date_diff('day', z.t, e.x.t)) <= 30), lambda z: z.r)), false)), e.x)
  FROM s JOIN e ON e.company_id = s.company_id AND e.n = s.n + 1),
f AS (SELECT company_id, unnest(l) AS x FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC) = 1))
SELECT company_id, x.r AS receipt, x.t AS record_date, x.k AS kind, x.a AS amount FROM f""",
    "price_audit": f"""WITH {STATES} SELECT market, count(*) FILTER (price_state = 'invalid') AS invalid, count(*) FILTER (price_state = 'zero_volume') AS zero_volume,
  count(*) FILTER (price_state = 'tradable') AS tradable FROM states GROUP BY market""",
}

DATES = {
    "availability_lag": ("session", "available_session"), "flow_freshness": ("session",), "merge_facts": ("available",), "financial_quality": ("available",),
    "flag_transitions": ("session",), "backfill_plan": ("first_session", "last_session"), "reconcile_sessions": ("session",), "dividend_days": ("ex_session", "pay_session", "avail_session"), "dividend_resolve": ("record_date",),
}
