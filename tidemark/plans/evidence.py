"""Raw pages, registered datasets, files and industries over the shared tables, and their SQL.

A day's lines are a JSON page of records; the day's place in the calendar picks what is wrong with it. Parts play datasets that
stand on other parts, orders play quotes and master rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lineage as L
from tidemark.operators import silver as V
from tidemark.plans.panel import BARS, STATES, states
from tidemark.sources import pages as P
from tidemark.sources import tables as T

RECORD = "day string, code string, price double"


def _pages(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"), "l_suppkey", "l_extendedprice").groupBy("session", "l_suppkey").agg(F.max("l_extendedprice").alias("price"))
    d = F.dayofyear("session")
    day = F.date_format(F.when((d % 31 == 7) & (F.col("l_suppkey") % 2 == 0), F.date_add("session", 1)).otherwise(F.col("session")), "yyyyMMdd")
    code = F.when((d % 31 == 9) & (F.col("l_suppkey") % 3 == 0), " ").when(d % 31 == 11, "x").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    page = li.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(day.alias("day"), code.alias("code"), "price"))).alias("records"))
    text = F.to_json(F.struct("records"))
    broken = F.dayofyear("session") % 31
    return page.select("session", F.when(broken == 1, F.substring(text, 1, 40)).when(broken == 3, F.lit("[1]")).when(broken == 5, F.lit('{"records": []}')).when(broken == 6, F.lit("{}")).otherwise(text).alias("payload"))


def raw_pages(spark, sf_dir):
    rows, _ = P.scan_raw_pages(_pages(spark, sf_dir), RECORD, "day", "code")
    return rows.select("session", "code", "price")


def bad_pages(spark, sf_dir):
    _, bad = P.scan_raw_pages(_pages(spark, sf_dir), RECORD, "day", "code")
    return bad


def page_headers(spark, sf_dir):
    """Filing pages of orders: eight in nine hold a record, one in five of those an account."""
    o, k = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = F.concat_ws(":", "o_custkey", F.year("o_orderdate"), F.concat(F.lit("1101"), (k % 4).cast("string")), F.when(k % 2 == 0, "multi").otherwise("single"))
    record = F.struct(k.cast("string").alias("receipt"), F.when(k % 5 == 0, "ifrs-full_Assets").alias("account"), F.when(k % 3 == 0, "BS").otherwise("NT").alias("statement"))
    body = F.struct(F.when(k % 7 == 0, "013").otherwise("000").alias("status"), F.when(k % 9 != 0, F.array(record)).alias("records"))
    pages = o.select("o_orderkey", key.alias("natural_key"), F.when(k % 11 == 0, "not json").otherwise(F.to_json(body)).alias("payload"))
    got = P.page_headers(pages)
    return got.groupBy("report", "year", "source_kind", "status", "has_labels", "is_financial").agg(F.count("*").alias("pages"), F.count("receipt").alias("receipts"))


def migration_candidates(spark, sf_dir):
    """Pages of a day by order status; days of a purchase are answered."""
    o = T.table(spark, sf_dir, "orders")
    pages = o.groupBy(F.to_date("o_orderdate").alias("session"), F.col("o_orderpriority").alias("hash")).agg(F.count("*").alias("records"))
    answered = o.where("o_orderkey % 5 = 0").select(F.to_date("o_orderdate").alias("session"))
    return P.migration_candidates(pages, answered)[0]


def file_footprint(spark, sf_dir):
    """Files of the shared tables and their bytes, by metadata alone."""
    return P.footprint(P.files(spark, sf_dir), 1 << 40)


def stale_files(spark, sf_dir):
    """Files of the shared tables that are older than fifteen days at the end of 2100: all of them."""
    return P.stale_files(P.files(spark, sf_dir), F.to_timestamp(F.lit("2100-12-31")), 15, ("conversations.parquet",)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "age_days")


def _identity(k, policy, decided):
    params = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("decision_time"), decided)
    return F.struct(F.lit("silver").alias("layer"), policy.alias("policy"), F.create_map(F.lit("bronze"), F.col("p_brand")).alias("inputs"), params.alias("params"))


def stale_datasets(spark, sf_dir):
    """Parts stand on the part of a third of their key and on the next but one; some are not registered, some were built by an older policy, two in a ring."""
    p, k = T.table(spark, sf_dir, "part"), F.col("p_partkey")
    expected = p.select(k.alias("kind"), _identity(k, F.lit("v2"), F.lit("now")).alias("identity"))
    registry = p.where("p_partkey % 211 <> 3").select(k.alias("kind"), _identity(k, F.when(k % 197 == 5, "v1").otherwise("v2"), F.lit("then")).alias("identity"))
    up = p.where("p_partkey > 0").select(k.alias("kind"), F.expr("p_partkey div 3").alias("input")).unionByName(p.where("p_partkey % 10 = 1").select(k.alias("kind"), (k + 2).alias("input")))
    ring = p.where("p_partkey % 10 = 3").select(k.alias("kind"), (k - 2).alias("input"))
    stale, _ = L.stale_datasets(expected, registry, up.unionByName(ring))
    return stale


def industry_snapshot(spark, sf_dir):
    """Orders of even keys quote an industry for their customer, those of keys divisible by three state a code for it."""
    o, k = T.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at, digest = F.to_date("o_orderdate").alias("collected_at"), (k % 10).cast("string").alias("hash")
    industry = F.concat(F.lit("I"), F.when(k % 50 == 0, k % 3).otherwise(F.expr("o_custkey div 7 % 9")).cast("string"))
    quotes = o.where("o_orderkey % 2 = 0 and o_custkey % 5 <> 0").select(F.col("o_custkey").alias("ticker"), at, digest, industry.alias("industry"), F.when(k % 4 == 0, "KOSPI").otherwise("KOSDAQ").alias("market"))
    stocks = o.where("o_orderkey % 3 = 0 and o_custkey % 4 <> 0").select(F.col("o_custkey").alias("ticker"), at, digest, F.concat(F.lit("C"), F.expr("o_custkey div 7 % 40").cast("string")).alias("code"))
    return V.industry_snapshot(quotes, stocks)


def price_availability(spark, sf_dir):
    """Eligible cells are the days on which a supplier's customers' nation ordered: here every second session of each supplier."""
    s = states(spark, sf_dir)
    cells = s.select("instrument_id").distinct().join(T.sessions(spark, sf_dir).where("pos % 50 < 25"))
    return V.price_availability(cells.select("session", "instrument_id"), s.select("session", "instrument_id", "price_state"))


QUERIES = {f.__name__: f for f in (
    raw_pages, bad_pages, page_headers, migration_candidates, file_footprint, stale_files, stale_datasets, industry_snapshot, price_availability,
)}

PAGES = """l0 AS (SELECT CAST(l_shipdate AS DATE) AS session, dayofyear(l_shipdate) % 31 AS d, l_suppkey AS s, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
bp AS (SELECT session, CASE WHEN any_value(d) IN (1, 3, 6) THEN 'malformed' WHEN any_value(d) = 5 THEN 'empty' WHEN any_value(d) = 7 AND bool_or(s % 2 = 0) THEN 'wrong_day'
  WHEN any_value(d) = 9 AND bool_or(s % 3 = 0) THEN 'lacks_key' WHEN any_value(d) = 11 AND count(*) > 1 THEN 'repeated_key' END AS reason FROM l0 GROUP BY session)"""

SQL = {
    "raw_pages": f"WITH {PAGES} SELECT session, CASE WHEN d = 11 THEN 'x' ELSE 'S' || s END AS code, price FROM l0 JOIN bp USING (session) WHERE reason IS NULL",
    "bad_pages": f"WITH {PAGES} SELECT session, reason FROM bp WHERE reason IS NOT NULL",
    "page_headers": """WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey % 11 <> 0 AS ok FROM orders)
SELECT '1101' || k % 4 AS report, year, CASE WHEN k % 2 = 0 THEN 'multi' ELSE 'single' END AS source_kind, CASE WHEN ok THEN CASE WHEN k % 7 = 0 THEN '013' ELSE '000' END END AS status,
  ok AND k % 9 <> 0 AND k % 5 = 0 AS has_labels, ok AND k % 9 <> 0 AND k % 3 = 0 AS is_financial, count(*) AS pages, count(*) FILTER (ok AND k % 9 <> 0) AS receipts FROM o GROUP BY ALL""",
    "migration_candidates": """WITH p AS (SELECT CAST(o_orderdate AS DATE) AS session, o_orderpriority AS hash, count(*) AS records FROM orders GROUP BY ALL)
SELECT session, hash, records FROM p WHERE session NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 5 = 0)
QUALIFY row_number() OVER (PARTITION BY session ORDER BY records DESC, hash) = 1""",
    "stale_datasets": """WITH RECURSIVE s AS (SELECT p_partkey AS kind, CASE WHEN p_partkey % 211 = 3 THEN 'unregistered' WHEN p_partkey % 197 = 5 THEN 'identity_differs' END AS own FROM part),
u AS (SELECT p_partkey AS kind, p_partkey // 3 AS input FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 10 = 1
  UNION ALL SELECT p_partkey, p_partkey - 2 FROM part WHERE p_partkey % 10 = 3),
r(kind, depth) AS (SELECT kind, 0 FROM s WHERE own IS NOT NULL UNION SELECT u.kind, r.depth + 1 FROM r JOIN u ON u.input = r.kind WHERE r.depth < 30)
SELECT r.kind, coalesce(any_value(own), 'upstream_stale') AS reason, min(depth) AS depth FROM r JOIN s USING (kind) GROUP BY r.kind""",
    "industry_snapshot": """WITH q AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS ca, CAST(o_orderkey % 10 AS VARCHAR) AS hash, o_orderkey AS k FROM orders),
qq AS (SELECT ticker, ca, hash, 'I' || CAST(CASE WHEN k % 50 = 0 THEN k % 3 ELSE ticker // 7 % 9 END AS VARCHAR) AS industry, CASE WHEN k % 4 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market FROM q WHERE k % 2 = 0 AND ticker % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ca DESC, hash DESC, industry DESC, market DESC) = 1),
ss AS (SELECT ticker, ca, hash, 'C' || CAST(ticker // 7 % 40 AS VARCHAR) AS code FROM q WHERE k % 3 = 0 AND ticker % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ca DESC, hash DESC) = 1),
m AS (SELECT code, min(industry) AS industry, count(*) AS support FROM ss JOIN qq USING (ticker) GROUP BY code HAVING count(DISTINCT industry) = 1)
SELECT coalesce(qq.ticker, ss.ticker) AS ticker, CASE WHEN qq.ticker IS NOT NULL THEN qq.industry ELSE m.industry END AS industry,
  CASE WHEN qq.ticker IS NOT NULL THEN 'observed' WHEN m.code IS NOT NULL THEN 'inferred' ELSE 'unmapped' END AS basis, qq.market, ss.code, CASE WHEN qq.ticker IS NULL THEN m.support END AS support,
  greatest(qq.ca, ss.ca) AS available, coalesce(qq.hash, ss.hash) AS source, ss.hash AS code_source
FROM qq FULL JOIN ss ON qq.ticker = ss.ticker LEFT JOIN m ON m.code = ss.code""",
    "price_availability": f"""WITH {STATES}, c AS (SELECT session, instrument_id FROM (SELECT DISTINCT instrument_id FROM states), cal WHERE pos % 50 < 25)
SELECT session, count(*) AS eligible, count(*) FILTER (price_state IS NULL) AS missing, count(*) FILTER (price_state = 'invalid') AS invalid, count(*) FILTER (price_state = 'zero_volume') AS zero_volume,
  count(*) FILTER (price_state = 'tradable') AS tradable FROM c LEFT JOIN states USING (session, instrument_id) GROUP BY session""",
}

DATES = {
    "raw_pages": ("session",), "bad_pages": ("session",), "migration_candidates": ("session",), "industry_snapshot": ("available",), "price_availability": ("session",),
}
