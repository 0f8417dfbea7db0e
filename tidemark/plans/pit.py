"""Point-in-time facts, sleeves and series over the shared tables, and their SQL.

Facts are orders: a company pools twenty customers, an order is a version of the fact that its priority names, and its status
tells the basis and whether it is trusted. So quarters have restatements, late versions and two bases.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import catalog as C
from tidemark.operators import evaluation as E
from tidemark.operators import features as X
from tidemark.operators import pit as K
from tidemark.operators import sleeves as W
from tidemark.plans.evaluation import S, streams
from tidemark.sources import tables as T
from tidemark.sources.scratch import written

NAMES = ["equity", "assets", "ni", "sales", "ocf", "op", "gross"]


def _calendar(spark, sf_dir):
    return T.calendar(T.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")))


def _raw(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.expr("o_custkey div 20").alias("company_id"), (F.year(day) * 4 + F.quarter(day) - 1).cast("long").alias("quarter"),
        F.element_at(F.array(*map(F.lit, NAMES)), (1 + F.col("o_orderkey") % 7).cast("int")).alias("fact"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "F", "consolidated").otherwise("separate").alias("basis"), (F.col("o_orderstatus") != "P").alias("trusted"), F.date_add(day, 30).alias("published"),
        (F.col("o_orderkey") % 3).alias("filing"), F.concat(F.date_format(F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 60 as int))"), "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")).alias("receipt"),
    )


def _known(spark, sf_dir):
    return K.effective_availability(_raw(spark, sf_dir), _calendar(spark, sf_dir), "published", "receipt")


def _facts(spark, sf_dir):
    return K.quarter_facts(K.preferred_versions(_known(spark, sf_dir)))


def effective_availability(spark, sf_dir):
    return _known(spark, sf_dir).select("company_id", "version", "effective_day", "avail_pos")


def fact_quarantine(spark, sf_dir):
    """Filings of several facts, none of them trusted."""
    return K.fact_quarantine(_known(spark, sf_dir), ["company_id", "quarter", "filing"], F.col("trusted"))[1]


def quarantine_events(spark, sf_dir):
    return K.quarantine_to_events(_known(spark, sf_dir).where("not trusted").select("company_id", "quarter", "avail_pos", "published", "version"), ["company_id", "quarter"], ["avail_pos", "published", "version"])


def superseded_filter(spark, sf_dir):
    listed = T.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 11).alias("version"))
    kept, unknown = K.superseded_filter(_raw(spark, sf_dir), listed, "version")
    return kept.select(F.lit("kept").alias("what")).unionByName(unknown.select(F.lit("unknown").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


def fact_versions(spark, sf_dir):
    return K.preferred_versions(_known(spark, sf_dir))


def quarter_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


def _end(spark, sf_dir):
    """The calendar's last position, as a row."""
    return _calendar(spark, sf_dir).agg(F.max("pos").alias("last"))


def asof_fundamentals(spark, sf_dir):
    facts = written(_facts(spark, sf_dir), "facts")
    return K.held_steps(K.fact_steps(facts, NAMES), _end(spark, sf_dir), "company_id")


def _releases(spark, sf_dir, which="true"):
    """Versions of two facts on any basis, as early releases."""
    return _known(spark, sf_dir).where("fact in ('ni', 'sales')").where(which).groupBy("company_id", "quarter", F.col("fact").alias("metric"), "avail_pos").agg(F.max_by("value", "version").alias("value"))


def earnings_releases(spark, sf_dir):
    """Two values of a filing version and metric, and the session that first knows it; a third of rows lack one value, some both."""
    r = _known(spark, sf_dir).where("fact in ('ni', 'sales')").withColumn("prior_value", F.when(F.col("version") % 2 == 0, F.col("value") / 2)).withColumn("value", F.when(F.col("version") % 3 != 0, F.col("value")))
    return K.release_versions(r, ["company_id", "quarter", "fact", "published", "effective_day", "avail_pos"], "version", ["value", "prior_value"])


def asof_releases(spark, sf_dir):
    return K.release_steps(_releases(spark, sf_dir), ["ni", "sales"])


def best_earnings(spark, sf_dir):
    """What each company shows at each session, of filings and early releases; releases are those of every second order."""
    facts = written(_facts(spark, sf_dir), "facts")
    r = K.release_steps(_releases(spark, sf_dir, "version % 2 = 0").where("metric = 'ni'"), ["ni"]).select("company_id", "pos", "quarter", "known_pos", F.col("ni").alias("value"))
    f = K.newest_steps(facts.where("fact = 'ni'"))
    changes = K.changes_of([f, r], "company_id")
    shown = [K.asof_steps(x, changes, "company_id").where("quarter is not null") for x in (f, r)]
    return K.held_steps(K.best_earnings(*shown), _end(spark, sf_dir), "company_id")


def _show(c: str):
    return F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 1e4 + 0.5000001) / 1e4).alias(c)


def value_features(spark, sf_dir):
    steps = K.fact_steps(written(_facts(spark, sf_dir), "facts"), NAMES)
    cells = steps.join(F.broadcast(_calendar(spark, sf_dir)), "pos").withColumn("age", F.year("session") * 4 + F.quarter("session") - 1 - F.col("quarter"))
    cells = cells.withColumn("mcap", (F.col("company_id") + 1) * 1_000_000.0)
    return K.value_features(cells).select("company_id", "pos", *map(_show, ("bm", "ep", "roe", "opa", "gpa", "sue_op", "sue_ni", "asset_g", "accrual", "sales_g")))


def announcement_features(spark, sf_dir):
    levels = streams(spark, sf_dir).select("instrument_id", "pos", (F.lit(1.0) + F.col("i")).alias("level"))
    known = _facts(spark, sf_dir).where("fact = 'ni'").select(F.col("company_id").alias("instrument_id"), F.col("avail_pos").alias("known_pos"))
    return K.announcement_features(known, levels, _end(spark, sf_dir)).select("instrument_id", "pos", "earn_age", _show("ear"), _show("post_ear"))


def upsert_ranges(spark, sf_dir):
    r = T.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("subject"), F.to_date("ts").alias("start"), F.expr("date_add(to_date(ts), cast(event_id % 3 as int))").alias("end"), F.col("ts").alias("retrieved_at"), "event_id"
    )
    return C.latest_by_key(r, ["source", "subject", "start", "end"], "retrieved_at", "event_id").drop("retrieved_at")


def latest_lookup(spark, sf_dir):
    latest = C.latest_by_key(T.receipts(spark, sf_dir), ["source", "natural_key"], "retrieved_at", "event_id")
    wanted = T.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("natural_key"))
    return W.keyed_lookup(latest, wanted, ["natural_key"]).select("source", "natural_key", "status", "event_id")


def usable_blobs(spark, sf_dir):
    return C.upsert_blobs(T.receipts(spark, sf_dir).withColumn("usable", F.col("source") != "error")).where("usable").select("content_hash", "versions")


def contract_violations(spark, sf_dir):
    """Events as receipts; some name no user, some answer no query, and the query of others lacks a field or is no object."""
    e, k = T.table(spark, sf_dir, "events"), F.col("event_id")
    asked = F.when(k % 6 == 0, "[]").when(k % 6 == 1, '{"day": 1}').otherwise('{"day": 1, "page": 2}')
    e = e.select("event_type", "props", F.when(k % 7 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("natural_key"), F.when(k % 13 != 0, F.col("ts")).alias("retrieved_at"), asked.alias("query"))
    got = W.contract_violations(e, "props", ["k"], ["natural_key", "retrieved_at"], ("query", ["day", "page"]))
    return got.groupBy("event_type", "missing").agg(F.count("*").alias("n"))


def index_series(spark, sf_dir):
    levels = T.observed(spark, sf_dir).select("instrument_id", "pos", F.col("close").alias("level"))
    return W.listed_series(levels, _calendar(spark, sf_dir), "instrument_id").groupBy("instrument_id", "state").agg(F.count("*").alias("n"))


def cash_series(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.to_date("o_orderdate").alias("session"), "o_totalprice")
    return W.single_rows(o, _calendar(spark, sf_dir), "o_totalprice")


def _flow_rows(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("session"), q.alias("a"), (-q).alias("b"), (F.col("l_linenumber") % 2).cast("long").alias("c"),
        (-(F.col("l_linenumber") % 2) + (F.col("l_orderkey") % 11 == 0).cast("int")).cast("long").alias("d"), F.col("l_orderkey").alias("source"), "l_linenumber",
    )


def flow_quality_counts(spark, sf_dir):
    """Rows of a day by source order modulo 7, which is the page they come from; pages of a cell may disagree."""
    f = _flow_rows(spark, sf_dir).withColumn("page", F.col("source") % 7)
    cell = Window.partitionBy("instrument_id", "session")
    last = _calendar(spark, sf_dir).agg(F.max("session").alias("last"))
    f = f.withColumns({"conflicting": F.min("a").over(cell) != F.max("a").over(cell), "volume": F.sum("a").over(cell) - 30}).join(last)
    f = f.withColumn("late", F.coalesce(F.col("session") > F.date_sub("last", 40), F.lit(False))).withColumn("total", F.lit(0).cast("long")).withColumn("session", F.when(F.col("source") % 17 != 0, F.col("session")))
    return W.quality_counts(f, ["page"], W.flow_checks(["a", "b", "c", "d"], "total", "a", "volume", "conflicting", "late"))


def flow_supplement(spark, sf_dir):
    f = _flow_rows(spark, sf_dir)
    return W.supplement(f.where("source % 3 = 0").select("instrument_id", "session"), f.where("source % 2 = 0"), ["instrument_id", "session"], ["a", "b", "c", "d"], "source")


def flow_union(spark, sf_dir):
    f = _flow_rows(spark, sf_dir).select("instrument_id", "session", "l_linenumber")
    a, b = (f.where(x).select("instrument_id", "session").distinct() for x in ("l_linenumber <= 2", "l_linenumber > 2"))
    union, shared = W.disjoint_union(a, b, ["instrument_id", "session"])
    n = union.groupBy("session").agg(F.count("*").alias("cells"))
    return n.join(shared.groupBy("session").agg(F.count("*").alias("shared")), "session", "left").select("session", "cells", F.coalesce("shared", F.lit(0)).alias("shared"))


def _last(spark, sf_dir):
    o = T.observed(spark, sf_dir)
    return o.groupBy("instrument_id").agg(F.max("pos").alias("last_pos"), F.max_by("volume", "pos").alias("last_volume"))


def exit_index(spark, sf_dir):
    end = _calendar(spark, sf_dir).agg(F.max("pos").alias("end"))
    return W.exit_index(_last(spark, sf_dir).join(F.broadcast(end)), F.col("end"), "instrument_id")


def reference_integrity(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("instrument_id"))
    return W.reference_integrity(e, T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id")), "instrument_id")


def tail_cube(spark, sf_dir):
    return W.tail_cells(T.observed(spark, sf_dir).select("instrument_id", "pos", "close"), 2000, "instrument_id").select("instrument_id", "tail_pos", "close")


def ensemble_average(spark, sf_dir):
    # By session before the members are laid out: z-scores and both means are within a session, so this is their one shuffle.
    o = T.observed(spark, sf_dir).select("pos", "instrument_id", "close", "volume", "high").repartition("pos")
    scores = o.select("pos", "instrument_id", F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("seed"), F.when((F.col("pos") + h + F.col("instrument_id")) % 4 != 0, (F.col(c) + s * F.col("instrument_id") % 5).cast("double")).alias("score")) for h, c in ((5, "close"), (10, "volume"), (21, "high")) for s in (1, 2)
    ])).alias("x")).select("pos", "instrument_id", "x.*")
    return W.ensemble_average(scores, 12).select("pos", "instrument_id", _show("score"))


def _picks(spark, sf_dir):
    o = T.observed(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("close"), "instrument_id"))
    return o.withColumn("rank", rank).where("rank <= 5").select("pos", "instrument_id", (F.col("change") >= 0).alias("passes"))


def trend_weights(spark, sf_dir):
    out = [W.trend_weights(_picks(spark, sf_dir), 5, m).withColumn("mode", F.lit(m)) for m in ("drop", "fraction", "redistribute")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("mode", "pos", "instrument_id", _show("weight"))


def combine_sleeves(spark, sf_dir):
    d = _picks(spark, sf_dir).select((F.col("pos") % 4).alias("sleeve"), "pos", "instrument_id", F.lit(0.2).alias("weight"))
    return W.combine_sleeves(d, _calendar(spark, sf_dir), 4).select("pos", "instrument_id", _show("weight"))


def capture_symbols(spark, sf_dir):
    w = W.trend_weights(_picks(spark, sf_dir), 5, "redistribute").select("pos", "instrument_id", "weight")
    held = _picks(spark, sf_dir).where("instrument_id % 3 = 0").select((F.col("pos") + 1).alias("pos"), "instrument_id")
    return W.capture_symbols(w, held, 6).select("pos", "instrument_id", F.col("rank").cast("long").alias("rank"), _show("change"))


def overlay_fractions(spark, sf_dir):
    """Volatility of the last twenty returns, unknown with fewer, and zero in one stream."""
    w = Window.partitionBy("instrument_id").orderBy("pos").rowsBetween(-19, 0)
    vol = F.when(F.count("log_return").over(w) == 20, F.when(F.col("instrument_id") == 3, 0.0).otherwise(F.stddev_pop("log_return").over(w) * 100))
    s = streams(spark, sf_dir).withColumn("vol", vol).withColumn("signal", F.when(F.col("pos") % 17 != 0, F.signum("log_return")))
    return W.overlay_fractions(s, 0.3, 0.2, 0.5).select("instrument_id", "pos", _show("trend_signal"), _show("vol_scale"), _show("regime_fraction"))


def causality_check(spark, sf_dir):
    """Features, scores and targets up to a cut, with every price, volume and flow after it made another; and a column that looks ahead, which must be caught."""
    cut = 1200
    o = written(T.observed(spark, sf_dir, flows=True).drop("session", "market", "listed_shares"), "observed").withColumn("present", F.lit(True))
    inputs = ["open", "high", "low", "close", "volume", "value", "base_price", "change", "market_cap", "net", "returned", "taken"]

    def corrupt(df):
        return df.withColumns({c: F.when(F.col("pos") > cut, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in inputs})

    def features(df):
        return X.select_features(X.returns(df), named)

    def targets(df):
        rows = X.rank_normalize(X.select_features(X.returns(df), {"r1": F.col("rcc")}), "r1", 5).select("instrument_id", "pos", F.col("rank").alias("score"))
        top = E.select_top(rows, 5).select("pos", "instrument_id", F.col("rank").alias("place"))
        return rows.join(top, ["pos", "instrument_id"], "left")

    ahead = F.lead("close").over(Window.partitionBy("instrument_id").orderBy("pos"))
    families = {
        "momentum": X.momentum_features(), "volatility": X.volatility_features(), "sessions": X.session_features(), "liquidity": X.liquidity_features(),
        "flows": X.flow_features("net") | X.flow_features("returned"), "looks_ahead": {"next": ahead},
    }
    named = {c: f for family in families.values() for c, f in family.items()}
    keys = ["instrument_id", "pos"]
    found = W.causality_mismatches(o, features, corrupt, cut, keys, {n: list(f) for n, f in families.items()})
    return found.unionByName(W.causality_mismatches(o, targets, corrupt, cut, keys, {"targets": ["score", "place"]})).select("what", "cells", "mismatches")


QUERIES = {f.__name__: f for f in (
    effective_availability, fact_quarantine, quarantine_events, superseded_filter, fact_versions, quarter_facts, asof_fundamentals, earnings_releases, asof_releases, best_earnings, value_features,
    announcement_features, upsert_ranges, latest_lookup, usable_blobs, contract_violations, index_series, cash_series, flow_quality_counts, flow_supplement, flow_union, exit_index,
    reference_integrity, tail_cube, ensemble_average, trend_weights, combine_sleeves, capture_symbols, overlay_fractions, causality_check,
)}

CAL = "cal0 AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem))"
RAW = f"""{CAL}, rw AS (
  SELECT o_custkey // 20 AS company_id, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS quarter,
    list_extract(['equity', 'assets', 'ni', 'sales', 'ocf', 'op', 'gross'], CAST(1 + o_orderkey % 7 AS INTEGER)) AS fact, o_orderkey AS version, o_totalprice AS value,
    CASE WHEN o_orderstatus = 'F' THEN 'consolidated' ELSE 'separate' END AS basis, o_orderstatus <> 'P' AS trusted, o_orderkey % 3 AS filing, CAST(o_orderdate AS DATE) + 30 AS published,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS receipt_day FROM orders),
kn AS (
  SELECT r.*, greatest(published, receipt_day) AS effective_day, c.pos AS avail_pos
  FROM rw r ASOF JOIN (SELECT session - 1 AS due, session, pos FROM cal0) c ON greatest(published, receipt_day) <= c.due)"""
VERSIONS = f"""{RAW}, pf AS (SELECT *, bool_or(basis = 'consolidated') OVER (PARTITION BY company_id, quarter, fact) AS any_c FROM kn),
vs AS (SELECT company_id, quarter, fact, avail_pos, version, value, basis FROM pf WHERE NOT any_c OR basis = 'consolidated'
  QUALIFY row_number() OVER (PARTITION BY company_id, quarter, fact, avail_pos ORDER BY version DESC) = 1)"""
FACTS = f"""{VERSIONS}, qf AS (SELECT company_id, quarter, fact, avail_pos, value FROM vs
  QUALIFY row_number() OVER (PARTITION BY company_id, quarter, fact ORDER BY avail_pos DESC, version DESC) = 1)"""
_NAMES = tuple(NAMES)
STEPS = f"""{FACTS}, wh AS (SELECT company_id, quarter, max(avail_pos) AS known FROM qf GROUP BY ALL),
ch AS (SELECT DISTINCT company_id, avail_pos AS pos FROM qf),
sp AS (SELECT ch.company_id, pos, max(quarter) AS quarter FROM ch JOIN wh ON wh.company_id = ch.company_id AND known <= pos GROUP BY ALL),
st AS (SELECT sp.company_id, sp.pos, sp.quarter, {", ".join(f"max(f.value) FILTER (f.fact = '{n}' AND f.quarter = sp.quarter AND f.avail_pos <= sp.pos) AS {n}, max(f.value) FILTER (f.fact = '{n}' AND f.quarter = sp.quarter - 4 AND f.avail_pos <= sp.pos) AS {n}_ly" for n in _NAMES)}
  FROM sp JOIN qf f ON f.company_id = sp.company_id AND f.quarter IN (sp.quarter, sp.quarter - 4) GROUP BY ALL)"""
RELEASES = f"""{RAW}, rl AS (SELECT company_id, quarter, fact AS metric, avail_pos, arg_max(value, version) AS value FROM kn WHERE fact IN ('ni', 'sales') GROUP BY ALL)"""


def _release_steps(metrics: tuple[str, ...]) -> str:
    last = ", ".join(f"arg_max(r.value, r.avail_pos) FILTER (r.metric = '{m}') AS {m}" for m in metrics)
    return f"""re AS (SELECT DISTINCT company_id, quarter, avail_pos AS pos FROM rl WHERE metric IN ({", ".join(f"'{m}'" for m in metrics)})),
rp AS (SELECT a.company_id, a.pos, b.quarter, max(b.pos) AS known_pos FROM (SELECT DISTINCT company_id, pos FROM re) a JOIN re b ON b.company_id = a.company_id AND b.pos <= a.pos GROUP BY a.company_id, a.pos, b.quarter
  QUALIFY row_number() OVER (PARTITION BY a.company_id, a.pos ORDER BY b.quarter DESC) = 1),
rs AS (SELECT rp.company_id, rp.pos, rp.quarter, known_pos, {last} FROM rp JOIN rl r ON r.company_id = rp.company_id AND r.quarter = rp.quarter AND r.avail_pos <= known_pos GROUP BY ALL)"""


def _c(x: str, name: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN floor(({x}) * 1e4 + 0.5000001) / 1e4 END AS {name}"


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN age <= 2 AND {bottom} > 0 THEN ({top}) / {bottom} END"


OBS = S + ", ob AS (SELECT * FROM bars JOIN cal USING (session))"
PICKS = OBS + ", pk AS (SELECT pos, instrument_id, change >= 0 AS passes FROM ob QUALIFY row_number() OVER (PARTITION BY pos ORDER BY close DESC, instrument_id) <= 5)"
TW = PICKS + """, tw AS (
  SELECT 'drop' AS mode, pos, instrument_id, CASE WHEN passes THEN 1 / 5::DOUBLE ELSE 0 END AS w FROM pk
  UNION ALL SELECT 'fraction', pos, instrument_id, CASE WHEN passes THEN 1 / 5::DOUBLE ELSE 0.5 / 5::DOUBLE END FROM pk
  UNION ALL SELECT 'redistribute', pos, instrument_id, CASE WHEN passes THEN least(1 / (count(*) FILTER (passes) OVER (PARTITION BY pos))::DOUBLE, 1.5::DOUBLE / 5) ELSE 0 END FROM pk)"""
FLOWS = """fl AS (SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS session, CAST(l_quantity AS BIGINT) AS a, -CAST(l_quantity AS BIGINT) AS b, CAST(l_linenumber % 2 AS BIGINT) AS c,
  CAST(-(l_linenumber % 2) + CAST(l_orderkey % 11 = 0 AS INTEGER) AS BIGINT) AS d, l_orderkey AS source, l_linenumber FROM lineitem)"""

SQL = {
    "effective_availability": f"WITH {RAW} SELECT company_id, version, effective_day, avail_pos FROM kn",
    "fact_quarantine": f"""WITH {RAW} SELECT company_id, quarter, filing, max(avail_pos) AS avail_pos, count(*) AS facts FROM kn GROUP BY ALL HAVING NOT bool_or(trusted)""",
    "quarantine_events": f"""WITH {RAW} SELECT company_id, quarter, avail_pos, published, version, 'unresolved' AS state FROM kn WHERE NOT trusted
QUALIFY row_number() OVER (PARTITION BY company_id, quarter ORDER BY avail_pos DESC, published DESC, version DESC) = 1""",
    "superseded_filter": """WITH l AS (SELECT c_custkey * 11 AS v FROM customer)
SELECT 'kept' AS what, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT v FROM l) UNION ALL SELECT 'unknown', count(*) FROM l WHERE v NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0""",
    "fact_versions": f"WITH {VERSIONS} SELECT * FROM vs",
    "quarter_facts": f"WITH {FACTS} SELECT * FROM qf",
    "asof_fundamentals": f"""WITH {STEPS}, ce AS (SELECT company_id, pos FROM (SELECT DISTINCT company_id FROM qf), cal0)
SELECT ce.company_id, ce.pos, st.* EXCLUDE (company_id, pos) FROM ce ASOF JOIN st ON ce.company_id = st.company_id AND ce.pos >= st.pos""",
    "earnings_releases": f"""WITH {RAW} SELECT company_id, quarter, fact, published, effective_day, avail_pos, version, CASE WHEN version % 3 <> 0 THEN value END AS value,
CASE WHEN version % 2 = 0 THEN value / 2 END AS prior_value FROM kn WHERE fact IN ('ni', 'sales') AND (version % 3 <> 0 OR version % 2 = 0)
QUALIFY row_number() OVER (PARTITION BY company_id, quarter, fact, published, effective_day ORDER BY version) = 1""",
    "asof_releases": f"WITH {RELEASES}, {_release_steps(('ni', 'sales'))} SELECT * FROM rs",
    "best_earnings": f"""WITH {FACTS}, rl AS (SELECT company_id, quarter, fact AS metric, avail_pos, arg_max(value, version) AS value FROM kn WHERE fact = 'ni' AND version % 2 = 0 GROUP BY ALL), {_release_steps(("ni",))},
ce AS (SELECT company_id, pos FROM (SELECT DISTINCT company_id FROM qf), cal0),
fs AS (SELECT a.company_id, a.pos, arg_max(b.value, b.quarter) AS value, max(b.quarter) AS quarter, arg_max(b.avail_pos, b.quarter) AS known_pos
  FROM (SELECT DISTINCT company_id, avail_pos AS pos FROM qf WHERE fact = 'ni') a JOIN qf b ON b.company_id = a.company_id AND b.avail_pos <= a.pos AND b.fact = 'ni' GROUP BY ALL),
f AS (SELECT ce.company_id, ce.pos, quarter, known_pos, value FROM ce ASOF JOIN fs ON ce.company_id = fs.company_id AND ce.pos >= fs.pos),
rr AS (SELECT ce.company_id, ce.pos, quarter, known_pos, ni FROM ce ASOF JOIN rs ON ce.company_id = rs.company_id AND ce.pos >= rs.pos),
j AS (SELECT coalesce(f.company_id, rs.company_id) AS company_id, coalesce(f.pos, rs.pos) AS pos, f.quarter AS fq, f.known_pos AS fk, f.value AS fv, rs.quarter AS rq, rs.known_pos AS rk, rs.ni AS rv,
  f.quarter IS NOT NULL AND (rs.quarter IS NULL OR f.quarter >= rs.quarter) AS use FROM f FULL JOIN rr rs ON f.company_id = rs.company_id AND f.pos = rs.pos)
SELECT company_id, pos, CASE WHEN use THEN fq ELSE rq END AS quarter, CASE WHEN use THEN fv ELSE rv END AS value,
  CASE WHEN fq = rq THEN least(fk, rk) WHEN use THEN fk ELSE rk END AS known_pos, CASE WHEN use THEN 'filing' ELSE 'release' END AS origin FROM j""",
    "value_features": f"""WITH {STEPS}, vf AS (SELECT st.*, year(session) * 4 + quarter(session) - 1 - quarter AS age, (company_id + 1) * 1000000.0::DOUBLE AS mcap FROM st JOIN cal0 USING (pos))
SELECT company_id, pos, {_c(_ratio("equity", "mcap"), "bm")}, {_c(_ratio("ni", "mcap"), "ep")}, {_c(_ratio("ni", "equity"), "roe")}, {_c(_ratio("op", "assets"), "opa")},
  {_c(_ratio("gross", "assets"), "gpa")}, {_c(_ratio("op - op_ly", "mcap"), "sue_op")}, {_c(_ratio("ni - ni_ly", "mcap"), "sue_ni")}, {_c(_ratio("assets - assets_ly", "assets_ly"), "asset_g")}, {_c(_ratio("ni - ocf", "assets"), "accrual")},
  {_c(_ratio("sales - sales_ly", "abs(sales_ly)"), "sales_g")} FROM vf""",
    "announcement_features": f"""WITH {FACTS}, {OBS}, an AS (SELECT DISTINCT company_id, avail_pos AS known_pos FROM qf WHERE fact = 'ni'),
ce AS (SELECT company_id, pos FROM (SELECT DISTINCT company_id FROM qf), cal0),
ac AS (SELECT ce.company_id AS instrument_id, ce.pos, known_pos FROM ce ASOF JOIN an ON ce.company_id = an.company_id AND ce.pos >= an.known_pos),
lv AS (SELECT instrument_id, pos, 1.0::DOUBLE + i AS level FROM s),
j AS (SELECT ac.*, b.level AS lb, a.level AS la, n.level AS ln FROM ac LEFT JOIN lv b ON b.instrument_id = ac.instrument_id AND b.pos = known_pos - 1
  LEFT JOIN lv a ON a.instrument_id = ac.instrument_id AND a.pos = least(known_pos + 1, ac.pos) LEFT JOIN lv n ON n.instrument_id = ac.instrument_id AND n.pos = ac.pos)
SELECT instrument_id, pos, pos - known_pos AS earn_age, {_c("CASE WHEN pos - known_pos <= 60 THEN la / lb - 1 END", "ear")}, {_c("CASE WHEN pos - known_pos <= 60 THEN ln / lb - 1 END", "post_ear")} FROM j""",
    "upsert_ranges": """SELECT event_type AS source, user_id AS subject, CAST(ts AS DATE) AS start, CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS "end", event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE), event_id % 3 ORDER BY ts DESC, event_id DESC) = 1""",
    "latest_lookup": """WITH l AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS natural_key, event_id,
  CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 11 = 0 THEN 'provider_error' ELSE 'success' END AS status FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT source, natural_key, status, event_id FROM l WHERE natural_key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0)""",
    "usable_blobs": """SELECT json_extract_string(props, '$.k') AS content_hash, count(*) AS versions FROM events GROUP BY ALL HAVING bool_or(event_type <> 'error')""",
    "contract_violations": """WITH m AS (SELECT event_type, concat_ws(',', CASE WHEN NOT list_contains(json_keys(props), 'k') THEN 'k' END, CASE WHEN event_id % 7 = 0 THEN 'envelope:natural_key' END,
  CASE WHEN event_id % 13 = 0 THEN 'envelope:retrieved_at' END, CASE WHEN event_id % 6 = 0 THEN 'query:day' END, CASE WHEN event_id % 6 < 2 THEN 'query:page' END) AS missing FROM events)
SELECT event_type, missing, count(*) AS n FROM m WHERE missing <> '' GROUP BY ALL""",
    "index_series": f"""WITH {OBS}, {CAL}, f AS (SELECT instrument_id, min(pos) AS first_pos FROM ob GROUP BY ALL)
SELECT f.instrument_id, CASE WHEN c.pos < first_pos THEN 'unlisted' WHEN close > 0 THEN 'known' ELSE 'missing' END AS state, count(*) AS n
FROM f CROSS JOIN cal0 c LEFT JOIN ob ON ob.instrument_id = f.instrument_id AND ob.pos = c.pos GROUP BY ALL""",
    "cash_series": f"""WITH {CAL}, o AS (SELECT CAST(o_orderdate AS DATE) AS session, count(*) AS n, min(o_totalprice) AS p FROM orders WHERE o_orderkey % 11 = 0 GROUP BY ALL)
SELECT session, coalesce(n, 0) AS rows FROM cal0 LEFT JOIN o USING (session) WHERE coalesce(n, 0) <> 1 OR NOT coalesce(p, 0) > 0""",
    "flow_quality_counts": f"""WITH {FLOWS}, x AS (SELECT *, min(a) OVER w <> max(a) OVER w AS con, sum(a) OVER w - 30 AS volume, session > (SELECT max(session) FROM fl) - 40 AS late FROM fl WINDOW w AS (PARTITION BY instrument_id, session))
SELECT source % 7 AS page, count(*) AS rows, count(*) FILTER (con) AS conflict, count(*) FILTER (a + b + c + d <> 0) AS identity, count(*) FILTER (late) AS tail, count(*) FILTER (source % 17 = 0) AS dateless,
  count(*) FILTER (abs(a) > volume) AS retail_over_volume FROM x GROUP BY ALL""",
    "flow_supplement": f"""WITH {FLOWS} SELECT instrument_id, session, min(a) AS a, min(b) AS b, min(c) AS c, min(d) AS d, min(source) AS source FROM fl
WHERE source % 2 = 0 AND a + b + c + d = 0 AND (instrument_id, session) IN (SELECT (instrument_id, session) FROM fl WHERE source % 3 = 0)
GROUP BY instrument_id, session HAVING count(DISTINCT (a, b, c, d)) = 1""",
    "flow_union": f"""WITH {FLOWS}, x AS (SELECT DISTINCT instrument_id, session, l_linenumber <= 2 AS p FROM fl)
SELECT session, count(*) AS cells, count(*) - count(DISTINCT instrument_id) AS shared FROM x GROUP BY session""",
    "exit_index": f"""WITH {OBS} SELECT instrument_id, max(pos) + 1 AS exit_pos, arg_max(volume, pos) = 0 AS halted FROM ob GROUP BY instrument_id HAVING max(pos) < (SELECT max(pos) FROM cal)""",
    "reference_integrity": "SELECT user_id AS instrument_id, count(*) AS events FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL",
    "tail_cube": f"WITH {OBS} SELECT instrument_id, pos - 2000 AS tail_pos, close FROM ob WHERE pos >= 2000",
    "ensemble_average": f"""WITH {OBS}, sc AS (SELECT pos, instrument_id, h, sd, CASE WHEN (pos + h + instrument_id) % 4 <> 0 THEN CAST(CASE h WHEN 5 THEN close WHEN 10 THEN volume ELSE high END + sd * instrument_id % 5 AS DOUBLE) END AS score
  FROM ob, (VALUES (5), (10), (21)) a(h), (VALUES (1), (2)) b(sd)),
z AS (SELECT pos, instrument_id, sd, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 1e-12 AND count(score) OVER w >= 12 THEN stddev_pop(score) OVER w END AS z FROM sc WINDOW w AS (PARTITION BY pos, h, sd)),
y AS (SELECT pos, instrument_id, sd, avg(z) AS z FROM z GROUP BY ALL), x AS (SELECT pos, instrument_id, avg(z) AS score FROM y GROUP BY ALL)
SELECT pos, instrument_id, {_c("score", "score")} FROM x""",
    "trend_weights": f"WITH {TW} SELECT mode, pos, instrument_id, {_c('w', 'weight')} FROM tw",
    "combine_sleeves": f"""WITH {PICKS}, dd AS (SELECT DISTINCT pos % 4 AS sleeve, pos AS decided FROM pk), sp AS (SELECT c.pos, sleeve, max(decided) AS decided FROM cal c JOIN dd ON decided <= c.pos GROUP BY ALL),
x AS (SELECT sp.pos, instrument_id, count(*) * 0.2::DOUBLE / 4 AS w FROM sp JOIN pk ON pk.pos = decided GROUP BY ALL) SELECT pos, instrument_id, {_c("w", "weight")} FROM x""",
    "capture_symbols": f"""WITH {TW}, w AS (SELECT pos, instrument_id, w FROM tw WHERE mode = 'redistribute'),
d AS (SELECT pos, lead(pos) OVER (ORDER BY pos) AS next FROM (SELECT DISTINCT pos FROM w)),
b AS (SELECT next AS pos, instrument_id, w FROM w JOIN d USING (pos) WHERE next IS NOT NULL),
h AS (SELECT DISTINCT pos + 1 AS pos, instrument_id FROM pk WHERE instrument_id % 3 = 0 AND pos + 1 IN (SELECT pos FROM d)),
k AS (SELECT pos, instrument_id FROM w UNION SELECT pos, instrument_id FROM b UNION SELECT pos, instrument_id FROM h),
j AS (SELECT k.pos, k.instrument_id, coalesce(a.w, 0) AS w, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS change, h.pos IS NOT NULL AS held
  FROM k LEFT JOIN w a USING (pos, instrument_id) LEFT JOIN b USING (pos, instrument_id) LEFT JOIN h USING (pos, instrument_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY change DESC, instrument_id) AS r FROM j WHERE change <> 0),
x AS (SELECT pos, count(*) AS n FROM m GROUP BY pos),
z AS (SELECT j.pos, instrument_id, coalesce(x.n, 0) + row_number() OVER (PARTITION BY j.pos ORDER BY w DESC, instrument_id) AS r FROM j LEFT JOIN x ON x.pos = j.pos WHERE change = 0 AND held)
SELECT pos, instrument_id, r AS rank, {_c("change", "change")} FROM m WHERE r <= 6 UNION ALL SELECT pos, instrument_id, r, 0.0::DOUBLE FROM z WHERE r <= 6""",
    "overlay_fractions": f"""WITH {S}, v AS (SELECT instrument_id, pos, CASE WHEN pos % 17 <> 0 THEN sign(log_return) END AS signal,
  CASE WHEN count(log_return) OVER w = 20 THEN CASE WHEN instrument_id = 3 THEN 0.0::DOUBLE ELSE stddev_pop(log_return) OVER w * 100 END END AS vol
  FROM s WINDOW w AS (PARTITION BY instrument_id ORDER BY pos ROWS 19 PRECEDING))
SELECT instrument_id, pos, {_c("CASE WHEN vol IS NULL OR signal IS NULL THEN 0.0::DOUBLE ELSE signal::DOUBLE END", "trend_signal")},
  {_c("CASE WHEN vol IS NULL OR vol <= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0.3::DOUBLE / vol END", "vol_scale")},
  {_c("CASE WHEN signal IS NULL OR signal >= 0 OR vol IS NULL THEN 0.0::DOUBLE WHEN vol <= 0 THEN 0.5::DOUBLE * abs(signal) ELSE least(0.5::DOUBLE, 0.2::DOUBLE / vol) * abs(signal) END", "regime_fraction")} FROM v""",
    "causality_check": f"""WITH {OBS}, c AS (SELECT count(*) AS n FROM ob WHERE pos <= 1200),
l AS (SELECT instrument_id FROM ob GROUP BY instrument_id HAVING min(pos) <= 1200 AND max(pos) > 1200)
SELECT what, n AS cells, CASE WHEN what = 'looks_ahead' THEN (SELECT count(*) FROM l) ELSE 0 END AS mismatches
FROM c, (VALUES ('momentum'), ('volatility'), ('sessions'), ('liquidity'), ('flows'), ('targets'), ('looks_ahead')) w(what)""",
}

DATES = {
    "effective_availability": ("effective_day",), "quarantine_events": ("published",), "earnings_releases": ("published", "effective_day"), "upsert_ranges": ("start", '"end"'), "cash_series": ("session",),
 "flow_supplement": ("session",), "flow_union": ("session",),
}
