"""Notices and filings by title, their coverage and identities, and benchmarks of what was read from them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report kinds with their codes and quarters, and what marks releases and dividend decisions in a title.
ANNUAL_REPORT, HALF_REPORT, QUARTER_REPORT = "사업보고서", "반기보고서", "분기보고서"
REPORTS = {"11011": 4, "11012": 2, "11013": 1, "11014": 3}
NOT_OWN_RESULTS = ("자회사의주요경영사항", "영업실적등에대한전망", "수시공시의무관련사항")
PRELIMINARY, PROFIT, CHANGED = "영업(잠정)실적", "매출액또는손익구조", ("변동", "변경")
DIVIDENDS, CORRECTED = ("현금ㆍ현물배당결정", "현금배당결정"), "[기재정정]"
DESK = "시장본부"
ACTION_TYPES = ("no_action", "split", "dividend", "reverse_split", "merger", "spin_off", "rights_issue", "bonus_issue", "unresolved")


def notice_form(title: Column) -> Column:
    """A title without bracketed tags, parenthesised qualifiers and white space."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"\[[^\[\]]*\]|\([^()]*\)|\s+", "")


def _compact(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", ""), r"^(?:\[[^\[\]]*\])+", "")


def release_kind(title: Column) -> Column:
    """preliminary, profit_change or NULL, by an issuer's own results alone."""
    c = _compact(title)
    own = ~reduce(or_, (c.contains(w) for w in NOT_OWN_RESULTS))
    return F.when(own & c.contains(PRELIMINARY), "preliminary").when(own & c.contains(PROFIT) & reduce(or_, (c.contains(w) for w in CHANGED)), "profit_change")


def is_dividend_decision(title: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "[ 　]", ""), rf"^(?:{CORRECTED.replace('[', chr(92) + '[').replace(']', chr(92) + ']')})+", "")
    return F.trim(F.regexp_replace(plain, r"[·・./]", "ㆍ")).isin(*DIVIDENDS)


def notice_dedupe(rows: DataFrame, key: str, name: str, rank: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row a notice, with the name of its latest window; notices whose other fields differ, each of which is an error)."""
    rest = [c for c in rows.columns if c not in (key, name, *rank)]
    seen = rows.groupBy(key).agg(F.max_by(F.struct(name, *rest), F.struct(*rank)).alias("last"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rest])).alias("kinds"))
    return seen.where("kinds = 1").select(key, "last.*"), seen.where("kinds > 1").select(key)


def document_targets(rows: DataFrame, wanted: list[str], key: str, order: str) -> DataFrame:
    """First row, by order, of each notice that an exchange desk filed under a wanted form."""
    fits = rows.where(F.col("submitter").endswith(DESK) & notice_form(F.col("title")).isin(*wanted))
    rest = [c for c in rows.columns if c not in (key, order)]
    return fits.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("first")).select(key, "first.*")


def periodic_identities(disclosures: DataFrame) -> DataFrame:
    """Distinct (company_id, filing_id, year, report_code, fiscal_period, published) of periodic reports among (company_id, filing_id, title, received).

    The period is the (year.month) of the title. A quarterly report of another month than March and September is none.
    """
    title = F.coalesce("title", F.lit(""))
    year, month = (F.regexp_extract(title, r"\((\d{4})\.(\d{2})\)", i) for i in (1, 2))
    code = (
        F.when(title.contains(ANNUAL_REPORT), "11011").when(title.contains(HALF_REPORT), "11012")
        .when(title.contains(QUARTER_REPORT) & (month == "03"), "11013").when(title.contains(QUARTER_REPORT) & (month == "09"), "11014")
    )
    quarter = reduce(lambda out, r: F.when(F.col("report_code") == r[0], str(r[1])).otherwise(out), REPORTS.items(), F.lit(None).cast("string"))
    found = disclosures.withColumns({"company_id": F.trim("company_id"), "filing_id": F.trim("filing_id"), "year": year, "report_code": code})
    found = found.where("year <> '' and report_code is not null and company_id <> '' and filing_id <> ''")
    return found.select("company_id", "filing_id", "year", "report_code", F.concat("year", F.lit("Q"), quarter).alias("fiscal_period"), F.col("received").alias("published")).distinct()


def relevant_identities(identities: DataFrame, bridge: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct (company_id, year, report_code) whose ticker is eligible in the fiscal year or the one after it."""
    years = universe.where("eligible").select("ticker", F.year("session").alias("y")).distinct()
    # A year of eligibility makes filings of that year and of the one before relevant: an equi join in place of two.
    serves = years.select("ticker", F.explode(F.array("y", F.col("y") - 1)).alias("y")).distinct()
    named = identities.join(bridge, "company_id").withColumn("y", F.col("year").try_cast("int"))
    return named.join(serves, ["ticker", "y"], "left_semi").select("company_id", "year", "report_code").distinct()


def coverage_gaps(windows: DataFrame, subjects: DataFrame, answers: DataFrame, through: Column) -> DataFrame:
    """(subject, start, end) of windows that are over by a day and that a subject's answers (subject, start, end, complete) lack or leave incomplete."""
    over = windows.where(F.col("end") <= through).agg(F.collect_set(F.struct("start", "end")).alias("windows"))
    due = subjects.select("subject").distinct().join(over).select("subject", F.explode("windows").alias("w")).select("subject", "w.*")
    return due.join(answers.where("complete").select("subject", "start", "end"), ["subject", "start", "end"], "left_anti")


def corporate_actions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first record, by `place`, of each instrument, day and action; (place, violation) of records that are none).

    records: (place, instrument_id, effective, action_id, type, status, reason, listing, delta). A type must be known, a bonus issue
    states its listing and delta, evidence is verified without a reason or unresolved with one, and no_action is no record.
    """
    reason = F.trim(F.coalesce("reason", F.lit("")))
    violation = (
        F.when(~F.coalesce(F.col("type").isin(*ACTION_TYPES), F.lit(False)), "unsupported_type")
        .when((F.col("type") == "bonus_issue") & (F.col("listing").isNull() | F.col("delta").isNull()), "bonus_without_listing")
        .when((F.col("type") == "no_action") | F.col("status").isNull(), "no_evidence")
        .when(~F.col("status").isin("verified", "unresolved"), "unknown_status")
        .when((F.col("status") == "verified") & (reason != ""), "verified_with_reason")
        .when((F.col("status") == "unresolved") & (reason == ""), "unresolved_without_reason")
        .when(F.col("instrument_id").isNull(), "no_instrument")
    )
    judged = records.withColumn("violation", violation)
    keys = ["instrument_id", "effective", "action_id"]
    rest = [c for c in records.columns if c not in (*keys, "place")]
    sound = judged.where("violation is null").groupBy(*keys).agg(F.min(F.struct("place", *rest)).alias("first"))
    return sound.select(*keys, "first.*"), judged.where("violation is not null").select("place", "violation")


def pending_bars(masters: DataFrame, answered: DataFrame, groups: list[str]) -> DataFrame:
    """(session, ticker) of the equity tickers on each stored master (session, status, payload of JSON rows) that no answer (session, ticker) holds."""
    rows = F.from_json("payload", "rows array<struct<code:string,kind:string>>")["rows"]
    listed = masters.where("status = 'success'").select("session", F.explode(rows).alias("r")).select("session", F.trim("r.code").alias("ticker"), F.trim("r.kind").alias("kind"))
    wanted = listed.where(F.col("ticker").rlike("^[0-9A-Z]{6}$") & F.col("kind").isin(*groups)).select("session", "ticker").distinct()
    return wanted.join(answered.select("session", "ticker").distinct(), ["session", "ticker"], "left_anti")


def shard_of(key: Column, shards: int) -> Column:
    """A stable shard of a key's text, alike in every process."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(shards)).cast("int")


def release_benchmark(releases: DataFrame, facts: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, matched, within_1pct, within_5pct, median_error) of consolidated releases against facts (company_id, quarter, metric, value).

    Spans of a quarter meet facts of the first three quarters, those of a year facts of the fourth; a fact of 0 is met by 0 alone. The
    median is of finite errors. A metric without a match has zeros.
    """
    fits = F.when(F.col("span") == "quarter", F.col("quarter") % 4 != 3).when(F.col("span").isin("cumulative", "annual"), F.col("quarter") % 4 == 3).otherwise(False)
    own = releases.where((F.col("basis") == "consolidated") & F.col("value").isNotNull() & fits).select("company_id", "quarter", "metric", "value")
    j = own.join(facts.select("company_id", "quarter", "metric", F.col("value").alias("fact")), ["company_id", "quarter", "metric"])
    error = F.when(F.col("fact") == 0, F.when(F.col("value") == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(F.col("value") - F.col("fact")) / F.abs("fact"))
    e = j.withColumn("e", error)
    got = e.groupBy("metric").agg(
        F.count("*").alias("matched"), F.avg((F.col("e") <= 0.01).cast("double")).alias("within_1pct"), F.avg((F.col("e") <= 0.05).cast("double")).alias("within_5pct"),
        F.expr("percentile(case when e < double('infinity') then e end, 0.5)").alias("median_error"),
    )
    every = releases.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return F.broadcast(every).join(got, "metric", "left").na.fill(0, ["matched"]).na.fill(0.0, ["within_1pct", "within_5pct", "median_error"])


def document_benchmark(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (labels, compared, exact, precision, coverage): values read from filings against labels (filing, fact, basis, value).

    A label whose rows disagree is none; of repeated parsed facts (filing, place, fact, basis, value) the first counts.
    """
    keys = ["filing", "fact", "basis"]
    clean = labels.groupBy(*keys).agg(F.count_distinct("value").alias("kinds"), F.min("value").alias("label")).where("kinds = 1").drop("kinds")
    first = parsed.groupBy(*keys).agg(F.min_by("value", "place").alias("value"), F.lit(1).alias("read"))
    own = clean.join(parsed.select("filing").distinct(), "filing", "left_semi")
    n = own.join(first, keys, "left").agg(F.count("*").alias("labels"), F.count("read").alias("compared"), F.count_if(F.col("value") == F.col("label")).alias("exact"))
    return n.withColumns({"precision": F.try_divide("exact", "compared"), "coverage": F.try_divide("compared", "labels")})
