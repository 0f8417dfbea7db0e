"""The ordinary-share universe: classification of dated master rows, snapshots, completeness, and what is listed now."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import kst_instant
from tidemark.operators.silver import ordered_reason

# The master's words for what is traded, and the words that mark a shell company.
COMMON, EQUITY, MARKETS = "보통주", "주권", ("KOSPI", "KOSDAQ")
SHELL_SECTION, SHELL_NAMES = "SPAC", ("SPAC", "스팩", "기업인수목적")


def _plain(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def ordinary_reason() -> Column:
    """The first reason against a master row (share_kind, security_group, market, section, name, short_name, english_name), or eligible."""
    names = F.upper(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "short_name", "english_name"))))
    shell = F.upper(F.coalesce("section", F.lit(""))).contains(SHELL_SECTION) | reduce(or_, (names.contains(w) for w in SHELL_NAMES))
    kind, group, market = _plain("share_kind"), _plain("security_group"), _plain("market")
    rules = [
        (kind == "", "unknown_share_kind"), (kind != COMMON, "non_ordinary_share"), (group == "", "unknown_security_group"), (group != EQUITY, "non_equity_security_group"),
        (market == "", "unknown_market"), (~market.isin(*MARKETS), "excluded_market"), (shell, "spac"),
    ]
    return ordered_reason(rules, "eligible")


def universe_snapshot(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with eligible, exclusion_reason and available_at; violations, each of which is an error).

    master: (session, ticker, isin, listed_on, and what ordinary_reason reads). An eligible row that is listed after its session
    is not_listed_yet. Violations: a ticker twice in a session, an ISIN of two tickers, a row without either.
    """
    reason = ordinary_reason()
    reason = F.when((reason == "eligible") & (F.col("listed_on") > F.col("session")), "not_listed_yet").otherwise(reason)
    rows = master.withColumn("exclusion_reason", reason).withColumns({"eligible": F.col("exclusion_reason") == "eligible", "available_at": kst_instant(F.col("session"), 15, 30)})
    blank = master.where((_plain("ticker") == "") | (_plain("isin") == "")).select("session", F.lit("lacks_code").alias("violation"), F.col("ticker").alias("code"))
    twice = master.groupBy("session", "ticker").count().where("count > 1").select("session", F.lit("duplicate_ticker").alias("violation"), F.col("ticker").alias("code"))
    shared = master.groupBy("session", "isin").agg(F.count_distinct("ticker").alias("n")).where("n > 1").select("session", F.lit("conflicting_isin").alias("violation"), F.col("isin").alias("code"))
    return rows, blank.unionByName(twice).unionByName(shared)


def snapshot_completeness(pages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, problem): requested sessions without a page, or with more than one. pages has a row for each page."""
    n = pages.groupBy("session").agg(F.count("*").alias("pages"))
    j = sessions.select("session").distinct().join(n, "session", "left")
    problem = F.when(F.col("pages").isNull(), "missing").when(F.col("pages") > 1, "ambiguous")
    return j.select("session", problem.alias("problem")).where("problem is not null")


def current_universe(universe: DataFrame) -> DataFrame:
    """Eligible tickers of the latest session, known from the one partition that it has; a blank ticker is the empty text."""
    last = universe.agg(F.max("session").alias("session"))
    return universe.join(F.broadcast(last), "session").where("eligible").select(_plain("ticker").alias("ticker")).distinct()
