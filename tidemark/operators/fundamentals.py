"""Facts by quarter: visibility by availability, trailing sums, the quarter shown at a session, and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import decision_day
from tidemark.operators.evaluation import asof_targets


def avail_index(rows: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """rows with avail_pos, the first calendar position on or after a day, which is 0 for all days before the calendar; those after
    its end are dropped. A column of instants counts by the date whose decision at 18:00 KST knows it."""
    before = F.coalesce(F.date_add(F.lag("session").over(Window.orderBy("pos")), 1), F.col("session"))
    days = calendar.withColumn("from_day", before).select(F.col("pos").alias("avail_pos"), F.explode(F.sequence("from_day", "session")).alias("span_day"))
    known = F.col(day) if dict(rows.dtypes)[day] == "date" else decision_day(F.col(day))
    dated = rows.join(calendar.agg(F.min("session").alias("first_day"))).withColumn("span_day", F.greatest(known, "first_day")).drop("first_day")
    return dated.where(F.col(day).isNotNull()).join(days, "span_day").drop("span_day")


def quarter_complete(facts: DataFrame) -> DataFrame:
    """Per company and quarter: the position from which all its facts are known."""
    return facts.groupBy("company_id", "quarter").agg(F.max("avail_pos").alias("pos"), F.count("*").alias("facts"))


def shown_quarter(complete: DataFrame, positions: DataFrame) -> DataFrame:
    """At each position the largest quarter known so far: an old quarter that comes late does not replace a newer one."""
    upto = Window.partitionBy("company_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = complete.groupBy("company_id", "pos").agg(F.max("quarter").alias("q")).withColumn("target", F.max("q").over(upto)).drop("q")
    return asof_targets(steps, positions, "company_id").select("company_id", "pos", F.col("target").alias("quarter"))


def trailing_sum(facts: DataFrame, quarters: int = 4) -> DataFrame:
    """facts with ttm, the sum over consecutive quarters, and ttm_pos, from which it is known; NULL if one is absent."""
    w = Window.partitionBy("company_id", "fact").orderBy("quarter").rangeBetween(-(quarters - 1), 0)
    full = F.count("*").over(w) == quarters
    return facts.withColumn("ttm", F.when(full, F.sum("value").over(w))).withColumn("ttm_pos", F.when(full, F.max("avail_pos").over(w)))


def year_over_year(facts: DataFrame) -> DataFrame:
    """facts with the value of the same quarter last year and the change over its size."""
    past = facts.select("company_id", "fact", (F.col("quarter") + 4).alias("quarter"), F.col("value").alias("value_ly"))
    return facts.join(past, ["company_id", "fact", "quarter"], "left").withColumn("growth", F.try_divide(F.col("value") - F.col("value_ly"), F.abs("value_ly")))


def fourth_from_annual(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Q4 = annual - Q1 - Q2 - Q3, known when the last of the four is; absent parts give no row."""
    q = quarters.where("quarter % 4 < 3").groupBy("company_id", F.expr("quarter div 4").alias("year")).agg(F.sum("value").alias("three"), F.max("avail_pos").alias("p"), F.count("*").alias("n"))
    j = annual.join(q.where("n = 3"), ["company_id", "year"])
    return j.select("company_id", (F.col("year") * 4 + 3).alias("quarter"), (F.col("value") - F.col("three")).alias("value"), F.greatest("avail_pos", "p").alias("avail_pos"))


def notice_blocks(actions: DataFrame, positions: DataFrame, cap: int) -> DataFrame:
    """Positions of an instrument blocked by notices: each blocks for cap positions, cut by a later cancellation.

    actions: (instrument_id, pos, kind) with kind notice or cancel. A notice while blocked renews the block.
    """
    w = Window.partitionBy("instrument_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    a = actions.groupBy("instrument_id", "pos").agg(F.max(F.when(F.col("kind") == "cancel", 1).otherwise(0)).alias("c"), F.max(F.when(F.col("kind") == "notice", 1).otherwise(0)).alias("n"))
    cells = positions.join(a, ["instrument_id", "pos"], "left")
    cells = cells.withColumn("last_notice", F.max(F.when(F.col("n") == 1, F.col("pos"))).over(w)).withColumn("last_cancel", F.max(F.when(F.col("c") == 1, F.col("pos"))).over(w))
    alive = (F.col("last_notice").isNotNull()) & (F.col("pos") - F.col("last_notice") <= cap) & (F.col("last_cancel").isNull() | (F.col("last_cancel") < F.col("last_notice")))
    return cells.select("instrument_id", "pos", F.coalesce(alive, F.lit(False)).alias("blocked"))


def flows_krw(flows: DataFrame, closes: DataFrame, lag: int) -> DataFrame:
    """Net shares times the close of the flow's own session, at the position where they become known; prices must be positive."""
    j = flows.join(closes.where("close > 0"), ["instrument_id", "pos"])
    return j.groupBy("instrument_id", (F.col("pos") + lag).alias("avail_pos")).agg(F.sum(F.col("net") * F.col("close")).alias("krw"))


def dividend_ttm(dividends: DataFrame, positions: DataFrame, days: int) -> DataFrame:
    """Sum of dividends from their ex day on for `days` days.

    Time is cut into periods of days + 1, so a span lies in its ex day's period and the next: a dividend has two rows at any number
    of days, and a position meets the dividends of its own period only.
    """
    period = lambda day: F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / (days + 1))
    spans = dividends.select("instrument_id", "dps", "ex_day", F.explode(F.array(period("ex_day"), period("ex_day") + 1)).alias("period"))
    met = positions.withColumn("period", period("session")).join(spans, ["instrument_id", "period"]).where(F.col("session").between(F.col("ex_day"), F.date_add("ex_day", days)))
    return met.groupBy("instrument_id", "session").agg(F.sum("dps").alias("dps_ttm"), F.count("*").alias("paid"))


def dividend_return(dividends: DataFrame, bars: DataFrame, withholding: float) -> DataFrame:
    """(instrument_id, session, dividend_return): the dividends of an ex session after tax over its base price; none where that is not positive."""
    paid = dividends.groupBy("instrument_id", F.col("ex_session").alias("session")).agg(F.sum("dps").alias("dps"))
    j = paid.join(bars.where("base_price > 0").select("instrument_id", "session", "base_price"), ["instrument_id", "session"])
    return j.select("instrument_id", "session", (F.col("dps") * (1 - withholding) / F.col("base_price")).alias("dividend_return"))


def dividend_plausibility(rows: DataFrame, ratio: float, ceiling: float) -> DataFrame:
    """Label of a dividend by its printed yield, the reference price and a ceiling; NULL if plausible."""
    own = F.try_divide("dps", "price")
    off = F.try_divide(own, "printed_yield")
    label = (
        F.when(F.col("price").isNull() | (F.col("price") <= 0), "no_reference_price").when((off > ratio) | (off < 1 / ratio), "yield_mismatch").when(own > ceiling, "yield_above_ceiling")
    )
    return rows.withColumn("label", label)


def coverage_stats(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Share of known cells of each column, one row a column."""
    wide = cells.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns])).alias("x")).select("x.*")
