"""Market actions: notices classified by title, three channels in one table, and the entry blocks that follow from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import KST, kst_date
from tidemark.operators.fundamentals import avail_index
from tidemark.operators.notices import notice_form

DELISTING, LIQUIDATION = "delisting_decided", "liquidation_trading"
DESIGNATED, RELEASED = "administrative_designated", "administrative_released"
HALTED, RESUMED = "trading_halted", "trading_resumed"

# The exchange's vocabulary, which titles must hold for the right kind.
WITHDRAWN = ("공시번복", "취소", "철회", "무효")
TENTATIVE = ("우려", "여부", "예고", "미진행", "제외")
ELSEWHERE = ("해외", "이전상장", "의안상정", "자회사", "종속회사")
DELISTED, LIQUIDATING, DECIDED = "상장폐지", "정리매매", "결정"
AGAIN, BEGUN = "재개", "개시"
INJUNCTION, GRANTED = "가처분", "인용"
WATCHED = ("관리종목", "투자주의환기종목")
NAMED, CAUSE, LIFTED, PARTLY = "지정", "사유", "해제", "일부해제"
HALT, RESUME, HALT_AND_RELEASE = "매매거래정지", "거래재개", "매매거래정지및정지해제"
DELISTING_FORM, DESIGNATION_FORM, RELEASE_FORM = "상장폐지", "관리종목지정", "관리종목지정해제"
FLAG_DESK, DESK = "코스닥시장본부", "시장본부"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(w) for w in words))


def base_title(title: Column) -> Column:
    """A title without bracketed tags and outer space; empty where it is NULL."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\[[^\[\]]*\]", ""), r"^\s+|\s+$", "")


def _given(title: Column, rule: Callable[[Column, Column], Column]) -> Column:
    """A rule over (base, compact) title, each computed once wherever the rule names it."""
    base = base_title(title)
    both = F.array(F.struct(base.alias("base"), F.regexp_replace(base, r"\s+", "").alias("compact")))
    return F.transform(both, lambda t: rule(t["base"], t["compact"]))[0]


def _liquidation_resumes(compact: Column) -> Column:
    return compact.contains(LIQUIDATING) & (compact.contains(AGAIN) | compact.contains(BEGUN)) & compact.contains(DELISTED)


def action_kind(title: Column) -> Column:
    """Kind of a notice; NULL for a withdrawal and for titles of no action. The first rule that fits decides."""

    def rule(base: Column, compact: Column) -> Column:
        halt = F.when((base.contains(HALT) & base.contains(LIFTED)) | base.contains(RESUME), RESUMED).when(base.contains(HALT), HALTED)
        watched = _any(base, WATCHED)
        none = F.lit(None).cast("string")
        return (
            F.when(_liquidation_resumes(compact), LIQUIDATION)
            .when(_any(base, WITHDRAWN), none)
            .when(_any(base, ELSEWHERE) | (base.contains(INJUNCTION) & ~base.contains(LIQUIDATING)), none)
            .when(base.contains(LIQUIDATING), LIQUIDATION)
            .when(compact.contains(HALT_AND_RELEASE), HALTED)
            .when(_any(base, TENTATIVE), halt)
            .when(base.contains(DELISTED) & base.contains(DECIDED), DELISTING)
            .when(watched & base.contains(LIFTED) & ~base.contains(PARTLY), RELEASED)
            .when(watched & base.contains(NAMED) & ~base.contains(CAUSE), DESIGNATED)
            .otherwise(halt)
        )

    return _given(title, rule)


def delisting_cancelled(title: Column) -> Column:
    """Whether a title withdraws a delisting, or a court suspends it."""
    return _given(
        title,
        lambda base, compact: base.contains(DELISTED) & ~_liquidation_resumes(compact) & (_any(base, WITHDRAWN) | (base.contains(INJUNCTION) & base.contains(GRANTED))),
    )


def open_day(instant: Column, open_hour: int = 9) -> Column:
    """The first KST date whose opening hour follows an instant."""
    return F.to_date(F.from_utc_timestamp(instant, KST) + F.make_interval(hours=F.lit(24 - open_hour)))


def on_last_page(rows: DataFrame, pages: DataFrame, day: str, key: str) -> DataFrame:
    """rows whose key is on the last page (session, key) at or before their day; those before the first page go."""
    days = pages.select("session").distinct()
    last = days.agg(F.max("session").alias("last_page"))
    upto = F.coalesce(F.date_sub(F.lead("session").over(Window.orderBy("session")), 1), F.col("session"))
    spans = days.withColumn("upto", upto).select(F.col("session").alias("page"), F.explode(F.sequence("session", "upto")).alias("page_day"))
    dated = rows.where(F.col(day).isNotNull()).join(last).withColumn("page_day", F.least(day, "last_page")).drop("last_page").join(spans, "page_day").drop("page_day")
    there = pages.select(F.col("session").alias("page"), key).distinct()
    return dated.join(there, ["page", key], "left_semi").drop("page")


COLUMNS = ["instrument_id", "kind", "source", "receipt", "announced_on", "known_day", "effective_start", "effective_end", "cancellation"]


def _titled(rows: DataFrame) -> DataFrame:
    """Actions by title alone, and cancellations of a delisting, which carry its kind."""
    kind, cancelled = action_kind(F.col("title")), delisting_cancelled(F.col("title"))
    out = rows.withColumns({"kind": kind, "cancellation": F.coalesce(kind.isNull() & cancelled, F.lit(False))}).where("kind is not null or cancellation")
    return out.withColumn("kind", F.coalesce("kind", F.lit(DELISTING)))


def _shaped(rows: DataFrame, source: str) -> DataFrame:
    none = F.lit(None).cast("date")
    absent = {c: none for c in ("effective_start", "effective_end") if c not in rows.columns}
    return rows.withColumns({"source": F.lit(source), **absent}).select(*COLUMNS)


def filed_actions(disclosures: DataFrame, bridge: DataFrame) -> DataFrame:
    """Channel of filings: (company_id, title, receipt, announced_on) through a bridge (company_id, instrument_id), known on a later day."""
    return _shaped(_titled(disclosures.join(bridge, "company_id")).withColumn("known_day", F.date_add("announced_on", 1)), "filing")


def exchange_actions(notices: DataFrame, pages: DataFrame) -> DataFrame:
    """Channel of exchange notices: forms by their fields, others by title, of names on the last page.

    notices: (receipt, title, submitter, instrument_id, disclosed_at, listed_ids array, form_start, form_end, is_common). A delisting
    form speaks for all its listed_ids, and without its window where that ended by the announcement; an administrative form counts
    for common shares. The desk whose daily flag is the authority releases no name by a notice.
    """
    at = F.col("disclosed_at")
    mine = notices.where(F.col("submitter").endswith(DESK) & F.col("instrument_id").isNotNull())
    mine = mine.withColumns({"announced_on": kst_date(at), "known_day": open_day(at), "form": notice_form(F.col("title"))})
    stale = F.coalesce(F.col("form_end") <= F.col("announced_on"), F.lit(False))
    delisted = mine.where(F.col("form") == DELISTING_FORM).withColumn("instrument_id", F.explode("listed_ids")).withColumns({
        "kind": F.lit(DELISTING), "cancellation": F.lit(False),
        "effective_start": F.when(~stale, F.col("form_start")), "effective_end": F.when(~stale, F.col("form_end")),
    })
    admin = mine.where(F.col("form").isin(DESIGNATION_FORM, RELEASE_FORM) & F.col("is_common")).withColumns({
        "kind": F.when(F.col("form") == DESIGNATION_FORM, DESIGNATED).otherwise(RELEASED), "cancellation": F.lit(False), "effective_start": F.col("form_start"),
    })
    titled = _titled(mine.where(~F.col("form").isin(DELISTING_FORM, DESIGNATION_FORM, RELEASE_FORM)))
    ignored = (F.col("kind") == RELEASED) & (F.col("submitter") == FLAG_DESK)
    every = _shaped(delisted, "exchange").unionByName(_shaped(admin.where(~ignored), "exchange")).unionByName(_shaped(titled.where(~ignored), "exchange"))
    return on_last_page(every, pages, "announced_on", "instrument_id").select(*COLUMNS)


def flag_actions(flags: DataFrame) -> DataFrame:
    """Channel of daily flags (session, instrument_id, flagged): designated where one is new, released where it is gone; an absent day changes nothing."""
    was = F.lag("flagged", 1, False).over(Window.partitionBy("instrument_id").orderBy("session"))
    changes = flags.withColumn("was", was).where("flagged <> was")
    return _shaped(changes.select(
        "instrument_id", F.when(F.col("flagged"), DESIGNATED).otherwise(RELEASED).alias("kind"), F.concat_ws("-", F.lit("FLAG"), "instrument_id", "session").alias("receipt"),
        F.col("session").alias("announced_on"), F.date_add("session", 1).alias("known_day"), F.col("session").alias("effective_start"), F.lit(False).alias("cancellation"),
    ), "flag")


def market_actions(channels: list[DataFrame], calendar: DataFrame) -> DataFrame:
    """All channels with avail_pos, the first session on or after the day they are known; what no session follows is not known yet."""
    return avail_index(reduce(DataFrame.unionByName, channels), calendar, "known_day").drop("known_day")


def coverage_staleness(sessions: DataFrame, covered: DataFrame, budget: int) -> DataFrame:
    """(covered_through, stale, fresh): sessions after what is covered, and whether they are within the budget. covered: (covered_through)."""
    j = sessions.select("session").distinct().join(covered.agg(F.max("covered_through").alias("covered_through")))
    out = j.groupBy("covered_through").agg(F.count_if(F.coalesce(F.col("session") > F.col("covered_through"), F.lit(True))).alias("stale"))
    return out.withColumn("fresh", F.col("stale") <= budget)


#: Reasons by precedence; of windows stated by the exchange, one that has begun counts as liquidation.
REASONS = [(1, LIQUIDATION), (2, DELISTING), (3, DELISTING), (4, LIQUIDATION), (5, DESIGNATED)]


def entry_blocks(actions: DataFrame, calendar: DataFrame, cap: int = 250, administrative: bool = True) -> DataFrame:
    """(instrument_id, pos, reason): sessions at which an instrument may not be entered.

    actions: (instrument_id, avail_pos, receipt, kind, cancellation, effective_start, effective_end); of one position they apply by
    receipt, then kind. A delisting or liquidation without an end blocks until it is cancelled or until more than `cap` sessions have
    passed since the latest such notice of either kind; then both lapse. One with an end blocks through it, whatever the
    cap, unless cancelled. A designation holds until its release. No state is carried from row to row: notices form chains
    where none lapses before the next, and a flag stands while its last notice is after the last cancellation and in the chain of the
    last notice.
    """
    order = Window.partitionBy("instrument_id").orderBy("avail_pos", "receipt", "kind")
    upto, before, after = (order.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    cancel = F.coalesce(F.col("cancellation"), F.lit(False))
    bounded = F.col("effective_end").isNotNull()
    notice = ~cancel & ~bounded & F.col("kind").isin(DELISTING, LIQUIDATION)
    n, pos = F.row_number().over(order), F.col("avail_pos")
    last_before = F.last(F.when(notice, pos), ignorenulls=True).over(before)
    e = actions.withColumns({"n": n, "breaks": (notice & F.coalesce(pos - last_before > cap + 1, F.lit(True))).cast("int")})
    e = e.withColumn("chain", F.sum("breaks").over(upto))

    def latest(condition: Column, value: Column) -> Column:
        return F.last(F.when(condition, value), ignorenulls=True).over(upto)

    e = e.withColumns({
        "cancelled": F.coalesce(latest(cancel, F.col("n")), F.lit(0)), "noticed": latest(notice, pos), "next_pos": F.lead("avail_pos").over(order),
        "next_cancel": F.min(F.when(cancel, pos)).over(after), "designated": latest(~cancel & F.col("kind").isin(DESIGNATED, RELEASED), F.col("kind") == DESIGNATED),
        **{f"{k}_{c}": latest(notice & (F.col("kind") == k), F.col(c)) for k in (DELISTING, LIQUIDATION) for c in ("n", "chain")},
    })
    end = calendar.agg(F.max("pos").alias("end"))
    e = e.join(end)

    state = e.where("next_pos is null or next_pos > avail_pos").withColumn("until", F.coalesce(F.col("next_pos") - 1, "end"))
    lapse = F.least("until", F.col("noticed") + cap)

    def span(condition: Column, upto: Column, rank: int) -> Column:
        return F.when(condition & (upto >= pos), F.struct(pos.alias("from"), upto.alias("to"), F.lit(rank).alias("rank")))

    stands = {k: (F.col(f"{k}_n") > F.col("cancelled")) & (F.col(f"{k}_chain") == F.col("chain")) for k in (DELISTING, LIQUIDATION)}
    spans = [span(stands[DELISTING], lapse, 3), span(stands[LIQUIDATION], lapse, 4)]
    if administrative:
        spans.append(span(F.col("designated"), F.col("until"), 5))
    open_cells = state.select("instrument_id", F.explode(F.array_compact(F.array(*spans))).alias("s")).select("instrument_id", F.explode(F.sequence("s.from", "s.to")).alias("pos"), "s.rank")

    stated = e.where(~cancel & bounded & F.col("kind").isin(DELISTING, LIQUIDATION)).join(calendar.select(pos_of("avail_pos"), F.col("session").alias("known")), "avail_pos")
    reach = F.least(pos + F.datediff("effective_end", "known"), F.coalesce(F.col("next_cancel") - 1, "end"), "end")
    cells = stated.withColumn("reach", reach).where("reach >= avail_pos").select("instrument_id", "effective_start", "effective_end", F.explode(F.sequence("avail_pos", "reach")).alias("pos"))
    begun = F.coalesce(F.col("session") >= F.col("effective_start"), F.lit(False))
    stated_cells = cells.join(calendar, "pos").where("session <= effective_end").select("instrument_id", "pos", F.when(begun, 1).otherwise(2).alias("rank"))

    first = open_cells.unionByName(stated_cells).groupBy("instrument_id", "pos").agg(F.min("rank").alias("rank"))
    reason = reduce(lambda out, r: F.when(F.col("rank") == r[0], r[1]).otherwise(out), reversed(REASONS), F.lit(None).cast("string"))
    return first.select("instrument_id", "pos", reason.alias("reason"))


def pos_of(name: str) -> Column:
    return F.col("pos").alias(name)
