"""Silver builders: classification, flows, facts, notices, mappings and reconciliation, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_reason(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first reason whose condition holds; an unknown condition does not hold."""
    out = F.lit(otherwise)
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return out


def flow_identities(flows: DataFrame, sums: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all identities total = sum of parts, rows that do not)."""
    ok = F.lit(True)
    for total, parts in sums.items():
        expected = F.lit(0)
        for p in parts:
            expected = expected + F.col(p)
        ok = ok & (F.col(total) == expected)
    ok = F.coalesce(ok, F.lit(False))
    return flows.where(ok), flows.where(~ok)


def flow_resolve(pages: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """Cells on whose values all pages agree, from the page that comes first; disagreeing cells go."""
    cells = pages.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("kinds"), F.min_by(F.struct(*values), order).alias("v"))
    return cells.where("kinds = 1").select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def available_after(rows: DataFrame, calendar: DataFrame, lag: int) -> DataFrame:
    """rows with available_session: `lag` sessions later; NULL at the calendar's tail."""
    later = calendar.select("session", F.lead("session", lag).over(Window.orderBy("pos")).alias("available_session"))
    return rows.join(F.broadcast(later), "session", "left")


def flow_gap(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Target sessions that rows lack, as one sorted list per instrument."""
    missing = targets.join(rows, ["instrument_id", "session"], "left_anti")
    return missing.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.col("session").cast("string"))).alias("sessions"))


def freshness(required: DataFrame, seen: DataFrame, seal: str) -> DataFrame:
    """Per session: required, present (seen by the seal), late (seen after it only), missing, and the missing fraction."""
    best = seen.groupBy("session", "instrument_id").agg(F.min("retrieved_at").alias("first_seen"))
    got = required.join(best, ["session", "instrument_id"], "left")

    def n(c: Column) -> Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    out = got.groupBy("session").agg(
        F.count("*").alias("required"), n(F.col("first_seen") <= F.col(seal)).alias("present"), n(F.col("first_seen") > F.col(seal)).alias("late")
    )
    missing = F.col("required") - F.col("present")
    return out.select("session", "required", "present", "late", missing.alias("missing"), (missing / F.col("required")).alias("missing_fraction"))


def merge_facts(facts: DataFrame, keys: list[str], payload: list[str], available: str) -> tuple[DataFrame, DataFrame]:
    """(latest row of each key and payload, keys with different payloads)."""
    conflicts = facts.groupBy(*keys).agg(F.count_distinct(F.struct(*payload)).alias("kinds")).where("kinds > 1")
    kept = facts.groupBy(*keys, *payload).agg(F.max(available).alias(available))
    return kept, conflicts


def facts_seen(facts: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """After each availability instant of a key: the required facts that are still missing."""
    day = facts.groupBy(*keys, "available").agg(F.collect_set("fact").alias("now"))
    upto = Window.partitionBy(*keys).orderBy("available").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.array_distinct(F.flatten(F.collect_list("now").over(upto)))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), seen))
    return day.select(*keys, "available", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"))


def eligible_companies(events: DataFrame, decision: Column) -> DataFrame:
    """Companies whose latest visible quarter is complete."""
    seen = events.where(F.col("available") <= decision)
    last = seen.groupBy("company_id").agg(F.max(F.struct("quarter", "available", "complete")).alias("last"))
    return last.where("last.complete").select("company_id", F.col("last.quarter").alias("quarter"))


def flag_transitions(pages: DataFrame, key: str, flag: str) -> DataFrame:
    """Designations and releases: changes of a flag against the last page seen; unseen counts as not flagged."""
    before = F.lag(flag, 1, False).over(Window.partitionBy(key).orderBy("session"))
    rows = pages.withColumn("before", before).where(F.col(flag) != F.col("before"))
    return rows.select(key, "session", F.when(F.col(flag), "designated").otherwise("released").alias("change"))


def learn_unanimous(rows: DataFrame, code: str, name: str, member: str) -> DataFrame:
    """(code, name, support) where all members of a code agree on one name."""
    got = rows.groupBy(code).agg(F.count_distinct(name).alias("names"), F.min(name).alias(name), F.count_distinct(member).alias("support"))
    return got.where("names = 1").select(code, name, "support")


def disagreement_leave_one_out(rows: DataFrame, code: str, name: str, member: str) -> DataFrame:
    """Members whose name differs from the one name that all others of their code have."""
    per_name = rows.groupBy(code, name).agg(F.count_distinct(member).alias("n"), F.min(member).alias(member))
    per_code = per_name.groupBy(code).agg(F.count("*").alias("names"), F.max("n").alias("most"))
    return per_name.join(per_code, code).where("names = 2 and n = 1").select(code, member, name)


def disclosure_dedupe(rows: DataFrame, key: str, title: str) -> DataFrame:
    """One row a key with the longest title, and whether every other title is a prefix of it."""
    norm = F.regexp_replace(title, r"\s+", " ")
    best = rows.withColumn("t", norm).groupBy(key).agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("kept_title"), F.collect_set("t").alias("ts"))
    return best.select(key, "kept_title", F.forall("ts", lambda t: F.col("kept_title").startswith(t)).alias("consistent"), F.size("ts").cast("long").alias("titles"))


def backfill_chunks(cells: DataFrame, key: str, size: int) -> DataFrame:
    """Sessions of a key in order, in chunks of size."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("session")) - 1
    return cells.withColumn("chunk", F.floor(n / size).cast("long")).groupBy(key, "chunk").agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("sessions")
    )


def reconcile(primary: DataFrame, other: DataFrame, tolerance: float) -> DataFrame:
    """Per session: coverage, match rates of close and volume over pairs, verdict."""
    j = primary.join(other, ["session", "instrument_id"], "left")
    both = F.col("o_close").isNotNull()
    out = j.groupBy("session").agg(
        F.count("*").alias("rows"), F.avg(both.cast("double")).alias("coverage"),
        F.avg(F.when(both, (F.col("o_close") == F.col("close")).cast("double"))).alias("close_match"),
        F.avg(F.when(both, (F.col("o_volume") == F.col("volume")).cast("double"))).alias("volume_match"),
    )
    good = (F.col("coverage") >= tolerance) & (F.col("close_match") >= tolerance)
    return out.withColumn("verdict", F.when(F.col("close_match").isNull(), "no_data").when(good, "pass").otherwise("fail"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, size: int, order: Column) -> DataFrame:
    """size rows, taken from the strata in turn in the given order. A sampling operator: its limit is the feature."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))
    return rows.withColumn("rank", rank).orderBy("rank", *strata).limit(size)


def dividend_days(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """events (record_date, pay_date, received) with ex_session, the session before the record session (the last one up to the record date),
    pay_session, the last one up to the pay date, and avail_session, the first one after the receipt.

    Days after the calendar belong to its last session; before its first there is none. No session follows a receipt at the end.
    """
    w = Window.orderBy("pos")
    days = calendar.select("session", F.lag("session").over(w).alias("before"), F.lead("session").over(w).alias("next"))
    spans = days.select(F.explode(F.sequence("session", F.coalesce(F.date_sub("next", 1), F.col("session")))).alias("day"), F.struct("session", "before", "next").alias("at"))
    ends = calendar.agg(F.min("session").alias("first_day"), F.max("session").alias("last_day"))
    out = events.join(ends)
    for column in ("record_date", "pay_date", "received"):
        side = spans.select(F.col("day").alias(f"{column}_day"), F.col("at").alias(f"{column}_at"))
        out = out.withColumn(f"{column}_day", F.when(F.col(column).isNotNull(), F.least(column, "last_day"))).join(side, f"{column}_day", "left").drop(f"{column}_day")
    after = F.when(F.col("received") < F.col("first_day"), F.col("first_day")).when(F.col("received") < F.col("last_day"), F.col("received_at.next"))
    return out.select(*events.columns, F.col("record_date_at.before").alias("ex_session"), F.col("pay_date_at.session").alias("pay_session"), after.alias("avail_session"))


def dividend_resolve(decisions: DataFrame, window_days: int) -> DataFrame:
    """(company_id, receipt, record_date, kind, amount) of decisions that stand once all are received, in receipt order.

    decisions: (company_id, receipt, record_date, kind, correction, amount). A correction replaces the latest earlier decision of its
    company and kind whose record date lies within the window; then one of the same record date gives way to the later receipt.
    A company's decisions fit an array, over which a fold keeps those that stand.
    """
    fields = ("receipt", "record_date", "kind", "amount")
    own = decisions.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(*fields, F.coalesce("correction", F.lit(False)).alias("correction")))).alias("came"))

    def onward(standing: Column, d: Column) -> Column:
        def replaced(x: Column) -> Column:
            return d["correction"] & x["kind"].eqNullSafe(d["kind"]) & (F.abs(F.datediff(x["record_date"], d["record_date"])) <= window_days)

        # In an array of one, so that it is found once a decision and not again for each that stands.
        last = F.array(F.array_max(F.transform(F.filter(standing, replaced), lambda x: x["receipt"])))
        left = F.transform(last, lambda r: F.filter(standing, lambda x: ~x["receipt"].eqNullSafe(r) & (x["record_date"] != d["record_date"])))
        return F.concat(left[0], F.array(d))

    kind = own.schema["came"].dataType.simpleString()
    stands = F.aggregate("came", F.array().cast(kind), onward)
    return own.select("company_id", F.explode(stands).alias("x")).select("company_id", *[f"x.{c}" for c in fields])


def industry_snapshot(quotes: DataFrame, stocks: DataFrame) -> DataFrame:
    """One row a ticker of either stream: (ticker, industry, basis, market, code, support, available, source, code_source).

    quotes: (ticker, collected_at, hash, industry, market); stocks: (ticker, collected_at, hash, code). Of each stream the latest row
    counts, ties by hash. An industry is observed in a quote; else inferred where all quoted tickers of the code agree on one, with
    their number as support; else unmapped.
    """

    def latest(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("ticker", "collected_at", "hash")]
        return rows.groupBy("ticker").agg(F.max(F.struct("collected_at", "hash", *rest)).alias(name))

    both = latest(quotes, "q").join(latest(stocks, "s"), "ticker", "full")
    mapping = learn_unanimous(both.where("q is not null and s is not null").select("ticker", F.col("s.code").alias("code"), F.col("q.industry").alias("mapped")), "code", "mapped", "ticker")
    j = both.withColumn("code", F.col("s.code")).join(mapping, "code", "left")
    seen = F.col("q").isNotNull()
    return j.select(
        "ticker", F.when(seen, F.col("q.industry")).otherwise(F.col("mapped")).alias("industry"), F.when(seen, "observed").when(F.col("mapped").isNotNull(), "inferred").otherwise("unmapped").alias("basis"),
        F.col("q.market").alias("market"), "code", F.when(~seen, F.col("support")).alias("support"), F.greatest("q.collected_at", "s.collected_at").alias("available"),
        F.coalesce("q.hash", "s.hash").alias("source"), F.col("s.hash").alias("code_source"),
    )


def price_availability(eligible: DataFrame, prices: DataFrame) -> DataFrame:
    """(session, eligible, missing, invalid, zero_volume, tradable) over eligible cells (session, instrument_id)."""
    j = eligible.join(prices, ["session", "instrument_id"], "left")
    states = {n: F.count_if(F.col("price_state") == n).alias(n) for n in ("invalid", "zero_volume", "tradable")}
    return j.groupBy("session").agg(F.count("*").alias("eligible"), F.count_if(F.col("price_state").isNull()).alias("missing"), *states.values())
