"""The market panel: price states, gaps, returns, exchange rules, liquidity, audits and reference benchmarks.

All windows here run over observed rows of an instrument, partitioned by it: one shuffle serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import obs


@dataclass(frozen=True)
class Regime:
    """Rules in force from a date: tick bands [(price below, tick)], sell tax by market, limit width num / den."""

    start: date
    bands: tuple[tuple[int | None, int], ...]
    sell_tax: dict[str, float]
    limit_num: int
    limit_den: int


def price_state(tolerance: float = 0.01) -> tuple[Column, Column]:
    """(state, reason): invalid prices first, then a rate that disagrees, no volume, an inconsistent range, else tradable."""
    o, h, lo, c, b = (F.col(x) for x in ("open", "high", "low", "close", "base_price"))
    rate = F.abs(F.col("change") / F.when(b > 0, b) * 100 - F.col("fluc_rate")) > tolerance
    order = (h < F.greatest(o, c, lo)) | (lo > F.least(o, c, h))
    reason = (
        F.when((c <= 0) | (b <= 0), "non_positive_close_or_base")
        .when(rate, "fluc_mismatch")
        .when(F.col("volume") == 0, None)
        .when(order, "ohlc_inconsistent")
    )
    state = F.when(reason.isNotNull(), "invalid").when(F.col("volume") == 0, "zero_volume").otherwise("tradable")
    return state, reason


def _by_regime(regimes: list[Regime], day: Column, value) -> Column:
    out = F.lit(None)
    for r in sorted(regimes, key=lambda r: r.start):
        out = F.when(day >= F.lit(r.start), value(r)).otherwise(out)
    return out


def tick_for(price: Column, day: Column, regimes: list[Regime]) -> Column:
    """Tick of a price by the bands in force; a chain of conditions, so no join."""

    def bands(r: Regime) -> Column:
        out = F.lit(r.bands[-1][1]).cast("long")
        for below, tick in reversed(r.bands[:-1]):
            out = F.when(price < below, F.lit(tick).cast("long")).otherwise(out)
        return out

    return _by_regime(regimes, day, bands).cast("long")


def sell_tax_rate(day: Column, market: Column, regimes: list[Regime]) -> Column:
    def rate(r: Regime) -> Column:
        out = F.lit(None).cast("double")
        for m, v in r.sell_tax.items():
            out = F.when(market == m, F.lit(v)).otherwise(out)
        return out

    return _by_regime(regimes, day, rate).cast("double")


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.floor((a - F.pmod(a, b)) / b).cast("long")


def limit_prices(base: Column, base_tick: Column, day: Column, regimes: list[Regime]) -> tuple[Column, Column]:
    """Base price plus and minus the day's limit width, which is snapped down to the base's tick."""
    num = _by_regime(regimes, day, lambda r: F.lit(r.limit_num)).cast("long")
    den = _by_regime(regimes, day, lambda r: F.lit(r.limit_den)).cast("long")
    width = _div(_div(base * num, den), base_tick) * base_tick
    return base + width, F.greatest(base - width, F.lit(0))


def snap_down(price: Column, tick: Column) -> Column:
    return _div(price, tick) * tick


def snap_up(price: Column, tick: Column) -> Column:
    return F.greatest(_div(price + tick - 1, tick) * tick, tick)


def market_panel(bars: DataFrame, regimes: list[Regime]) -> DataFrame:
    """bars (with pos, price_state) plus gaps, returns, rules, limits, locks and liquidity.

    Duplicate keys are not resolved here: see duplicate_keys. The first row of an instrument has no limits. Steps that build
    on each other are kept apart by the windows between them, so that no generated method grows too large.
    """
    w, day = obs(), F.col("session")
    p = bars.withColumn("tick_size", tick_for(F.col("close"), day, regimes)).withColumn("base_tick", tick_for(F.col("base_price"), day, regimes))
    p = p.withColumn("prev_pos", F.lag("pos").over(w)).withColumn("prev_close", F.lag("close").over(w))
    up, down = limit_prices(F.col("base_price"), F.col("base_tick"), day, regimes)
    p = p.withColumn("up", up).withColumn("down", down).withColumn("sell_tax_rate", sell_tax_rate(day, F.col("market"), regimes))
    r = w.rowsBetween(-19, 0)
    p = p.withColumn("adtv20", F.when(F.count("value").over(r) == 20, F.avg("value").over(r)))
    p = p.withColumn("up_tick", tick_for(F.col("up"), day, regimes)).withColumn("down_tick", tick_for(F.col("down"), day, regimes))
    r = w.rowsBetween(-59, 0)
    p = p.withColumn("adtv60", F.when(F.count("value").over(r) == 60, F.avg("value").over(r)))
    p = p.withColumn("first", F.col("prev_pos").isNull()).withColumn("gap_before", F.coalesce(F.col("prev_pos") != F.col("pos") - 1, F.lit(False)))
    valid = ~F.col("first") & (F.col("price_state") != "invalid")
    p = p.withColumn("ret_price", F.when(valid, F.col("change") / F.col("base_price")))
    p = p.withColumn("share_factor", F.when(valid & ~F.col("gap_before"), F.col("prev_close") / F.col("base_price")))
    p = p.withColumn("upper_limit", F.when(~F.col("first"), snap_down(F.col("up"), F.col("up_tick"))))
    p = p.withColumn("lower_limit", F.when(~F.col("first"), snap_up(F.col("down"), F.col("down_tick"))))
    traded = F.col("price_state") == "tradable"
    outside = traded & ((F.col("high") > F.col("upper_limit")) | (F.col("low") < F.col("lower_limit")))
    p = p.withColumn("limits_applicable", ~F.coalesce(F.col("first") | (F.col("price_state") == "invalid") | outside, F.lit(True)))
    lock = F.col("limits_applicable") & traded
    for side in ("open", "close"):
        p = p.withColumn(f"{side}_at_upper", F.coalesce(lock & (F.col(side) == F.col("upper_limit")), F.lit(False)))
        p = p.withColumn(f"{side}_at_lower", F.coalesce(lock & (F.col(side) == F.col("lower_limit")), F.lit(False)))
    return p.drop("prev_close", "prev_pos", "base_tick", "up", "down", "up_tick", "down_tick")


def ret_vol(panel: DataFrame, n: int = 60) -> DataFrame:
    """panel with ret_vol{n}: sample deviation of the last n known returns, carried forward over rows without one."""
    ranked = panel.withColumn("known_rank", F.when(F.col("ret_price").isNotNull(), F.count("ret_price").over(obs())))
    last = Window.partitionBy("instrument_id", F.col("ret_price").isNull()).orderBy("session").rowsBetween(-(n - 1), 0)
    own = F.when(F.col("known_rank") >= n, F.stddev_samp("ret_price").over(last))
    filled = F.last("own_vol", ignorenulls=True).over(obs().rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("own_vol", own).withColumn(f"ret_vol{n}", filled).drop("known_rank", "own_vol")


def join_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """panel with eligible and exclusion_reason; a row the universe lacks is not eligible."""
    joined = panel.join(universe.select("session", "instrument_id", "eligible", "exclusion_reason"), ["session", "instrument_id"], "left")
    return joined.withColumn("exclusion_reason", F.when(F.col("eligible").isNull(), "absent_from_universe").otherwise(F.col("exclusion_reason"))).withColumn(
        "eligible", F.coalesce("eligible", F.lit(False))
    )


def base_adjusted(bars: DataFrame) -> DataFrame:
    """Per session: rows whose base price differs from the close of the session before; a gap resets."""
    before = bars.select("instrument_id", (F.col("pos") + 1).alias("pos"), F.col("close").alias("before"))
    return bars.join(before, ["instrument_id", "pos"]).groupBy("session").agg(F.sum((F.col("base_price") != F.col("before")).cast("long")).alias("adjusted"))


def limitless_moves(panel: DataFrame, cap: float = 0.30) -> DataFrame:
    """Eligible traded rows without applicable limits that moved more than cap, to be audited."""
    move = F.abs(F.col("close") / F.when(F.col("base_price") > 0, F.col("base_price")) - 1)
    rows = panel.where((F.col("price_state") == "tradable") & ~F.col("limits_applicable") & ~F.col("first"))
    return rows.withColumn("move", move).where(F.col("move") > cap)


def instrument_exits(panel: DataFrame) -> DataFrame:
    """Last row of each instrument that ends before the panel does; halted where it had no volume."""
    end = panel.agg(F.max("session").alias("panel_end"))
    last = panel.groupBy("instrument_id").agg(F.max(F.struct("session", "close", "volume")).alias("last"))
    rows = last.join(F.broadcast(end)).where(F.col("last.session") < F.col("panel_end"))
    return rows.select(
        "instrument_id", F.col("last.session").alias("last_session"), F.col("last.close").alias("last_close"),
        F.col("last.volume").alias("last_volume"), F.when(F.col("last.volume") == 0, "halted").otherwise("traded").alias("exit_kind"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rule_gaps(panel: DataFrame) -> DataFrame:
    """Rows that no rule covers."""
    return panel.where(F.col("tick_size").isNull() | F.col("sell_tax_rate").isNull())


def panel_summary(panel: DataFrame) -> DataFrame:
    def n(c: Column) -> Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    return panel.groupBy("market").agg(
        F.count("*").alias("rows"), n(F.col("gap_before")).alias("gaps"), n(F.col("base_price") != F.col("close") - F.col("change")).alias("base_conflicts"),
        n(F.col("close_at_upper")).alias("upper_locks"), n(F.col("close_at_lower")).alias("lower_locks"), n(~F.col("limits_applicable")).alias("limitless"),
        n(F.col("price_state") == "invalid").alias("invalid"), n(F.col("price_state") == "zero_volume").alias("zero_volume"),
    )


def reference_benchmark(panel: DataFrame, calendar: DataFrame, weight: Column, member: Column) -> DataFrame:
    """(session, pos, ret, index_level, log_level, constituents, dropped_weight): members of a session, their return to the next one.

    A member counts only if its next row is on the next calendar session; the weight of the others is dropped. The level is
    a cumulative product over the calendar, one row a session.
    """
    w = obs()
    rows = panel.withColumn("next_pos", F.lead("pos").over(w)).withColumn("next_ret", F.lead("ret_price").over(w)).where(member).withColumn("weight", weight)
    kept = (F.col("next_pos") == F.col("pos") + 1) & F.col("next_ret").isNotNull()
    day = rows.groupBy((F.col("pos") + 1).alias("pos")).agg(
        F.sum(F.when(kept, F.col("weight") * F.col("next_ret"))).alias("num"), F.sum(F.when(kept, F.col("weight"))).alias("den"),
        F.sum(kept.cast("long")).alias("constituents"), F.sum("weight").alias("whole"),
    )
    day = day.join(calendar, "pos").withColumn("ret", F.coalesce(F.try_divide("num", "den"), F.lit(0.0)))
    level = F.sum(F.log1p("ret")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return day.select("session", "pos", "ret", F.exp(level).alias("index_level"), level.alias("log_level"), F.coalesce("constituents", F.lit(0)).alias("constituents"),
                      (1 - F.coalesce(F.try_divide("den", "whole"), F.lit(0.0))).alias("dropped_weight"))
