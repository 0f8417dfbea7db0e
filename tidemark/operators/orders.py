"""From targets to orders: quantities, costs, fills and values, as stateless table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_orders(targets: DataFrame, holdings: DataFrame, nav: float, buffer: float, band: float) -> DataFrame:
    """(key columns, want, held, order): floor(weight * nav * (1 - buffer) / close) less what is held.

    A name that stays keeps its quantity while the change is inside the band; one that is no target goes to zero.
    """
    keys = ["pos", "instrument_id"]
    j = targets.join(holdings, keys, "full")
    want = F.coalesce(F.floor(F.col("weight") * nav * (1 - buffer) / F.when(F.col("close") > 0, F.col("close"))), F.lit(0)).cast("long")
    held = F.coalesce("held", F.lit(0)).cast("long")
    j = j.select(*keys, want.alias("want"), held.alias("held"))
    stays = (F.col("want") > 0) & (F.col("held") > 0) & (F.abs(F.col("want") - F.col("held")) <= F.col("held") * band)
    return j.withColumn("order", F.when(stays, 0).otherwise(F.col("want") - F.col("held")).cast("long"))


def fill_cost(notional: Column, rate: Column) -> Column:
    """Whole won of a rate on a notional, floored in decimal arithmetic."""
    return F.floor(notional.cast("decimal(28,2)") * rate.cast("decimal(18,8)")).cast("long")


def impact(k: float, vol: Column, notional: Column, adtv: Column) -> Column:
    return F.lit(k) * vol * F.sqrt(F.try_divide(notional, adtv))


def nearest_toward_zero(x: Column) -> Column:
    """Nearest integer, ties toward zero."""
    return (F.signum(x) * F.ceil(F.abs(x) - 0.5)).cast("long")


def contract_target(fraction: Column, signal: Column, cap: Column, nav: Column, multiplier: Column, level: Column) -> Column:
    """Contracts for a share of the value, to the nearest integer, ties toward zero; NULL where the level is not positive. Decimal, so that a tie is one."""
    money = fraction.cast("decimal(12,6)") * signal.cast("decimal(6,3)") * cap.cast("decimal(6,3)")
    x = F.try_divide((money * nav.cast("decimal(14,2)")).cast("decimal(34,9)"), (multiplier.cast("decimal(9,0)") * F.when(level > 0, level.cast("decimal(12,2)"))).cast("decimal(21,2)"))
    return nearest_toward_zero(x)


def portfolio_value(holdings: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Value per key, and held names without a price, which make it an error."""
    j = holdings.join(prices, ["pos", "instrument_id"], "left")
    return j.groupBy(key).agg(F.sum(F.col("held") * F.col("close")).alias("value"), F.sum(F.col("close").isNull().cast("long")).alias("unpriced"))


def order_fill_estimate(orders: DataFrame, next_rows: DataFrame, participation: float) -> DataFrame:
    """Reject reason and filled quantity of each order against the instrument's next row."""
    j = orders.join(next_rows, ["pos", "instrument_id"], "left")
    size = F.abs("order")
    cap = F.floor(F.col("n_volume") * participation)
    reason = (
        F.when(F.col("n_open").isNull(), "missing_price").when(F.col("n_volume") == 0, "halted")
        .when((F.col("order") > 0) & F.col("n_open_at_upper"), "limit_locked").when((F.col("order") < 0) & F.col("n_open_at_lower"), "limit_locked")
        .when(cap < 1, "capacity")
    )
    return j.select("pos", "instrument_id", "order", reason.alias("reject"), F.when(reason.isNull(), F.least(size, cap)).otherwise(0).cast("long").alias("filled"))


def priced_orders(orders: DataFrame, rows: DataFrame, participation: float, k: float, extra: float, slip_ticks: float, tick: Column) -> DataFrame:
    """Orders (instrument_id, pos, side, quantity) decided at pos, in the opening auction of pos + 1: filled, price, reject and, of a part, rest.

    rows: (instrument_id, pos, open, close, volume, upper_limit, lower_limit, open_at_upper, open_at_lower, entry_blocked, adtv20, ret_vol60 and what
    `tick` reads). The first reason that holds rejects: missing_price, halted, entry_blocked for a purchase, missing_price of an open
    that is not positive, limit_locked on the order's side, capacity, no_volatility. Capacity is a share of the decision day's adtv20 at its close; an
    order beyond it is filled in part and its rest rejected. The price moves against the order by impact, extra and ticks, is rounded against it to
    whole won, and stays within the day's limits.
    """
    keys = ["instrument_id", "pos"]
    decided = rows.select(*keys, F.col("close").alias("d_close"), F.col("adtv20").alias("d_adtv"), F.col("ret_vol60").alias("d_vol"))
    opened = rows.withColumns({"tick": tick, "pos": F.col("pos") - 1}).select(*keys, "open", "volume", "upper_limit", "lower_limit", "open_at_upper", "open_at_lower", "entry_blocked", "tick", F.lit(True).alias("there"))
    j = orders.join(opened, keys, "left").join(decided, keys, "left")
    buy = F.col("side") == "buy"
    cap = F.coalesce(F.when((F.col("d_adtv") > 0) & (F.col("d_close") > 0), F.floor(participation * F.col("d_adtv") / F.col("d_close"))), F.lit(0)).cast("long")
    reject = (
        F.when(F.col("there").isNull(), "missing_price").when(F.col("volume") == 0, "halted").when(buy & F.coalesce("entry_blocked", F.lit(False)), "entry_blocked")
        .when(~F.coalesce(F.col("open") > 0, F.lit(False)), "missing_price").when(F.when(buy, F.col("open_at_upper")).otherwise(F.col("open_at_lower")), "limit_locked")
        .when(cap <= 0, "capacity").when(F.col("d_vol").isNull() | F.isnan("d_vol"), "no_volatility")
    )
    j = j.withColumns({"cap": cap, "reject": reject})
    filled = F.when(F.col("reject").isNull(), F.least("quantity", "cap")).otherwise(0)
    j = j.withColumn("filled", filled.cast("long"))
    base = F.col("open").cast("double")
    move = impact(k, F.col("d_vol"), F.col("filled") * base, F.col("d_adtv")) + extra
    up = F.least(F.ceil(base * (1.0 + move) + slip_ticks * F.col("tick")), F.coalesce("upper_limit", F.lit(2**62)))
    down = F.greatest(F.floor(base * (1.0 - move) - slip_ticks * F.col("tick")), F.coalesce("lower_limit", F.lit(1)), F.lit(1))
    price = F.when(F.col("filled") > 0, F.when(buy, up).otherwise(down)).cast("long")
    rest = F.when(F.col("reject").isNull(), F.col("quantity") - F.col("filled")).otherwise(F.col("quantity"))
    return j.select(*orders.columns, "filled", price.alias("price"), F.coalesce("reject", F.when(F.col("filled") < F.col("quantity"), "capacity")).alias("reject"), rest.cast("long").alias("rest"))
