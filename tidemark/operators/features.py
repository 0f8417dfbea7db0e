"""Dense research grid and rolling features.

Windows here run over the calendar, not over observed rows: an absent session still takes a slot. The grid is partitioned
by instrument once; every feature is a window over that partitioning, so they share one shuffle and one sort. Frames are
ranges of positions, so features need the observed rows only: what is known in an absent session too (levels, the prices of
labels) is the value of the row before, held for the slots up to the next one, and the market's return is a table of days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import grid, lag_ratio, obs, roll_count, roll_max, roll_mean, roll_min, roll_std, roll_sum, shifted


def densify(panel: DataFrame, calendar: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """Every calendar position of every instrument; present tells whether the panel has the row.

    Instruments carry the calendar's positions as a sequence, so the grid is an explode, not a cross join. A caller that has
    the distinct instruments at hand passes them, and the panel is not computed a second time for them.
    """
    last = calendar.agg(F.max("pos").alias("last"))
    named = panel.select("instrument_id").distinct() if instruments is None else instruments
    cells = named.join(F.broadcast(last)).select("instrument_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("pos"))
    return cells.join(panel.withColumn("present", F.lit(True)), ["instrument_id", "pos"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def returns(cells: DataFrame) -> DataFrame:
    """rcc, ron, rid (0 where unknown or not traded) and the cumulative growth adj, 1 before listing."""
    traded = F.coalesce(F.col("volume") > 0, F.lit(False))
    rcc = F.when(F.col("base_price") > 0, F.col("close") / F.col("base_price") - 1)
    c = cells.withColumn("rcc", rcc).withColumn("ron", F.when(traded & (F.col("base_price") > 0), F.col("open") / F.col("base_price") - 1).otherwise(rcc))
    c = c.withColumn("rid", F.when(traded & (F.col("open") > 0), F.col("close") / F.col("open") - 1))
    growth = F.sum(F.log(1 + F.coalesce("rcc", F.lit(0.0)))).over(Window.partitionBy("instrument_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("adj", F.exp(growth)).withColumn("tr", F.when(F.col("present"), F.col("adj")))


def momentum_features() -> dict[str, Column]:
    tr = F.col("tr")

    def mom(far: int, near: int) -> Column:
        past = shifted(tr, far)
        return F.when(past > 0, shifted(tr, near) / past - 1)

    return {"ret_1d": F.col("rcc")} | {f"ret_{k}": lag_ratio(tr, k) for k in (5, 10, 21)} | {f"mom_{k}_21": mom(k, 21) for k in (63, 126, 252)}


def with_held(cells: DataFrame) -> DataFrame:
    """Observed cells with held, the number of slots from a row up to the next one of its instrument."""
    return cells.withColumn("held", F.lead("pos").over(obs(order="pos")) - F.col("pos"))


def level_features() -> dict[str, Column]:
    """Features of adj, which is known in absent sessions too, over observed rows with held: a row's level holds up to the next
    row, and 1 holds before the first. Slots at the head of a window that no row of it covers have the level before the window."""
    px, rows = F.col("adj"), Window.partitionBy("instrument_id").orderBy("pos")

    def before(n: int) -> Column:
        return F.coalesce(F.last(px).over(rows.rangeBetween(Window.unboundedPreceding, -n)), F.lit(1.0))

    def head(n: int) -> Column:
        return F.min("pos").over(grid(n)) - F.greatest(F.col("pos") - (n - 1), F.lit(0))

    def enough(n: int, least: int, value: Column) -> Column:
        return F.when(F.least(F.col("pos") + 1, F.lit(n)) >= least, value)

    def extreme(over, pick, n: int, least: int) -> Column:
        return px / enough(n, least, pick(over(px).over(grid(n)), F.when(head(n) > 0, before(n))))

    def mean(n: int, least: int) -> Column:
        held = F.coalesce(F.sum(px * F.col("held")).over(rows.rangeBetween(-(n - 1), -1)), F.lit(0.0))
        return enough(n, least, (head(n) * before(n) + held + px) / F.least(F.col("pos") + 1, F.lit(n)))

    return {"hi52": extreme(F.max, F.greatest, 252, 126), "lo52": extreme(F.min, F.least, 252, 126), "dist_hi20": extreme(F.max, F.greatest, 20, 10)} | {
        f"dev_ma{w}": px / mean(w, w // 2) - 1 for w in (20, 60, 120)
    }


def volatility_features() -> dict[str, Column]:
    r = F.col("rcc")
    span = F.log(F.col("high") / F.when(F.col("low") > 0, F.col("low")))
    down = F.when(r.isNotNull(), F.least(r, F.lit(0.0)))
    m1, m2, m3 = roll_mean(r, 60, 30), roll_mean(r * r, 60, 30), roll_mean(r * r * r, 60, 30)
    var = F.greatest(m2 - m1 * m1, F.lit(1e-12))
    return {
        "vol20": roll_std(r, 20, 10), "vol60": roll_std(r, 60, 30), "vol_ratio": F.try_divide(roll_std(r, 20, 10), roll_std(r, 60, 30)),
        "pvol20": F.sqrt(roll_mean(span * span / (4 * math.log(2)), 20, 10)), "range20": roll_mean((F.col("high") - F.col("low")) / F.when(F.col("close") > 0, F.col("close")), 20, 10),
        "max21": roll_max(r, 21, 10), "min21": roll_min(r, 21, 10), "skew60": (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.pow(var, 1.5),
        "dvol60": F.sqrt(roll_mean(down * down, 60, 30)),
    }


def session_features() -> dict[str, Column]:
    on, own = F.col("ron"), F.col("rid")
    return {"on20": roll_mean(on, 20, 10), "id20": roll_mean(own, 20, 10), "on60": roll_mean(on, 60, 30), "id60": roll_mean(own, 60, 30), "gap1": on, "absgap20": roll_mean(F.abs(on), 20, 10)}


def liquidity_features() -> dict[str, Column]:
    tv, r = F.col("value"), F.col("rcc")
    mcap = F.when(F.col("market_cap") > 0, F.col("market_cap").cast("double"))
    tv20 = roll_mean(tv, 20, 10)
    return {
        "size": F.log(mcap), "lnadtv": F.log(tv20), "turn20": tv20 / mcap, "vol_surge5_60": F.try_divide(roll_mean(tv, 5, 3), roll_mean(tv, 60)),
        "tv_z1": F.try_divide(tv, tv20), "amihud20": roll_mean(F.when(tv > 0, F.abs(r) / (tv / 1e9)), 20, 10),
        "upvol20": roll_sum(F.when(r > 0, tv), 20) / F.greatest(roll_sum(tv, 20), F.lit(1.0)),
    }


def flow_features(flow: str) -> dict[str, Column]:
    """Flow over market cap; unknown if fewer than 0.6 of a window's values are known."""
    x, mcap = F.col(flow).cast("double"), F.when(F.col("market_cap") > 0, F.col("market_cap").cast("double"))
    return {f"fl_{flow}_{w}": F.when(roll_count(x, w) >= 0.6 * w, roll_sum(x, w) / mcap) for w in (5, 20, 60)}


def with_market_return(cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Observed cells with the cap-weighted market return rm of their position, its mean over the last 60 positions and its variance
    there: caps of the slot before, where cap and return are known. The market is a row a day, so its windows run over the days alone."""
    c = cells.withColumn("prev_cap", shifted(F.when(F.col("market_cap") > 0, F.col("market_cap").cast("double")), 1))
    both = F.col("prev_cap").isNotNull() & F.col("rcc").isNotNull()
    m = c.groupBy("pos").agg(F.coalesce(F.sum(F.when(both, F.col("prev_cap") * F.col("rcc"))), F.lit(0.0)).alias("num"), F.greatest(F.coalesce(F.sum(F.when(both, F.col("prev_cap"))), F.lit(0.0)), F.lit(1.0)).alias("den"))
    days = calendar.select("pos").join(m, "pos", "left").select("pos", F.coalesce(F.col("num") / F.col("den"), F.lit(0.0)).alias("rm"))
    last = Window.orderBy("pos").rangeBetween(-59, 0)
    mean, square = (F.when(F.count("rm").over(last) >= 30, F.avg(x).over(last)) for x in (F.col("rm"), F.col("rm") * F.col("rm")))
    days = days.withColumns({"rm_mean": mean, "rm_var": square - mean * mean})
    return cells.join(F.broadcast(days), "pos")


def market_features() -> dict[str, Column]:
    r, m, var = F.col("rcc"), F.col("rm"), F.col("rm_var")
    beta = F.when(var > 1e-12, (roll_mean(r * m, 60, 30) - roll_mean(r, 60, 30) * F.col("rm_mean")) / var)
    vol = roll_std(r, 60, 30)
    return {"beta60": beta, "ivol60": F.sqrt(F.greatest(vol * vol - beta * beta * var, F.lit(0.0)))}


def labels(horizons: tuple[int, ...] = (5, 10, 21)) -> dict[str, Column]:
    """Open-to-open forward returns over observed rows of unit_open: uo[t + 1 + h] / uo[t + 1] - 1, where a slot without a row has
    the tr of the row before it, up to the calendar's last position."""

    def uo(k: int) -> Column:
        row = F.last(F.struct("pos", "tr", "uo")).over(Window.partitionBy("instrument_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, k))
        return F.when(F.col("pos") + k <= F.col("last"), F.when(row["pos"] == F.col("pos") + k, row["uo"]).otherwise(row["tr"]))

    return {f"y{h}": F.when(uo(1) > 0, uo(1 + h) / uo(1) - 1) for h in horizons}


def unit_open(cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Observed cells with uo, the known growth before a slot times its overnight return, and the calendar's last position."""
    last = calendar.agg(F.max("pos").alias("last"))
    return cells.withColumn("uo", F.lag("tr").over(obs(order="pos")) * (1 + F.coalesce("ron", F.lit(0.0)))).join(F.broadcast(last))


def select_features(cells: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Features of present cells."""
    return cells.withColumns(features).where("present").select("instrument_id", "pos", *features)


def rank_normalize(rows: DataFrame, column: str, least: int) -> DataFrame:
    """(row number - 0.5) / count over known values of a position, ties by instrument; NULL with fewer than least known."""
    w = Window.partitionBy("pos")
    known = F.count(column).over(w)
    n = F.row_number().over(Window.partitionBy("pos", F.col(column).isNull()).orderBy(column, "instrument_id"))
    return rows.withColumn("rank", F.when(F.col(column).isNotNull() & (known >= least), (n - 0.5) / known))


def winsor_z(rows: DataFrame, column: str, low: float, high: float, least: int) -> DataFrame:
    """Value clipped at linear percentiles of its position, less the mean, over the population deviation."""
    # In a fixed order, so that the last digit of a sum does not depend on how rows arrived.
    w = Window.partitionBy("pos").orderBy("instrument_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = rows.groupBy("pos").agg(F.expr(f"percentile({column}, {low})").alias("a"), F.expr(f"percentile({column}, {high})").alias("b"), F.count(column).alias("known"))
    c = rows.join(cut, "pos").withColumn("clipped", F.greatest(F.least(column, "b"), F.when(F.col(column).isNotNull(), F.col("a"))))
    sd = F.stddev_pop("clipped").over(w)
    z = F.when((sd > 1e-12) & (F.col("known") >= least) & F.col(column).isNotNull(), (F.col("clipped") - F.avg("clipped").over(w)) / sd)
    return c.withColumn("z", z).drop("a", "b", "known", "clipped")


def weekly_positions(calendar: DataFrame) -> DataFrame:
    """Last session of each ISO week that has a session after it."""
    nxt = F.lead("session").over(Window.orderBy("pos"))
    week = lambda c: F.extract(F.lit("yearofweek"), c) * 100 + F.weekofyear(c)
    return calendar.withColumn("next", nxt).where(F.col("next").isNotNull() & (week(F.col("next")) != week(F.col("session")))).drop("next")
