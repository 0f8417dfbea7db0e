"""Scores to weights, series on a calendar, supplements, contracts and causality: rules over joins, windows and sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract_violations(rows: DataFrame, payload: str, required: list[str], envelope: list[str] | None = None, query: tuple[str, list[str]] | None = None) -> DataFrame:
    """rows with what their contract misses: required fields of the JSON payload, then, marked as such, blank columns of the envelope's
    identity and fields of the JSON query they answer. A text that is no object lacks all of its fields."""

    def lacking(text: str, fields: list[str]) -> Column:
        keys = F.coalesce(F.map_keys(F.from_json(text, "map<string,string>")), F.array().cast("array<string>"))
        return F.array_sort(F.array_except(F.array(*map(F.lit, fields)), keys))

    parts = [lacking(payload, required)]
    if envelope:
        blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"envelope:{c}") for c in envelope]
        parts.append(F.array_compact(F.array(*blank)))
    if query:
        parts.append(F.transform(lacking(*query), lambda f: F.concat(F.lit("query:"), f)))
    return rows.withColumn("missing", F.array_join(F.concat(*parts), ",")).where("missing <> ''")


def keyed_lookup(latest: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of many wanted keys; which side is broadcast is left to the optimiser."""
    return latest.join(wanted.select(*keys).distinct(), keys)


def listed_series(levels: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Each series on the calendar: (key, pos, level, state), unlisted before its first level, missing where one is due, else known."""
    first = levels.groupBy(key).agg(F.min("pos").alias("first_pos"))
    cells = first.join(F.broadcast(calendar.select("pos"))).join(levels.select(key, "pos", "level"), [key, "pos"], "left")
    state = F.when(F.col("pos") < F.col("first_pos"), "unlisted").when(F.col("level") > 0, "known").otherwise("missing")
    return cells.select(key, "pos", "level", state.alias("state"))


def single_rows(rows: DataFrame, calendar: DataFrame, price: str) -> DataFrame:
    """Sessions that do not have exactly one row with a positive price."""
    seen = rows.groupBy("session").agg(F.count("*").alias("rows"), F.min(price).alias("least"))
    j = calendar.select("session").join(seen, "session", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return j.where((F.col("rows") != 1) | ~(F.coalesce(F.col("least"), F.lit(0)) > 0)).select("session", "rows")


def quality_counts(flows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows of each key and how many of them meet each check; an unknown check is not met."""
    return flows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in checks.items()])


def flow_checks(parts: list[str], total: str, retail: str, volume: str, conflict: str, tail: str) -> dict[str, Column]:
    """The checks of a flow row: values that pages disagree on, parts that miss their total, a session whose flow is not due yet, no date, and more
    retail than was traded."""
    held = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return {
        "conflict": F.col(conflict), "identity": held != F.col(total), "tail": F.col(tail), "dateless": F.col("session").isNull(), "retail_over_volume": F.abs(retail) > F.col(volume),
    }


def supplement(gaps: DataFrame, pages: DataFrame, keys: list[str], values: list[str], source: str) -> DataFrame:
    """Gap cells filled from pages whose values sum to 0 and all agree, with the smallest source hash."""
    total = sum((F.col(v) for v in values), F.lit(0))
    sound = pages.where(total == 0).join(gaps.select(*keys).distinct(), keys, "left_semi")
    cells = sound.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("kinds"), F.first(F.struct(*values)).alias("v"), F.min(source).alias(source))
    return cells.where("kinds = 1").select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], source)


def disjoint_union(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(union, shared keys, each of which is an error)."""
    return a.unionByName(b, allowMissingColumns=True), a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)


def exit_index(last: DataFrame, end: Column, key: str) -> DataFrame:
    """Position from which an instrument is gone, and whether it was halted on its last; none for those there at the end."""
    return last.where(F.col("last_pos") < end).select(key, (F.col("last_pos") + 1).alias("exit_pos"), (F.col("last_volume") == 0).alias("halted"))


def reference_integrity(events: DataFrame, instruments: DataFrame, key: str) -> DataFrame:
    """Events that name an instrument outside the panel, counted by instrument."""
    return events.join(instruments.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("events"))


def tail_cells(cells: DataFrame, first: int, key: str) -> DataFrame:
    """Cells from position first on, of instruments present there, with positions counted from 0."""
    tail = cells.where(F.col("pos") >= first)
    return tail.join(tail.select(key).distinct(), key).withColumn("tail_pos", F.col("pos") - first)


def ensemble_average(scores: DataFrame, least: int = 1) -> DataFrame:
    """(pos, instrument_id, score): z-scores of each horizon and seed at a position, averaged over horizons, then over seeds.

    Unknown scores are left out of means; a member without spread, or with fewer than `least` known scores at the position, gives none.
    """
    # In a fixed order, so that the last digit of a sum does not depend on how rows arrived.
    w = Window.partitionBy("pos", "horizon", "seed").orderBy("instrument_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = F.when((F.stddev_pop("score").over(w) > 1e-12) & (F.count("score").over(w) >= least), F.stddev_pop("score").over(w))
    z = F.try_divide(F.col("score") - F.avg("score").over(w), spread)
    by_seed = scores.withColumn("z", z).groupBy("pos", "instrument_id", "seed").agg(F.avg("z").alias("z"))
    return by_seed.groupBy("pos", "instrument_id").agg(F.avg("z").alias("score"))


def trend_weights(picks: DataFrame, n: int, mode: str, fraction: float = 0.5, cap: float = 1.5) -> DataFrame:
    """picks (pos, ..., passes) with weight: 1/n if both legs pass; else 0, fraction/n, or the rest shared out up to cap/n."""
    if mode == "drop":
        weight = F.when(F.col("passes"), 1 / n).otherwise(0.0)
    elif mode == "fraction":
        weight = F.when(F.col("passes"), 1 / n).otherwise(fraction / n)
    elif mode == "redistribute":
        m = F.sum(F.col("passes").cast("int")).over(Window.partitionBy("pos"))
        weight = F.when(F.col("passes"), F.least(1 / m, F.lit(cap / n))).otherwise(0.0)
    else:
        raise ValueError(f"no such mode: {mode}")
    return picks.withColumn("weight", weight)


def combine_sleeves(decisions: DataFrame, positions: DataFrame, sleeves: int) -> DataFrame:
    """(pos, instrument_id, weight): mean over sleeves of the last targets at or before each position; names not in them count 0.

    decisions: (sleeve, pos, instrument_id, weight). A decision holds from its position to the next of its sleeve.
    """
    days = decisions.select("sleeve", "pos").distinct()
    until = F.lead("pos").over(Window.partitionBy("sleeve").orderBy("pos"))
    end = positions.agg((F.max("pos") + 1).alias("end"))
    held = days.withColumn("until", until).join(F.broadcast(end)).where("pos < end")
    spans = held.select("sleeve", F.col("pos").alias("decided"), F.explode(F.sequence(F.col("pos"), F.coalesce("until", "end") - 1)).alias("pos"))
    spans = spans.join(F.broadcast(positions.select("pos").distinct()), "pos")
    own = decisions.select("sleeve", F.col("pos").alias("decided"), "instrument_id", "weight")
    return spans.join(own, ["sleeve", "decided"]).groupBy("pos", "instrument_id").agg((F.sum("weight") / sleeves).alias("weight"))


def capture_symbols(weights: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """Per decision the names to watch, up to limit: those whose weight changes, by the size of the change, then unchanged held ones by weight.

    weights: (pos, instrument_id, weight), compared with those of the decision before, whatever its position; held: (pos,
    instrument_id). Ties go by name. A limit that is the feature: capture has a fixed number of slots.
    """
    days = weights.select("pos").distinct()
    after = days.select(F.col("pos").alias("was_pos"), F.lead("pos").over(Window.orderBy("pos")).alias("pos")).where("pos is not null")
    before = weights.withColumnRenamed("pos", "was_pos").join(after, "was_pos").select("pos", "instrument_id", F.col("weight").alias("was"))
    owned = held.select("pos", "instrument_id", F.lit(True).alias("held")).distinct().join(days, "pos")
    j = weights.join(before, ["pos", "instrument_id"], "full").join(owned, ["pos", "instrument_id"], "full").na.fill(0.0, ["weight", "was"])
    j = j.withColumn("change", F.abs(F.col("weight") - F.col("was"))).where("change <> 0 or held")
    still = F.col("change") == 0
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("change"), F.when(still, -F.col("weight")), "instrument_id"))
    return j.withColumn("rank", rank).where(F.col("rank") <= limit)


def overlay_fractions(signals: DataFrame, cap: float, target: float, most: float) -> DataFrame:
    """signals (..., signal, vol) with the trend signal, its volatility scale and, for a negative signal, the hedge fraction.

    Where the volatility is unknown the trend signal is 0 and the scale 1, and nothing is hedged; without volatility the
    scale is 1 and the hedge at its most.
    """
    vol, signal = F.col("vol"), F.coalesce("signal", F.lit(0.0))
    size = F.when(vol <= 0, F.lit(most)).otherwise(F.least(F.lit(most), target / vol))
    return signals.withColumns({
        "trend_signal": F.when(vol.isNull(), 0.0).otherwise(signal),
        "vol_scale": F.when(vol > cap, cap / vol).otherwise(1.0),
        "regime_fraction": F.when((signal < 0) & vol.isNotNull(), size * F.abs(signal)).otherwise(0.0),
    })


def causality_mismatches(
    rows: DataFrame, compute: Callable[[DataFrame], DataFrame], corrupt: Callable[[DataFrame], DataFrame], cut: int, keys: list[str], families: dict[str, list[str]]
) -> DataFrame:
    """(what, cells, mismatches) for each family of computed columns: cells up to the cut, and those where a column changes when inputs after it are
    corrupted: there must be none. Families that are computed together are compared together."""

    def computed(df: DataFrame, side: str) -> DataFrame:
        return compute(df).where(F.col("pos") <= cut).select(*keys, *[F.struct(*c).alias(f"{side}{i}") for i, c in enumerate(families.values())])

    j = computed(rows, "a").join(computed(corrupt(rows), "b"), keys, "full")
    differs = [F.sum((~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).cast("long")).alias(f"d{i}") for i in range(len(families))]
    found = j.agg(F.count("*").alias("cells"), *differs)
    each = F.array(*[F.struct(F.lit(n).alias("what"), "cells", F.col(f"d{i}").alias("mismatches")) for i, n in enumerate(families)])
    return found.select(F.explode(each).alias("x")).select("x.*")
