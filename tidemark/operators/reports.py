"""Report cards, challenges of a champion, changed knobs and slippage of fills."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_integrity(streams: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """(keys, aligned): whether a stream has a finite return at each expected position (pos) and at no other."""
    n = expected.agg(F.count_distinct("pos").alias("expected"))
    finite = F.col("log_return").isNotNull() & ~F.isnan("log_return") & (F.abs("log_return") != float("inf"))
    j = streams.join(expected.select("pos", F.lit(True).alias("due")).distinct(), "pos", "left")
    seen = j.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("pos").alias("places"), F.count_if(finite & F.coalesce("due", F.lit(False))).alias("good"))
    return seen.join(n).select(*keys, ((F.col("rows") == F.col("expected")) & (F.col("places") == F.col("rows")) & (F.col("good") == F.col("rows"))).alias("aligned"))


def report_card(profiles: DataFrame, integrity: DataFrame, mismatches: DataFrame, stress: list[str], most_deep: float, most_loss: float) -> DataFrame:
    """(run, objective_stream, objective, p_deep, p_loss, failed, passed): the objective is the lower quantile of the worse stress stream.

    profiles: (run, stream, g_low, p_deep, p_loss); integrity: (run, stream, aligned); mismatches: (run, mismatches) of a causality
    check. Of two stress streams with one quantile the first named counts; one without a quantile is worst of all. Both guards read
    the chosen stream, and an unknown value passes none. Failed lists what fails by name, in order.
    """
    at = F.array_position(F.array(*map(F.lit, stress)), F.col("stream"))
    known = profiles.where(F.col("stream").isin(*stress))
    worst = F.min(F.struct(F.col("g_low").isNotNull().alias("known"), "g_low", at.alias("place"), "stream", "p_deep", "p_loss"))
    j = known.groupBy("run").agg(worst.alias("w")).select("run", F.col("w.stream").alias("objective_stream"), F.col("w.g_low").alias("objective"), "w.p_deep", "w.p_loss")
    bad = integrity.where(~F.coalesce("aligned", F.lit(False))).groupBy("run").agg(F.array_sort(F.collect_list(F.concat(F.lit("integrity_"), "stream"))).alias("unaligned"))
    j = j.join(bad, "run", "left").join(mismatches, "run", "left")
    checks = F.array(
        F.when(~F.coalesce(F.col("mismatches") == 0, F.lit(False)), "perturbation_mismatches"), F.when(~F.coalesce(F.col("p_deep") <= most_deep, F.lit(False)), "p_deep"),
        F.when(~F.coalesce(F.col("p_loss") <= most_loss, F.lit(False)), "p_loss"),
    )
    failed = F.concat(F.array_compact(checks), F.coalesce("unaligned", F.array().cast("array<string>")))
    return j.withColumn("failed", failed).select("run", "objective_stream", "objective", "p_deep", "p_loss", "failed", (F.size("failed") == 0).alias("passed"))


def quantile_at(values: Column, share: Column) -> Column:
    """Linear quantile of an array at a share that may differ from row to row; NULL of none."""
    ordered = F.sort_array(values)
    place = share * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


def challenge_deltas(outcomes: DataFrame, key: str, family: DataFrame, alpha: float) -> DataFrame:
    """(key, alpha, growth_mean, growth_lower, tail_mean, tail_lower) of paired draws (key, draw, growth, tail).

    family: (key, prior), the decisions taken before on the same champion; a bound is at alpha / (1 + prior), which keeps the chance
    of one false promotion in the whole family at alpha. A key's draws are as many as the bootstrap has, so they fit an array.
    """
    own = outcomes.groupBy(key).agg(F.collect_list("growth").alias("g"), F.collect_list("tail").alias("t"), F.avg("growth").alias("growth_mean"), F.avg("tail").alias("tail_mean"))
    return challenge_bounds(own, key, family, alpha)


def challenge_bounds(own: DataFrame, key: str, family: DataFrame, alpha: float) -> DataFrame:
    """challenge_deltas of the draws as arrays (key, g, t, growth_mean, tail_mean), a row a key."""
    level = F.lit(alpha) / (1 + F.col("prior"))
    j = own.join(family.select(key, "prior"), key)
    return j.select(key, level.alias("alpha"), "growth_mean", quantile_at(F.col("g"), level).alias("growth_lower"), "tail_mean", quantile_at(F.col("t"), level).alias("tail_lower"))


def challenge_decision(challengers: DataFrame, neighbours: DataFrame, changes: DataFrame, margin: float | None, exempt: tuple[str, ...] = ("scorer.",)) -> DataFrame:
    """challengers with path (superiority, noninferiority or none) and the reasons against, sorted within their kind.

    challengers: (challenger, passed, objective, champion_objective, growth_lower, tail_lower); neighbours: (challenger, neighbour, knob,
    growth_mean, tail_mean); changes: (challenger, knob). A changed knob needs a neighbour unless its name begins as exempt. Superior is a
    lower bound over 0 with every neighbour better; not inferior is one over -margin with a tail that is better, here and in every neighbour.
    """

    def reasons(rows: DataFrame, text: Column, name: str) -> DataFrame:
        return rows.groupBy("challenger").agg(F.array_sort(F.collect_set(text)).alias(name))

    covered = neighbours.select("challenger", "knob").distinct()
    free = F.lit(False)
    for e in exempt:
        free = free | F.col("knob").startswith(e)
    missing = reasons(changes.where(~free).join(covered, ["challenger", "knob"], "left_anti"), F.concat(F.lit("neighbours_missing:"), "knob"), "missing")
    # Neighbours count where something changed.
    near = neighbours.join(changes.select("challenger").distinct(), "challenger", "left_semi")

    def not_over(c: str, least: float) -> Column:
        return ~F.coalesce(F.col(c) > least, F.lit(False))

    sup = reasons(near.where(not_over("growth_mean", 0.0)), F.concat(F.lit("superiority:neighbour_not_better:"), "neighbour"), "near_sup")
    j = challengers.join(missing, "challenger", "left").join(sup, "challenger", "left")
    none = F.array().cast("array<string>")
    base = F.concat(
        F.array_compact(F.array(F.when(~F.coalesce("passed", F.lit(False)), "report_failed"), F.when(~F.coalesce(F.col("objective") >= F.col("champion_objective"), F.lit(False)), "objective"))), F.coalesce("missing", none)
    )
    superior = F.concat(F.array_compact(F.array(F.when(not_over("growth_lower", 0.0), "superiority:lower_bound"))), F.coalesce("near_sup", none))
    if margin is None:
        inferior, allowed = none, F.lit(False)
    else:
        grew = reasons(near.where(not_over("growth_mean", -margin)), F.concat(F.lit("noninferiority:neighbour_growth:"), "neighbour"), "near_growth")
        tail = reasons(near.where(not_over("tail_mean", 0.0)), F.concat(F.lit("noninferiority:neighbour_tail:"), "neighbour"), "near_tail")
        j = j.join(grew, "challenger", "left").join(tail, "challenger", "left")
        own = F.array_compact(F.array(F.when(not_over("growth_lower", -margin), "noninferiority:growth_margin"), F.when(not_over("tail_lower", 0.0), "noninferiority:tail_bound")))
        inferior = F.concat(own, F.coalesce("near_growth", none), F.coalesce("near_tail", none))
        allowed = F.size("inferior") == 0
    j = j.withColumns({"base": base, "superior": superior, "inferior": inferior})
    sound = F.size("base") == 0
    path = F.when(sound & (F.size("superior") == 0), "superiority").when(sound & allowed, "noninferiority").otherwise("none")
    out = j.withColumn("path", path)
    against = F.when(F.col("path") == "none", F.concat("base", "superior", "inferior")).otherwise(F.col("base"))
    return out.select(*challengers.columns, "path", against.alias("reasons"))


def _distinct(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(own := dict(pairs)) < len(pairs):
        raise ValueError("a name comes twice")
    return own


def _no_number(text: str) -> float:
    raise ValueError(f"{text} is no JSON")


_SPECS = json.JSONDecoder(object_pairs_hook=_distinct, parse_int=float, parse_constant=_no_number)


def numeric_leaves(text: str | None, depth: int = 6) -> dict[str, list[float]]:
    """Numbers of a JSON spec by dotted path, at most `depth` objects deep; a deeper number is an error.

    Texts, truth values, lists and nulls have no neighbourhood and are no leaves; a text that is no JSON has none. Names with a dot
    may give one path twice.
    """
    try:
        level = [("", _SPECS.decode(text))] if text is not None else []
    except ValueError:
        return {}
    found: dict[str, list[float]] = {}
    for step in range(depth + 1):
        inner = []
        for path, v in level:
            if isinstance(v, float):
                found.setdefault(path, []).append(v)
            elif isinstance(v, dict):
                if v and step == depth:
                    raise ValueError("a spec is nested too deeply")
                inner += ((f"{path}.{k}" if path else k, x) for k, x in v.items())
        level = inner
    return found


def knob_changes(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, path, was, now): numeric leaves of two JSON specs that differ, or that only one of them has. A pair is one row, so nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, was, now = [], [], [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                old, new = numeric_leaves(a), numeric_leaves(b)
                for path in old | new:
                    for w in old.get(path, (None,)):
                        for n in new.get(path, (None,)):
                            if w != n:
                                at.append(i), paths.append(path), was.append(w), now.append(n)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(was, pa.float64()), pa.array(now, pa.float64())]
            yield pa.record_batch(columns, names=[key, "path", "was", "now"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, right, left).mapInArrow(run, f"`{key}` {kind}, path string, was double, now double")


def slippage_table(fills: DataFrame, auction: DataFrame, market: DataFrame, offsets: list[int], tick: Column, printed: str = "open", expected: str = "expected") -> DataFrame:
    """One row a fill: its price against the official and the captured open and against what was expected before it, in ticks against the trader.

    fills: (session, instrument_id, side, quantity, price); auction: (session, instrument_id, kind open or expected, offset, payload of JSON with a
    price under `printed` or `expected`); market: (session, instrument_id, open, market, adtv20); tick: the tick of the official open. An open
    that is not positive is absent. Expected prices are set against the captured open, or else the official one.
    """
    price = F.when(F.col("kind") == "open", F.get_json_object("payload", f"$.{printed}")).otherwise(F.get_json_object("payload", f"$.{expected}")).try_cast("bigint")
    quotes = auction.withColumn("p", price).where("p > 0")
    said = [F.max(F.when((F.col("kind") == "expected") & (F.col("offset") == o), F.col("p"))).alias(str(o)) for o in offsets]
    heard = quotes.groupBy("session", "instrument_id").agg(F.max(F.when(F.col("kind") == "open", F.col("p"))).alias("captured_open"), *said)
    official = market.where("open > 0").withColumn("tick", tick).select("session", "instrument_id", F.col("open").alias("official_open"), "adtv20", "tick")
    keys = ["session", "instrument_id"]
    j = fills.join(official, keys, "left").join(heard, keys, "left")
    against = F.when(F.col("side") == "buy", 1).otherwise(-1)
    anchor = F.coalesce("captured_open", "official_open")
    drifts = [(against * (F.col(f"`{o}`") - anchor) / F.col("tick")).alias(f"expected_minus_open_ticks_m{abs(o)}") for o in offsets]
    return j.select(
        *fills.columns, "official_open", "captured_open", "tick", (against * (F.col("price") - F.col("official_open")) / F.col("tick")).alias("model_minus_open_ticks"),
        F.when(F.col("adtv20") > 0, F.col("quantity") * F.col("price") / F.col("adtv20")).alias("notional_over_adtv20"),
        F.coalesce(F.abs(F.col("captured_open") - F.col("official_open")) >= F.col("tick"), F.lit(False)).alias("open_mismatch"), *drifts,
    )
