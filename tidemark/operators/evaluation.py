"""Return streams: point metrics, drawdowns, block bootstrap, paired comparisons, betas, chains and reconciliation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def point_metrics(streams: DataFrame, key: str) -> DataFrame:
    """Growth, cagr, sharpe, max drawdown and calmar of log returns (key, pos, log_return)."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    walk = streams.withColumn("level", F.sum("log_return").over(w))
    walk = walk.withColumn("dd", F.exp(F.col("level") - F.greatest(F.max("level").over(w), F.lit(0.0))) - 1)
    m = walk.groupBy(key).agg(F.avg("log_return").alias("mean"), F.stddev_samp("log_return").alias("sd"), F.min("dd").alias("max_drawdown"), F.count("*").alias("n"))
    growth = F.col("mean") * 252
    return m.select(
        key, "n", growth.alias("growth"), (F.exp(growth) - 1).alias("cagr"), F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * math.sqrt(252)).otherwise(0.0).alias("sharpe"),
        F.least("max_drawdown", F.lit(0.0)).alias("max_drawdown"), F.when(F.col("max_drawdown") < 0, (F.exp(growth) - 1) / -F.col("max_drawdown")).alias("calmar"),
    )


def longest_underwater(streams: DataFrame, key: str) -> DataFrame:
    """Longest run of positions below the running peak, which starts at 1; a level that only rounding puts below it is at the peak."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = streams.withColumn("level", F.sum("log_return").over(w))
    s = s.withColumn("under", F.col("level") < F.greatest(F.max("level").over(w), F.lit(0.0)) - 1e-12)
    s = s.withColumn("island", F.sum((~F.col("under")).cast("int")).over(w))
    runs = s.groupBy(key, "island").agg(F.sum(F.col("under").cast("long")).alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("longest"))


def bootstrap_starts(lengths: DataFrame, key: str, draws: int, horizon: int, block: int, seed: int) -> DataFrame:
    """(key, draw, k, start): uniform block starts in [0, n - block], from hashes of seed, draw and place."""
    blocks = math.ceil(horizon / block)
    grid = lengths.where(F.col("n") >= block).select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    grid = grid.select(key, "n", "draw", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"))
    return grid.select(key, "draw", "k", F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.col("n") - block + 1).alias("start"))


def block_bootstrap(streams: DataFrame, starts: DataFrame, key: str, horizon: int, block: int) -> DataFrame:
    """(key, draw, i, log_return): resampled paths; the last block is cut at the horizon.

    Positions count from 0 without gaps, so a block is a slice of its stream's array: streams meet their starts by key alone, and no row of a
    path is shuffled.
    """
    own = streams.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "log_return"))).alias("own"))
    cut = F.least(F.lit(block), horizon - F.col("k") * block).cast("int")
    blocks = starts.where(F.col("k") * block < horizon).join(own, key)
    steps = blocks.select(key, "draw", "k", F.posexplode(F.slice(F.col("own")["log_return"], F.col("start").cast("int") + 1, cut)).alias("o", "log_return"))
    return steps.select(key, "draw", (F.col("k") * block + F.col("o")).alias("i"), "log_return")


def growth_profile(paths: DataFrame, key: str, low: float, limit: float) -> DataFrame:
    """Quantile and median of annual growth, chances of a loss and of a drawdown beyond limit, over draws."""
    w = Window.partitionBy(key, "draw").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = paths.withColumn("level", F.sum("log_return").over(w))
    p = p.withColumn("dd", F.exp(F.col("level") - F.greatest(F.max("level").over(w), F.lit(0.0))) - 1)
    return outcome_profile(p.groupBy(key, "draw").agg((F.avg("log_return") * 252).alias("g"), F.min("dd").alias("mdd")), key, low, limit)


def outcome_profile(outcomes: DataFrame, key: str, low: float, limit: float) -> DataFrame:
    """growth_profile of draws (key, draw, g, mdd)."""
    return outcomes.groupBy(key).agg(
        F.expr(f"percentile(g, {low})").alias("g_low"), F.expr("percentile(g, 0.5)").alias("g_median"), F.avg((F.col("g") <= 0).cast("double")).alias("p_loss"),
        F.avg((F.col("mdd") < limit).cast("double")).alias("p_deep"), F.expr("percentile(mdd, 0.5)").alias("mdd_median"), F.count("*").alias("draws"),
    )


def _block_shapes(x: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each block of x: its sum, its highest and lowest level, and its deepest fall from a level of its own."""
    levels = np.cumsum(np.lib.stride_tricks.sliding_window_view(x, length), axis=1)
    peaks = np.maximum.accumulate(levels, axis=1)
    return levels[:, -1], peaks[:, -1], levels.min(axis=1), (levels - peaks).min(axis=1)


def _streams(streams: DataFrame, key: str, names: list[str], block: int) -> DataFrame:
    """(key, *names): each stream's returns by pos; those shorter than a block go."""
    own = F.sort_array(F.collect_list(F.struct("pos", *names)))
    long = streams.groupBy(key).agg(own.alias("own")).where(F.size("own") >= block)
    return long.select(key, *[F.col("own")[c].alias(c) for c in names])


def _hashes(spark: SparkSession, draws: int, blocks: int, seed: int) -> np.ndarray:
    """The hashes that bootstrap_starts takes its starts from, a row a draw: they are alike for all streams, so tasks get them as one small table."""
    row = spark.range(draws).select("id", F.array(*[F.xxhash64(F.lit(seed), F.col("id").cast("int"), F.lit(k)) for k in range(blocks)]).alias("h"))
    return np.array([r.h for r in row.orderBy("id").collect()], dtype=np.int64).reshape(draws, blocks)


def _by_stream(streams: DataFrame, key: str, hashes: np.ndarray, block: int, chunk: int, outcomes: Callable[..., list[np.ndarray]], finish: Callable[..., pa.RecordBatch], kinds: str) -> DataFrame:
    """(key, kinds): finish(keys, results) over the streams of a batch, a result being an array of draws for each name of outcomes(starts, *returns).

    All draws of a stream are one unit, taken chunk at a time; no row a draw leaves the task unless finish makes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for i in range(batch.num_rows):
                own = [np.array(c[i].values) for c in batch.columns[1:]]
                parts = [outcomes(np.mod(hashes[at : at + chunk], len(own[0]) - block + 1), *own) for at in range(0, len(hashes), chunk)]
                results.append([np.concatenate(x) for x in zip(*parts, strict=True)])
            if results:
                yield finish(batch.column(0), results)

    kind = streams.schema[key].dataType.simpleString()
    return streams.mapInArrow(run, f"`{key}` {kind}, {kinds}")


def _draw_rows(key: str, names: list[str]) -> tuple[Callable[..., pa.RecordBatch], str]:
    """A row a draw: (key, draw, *names)."""

    def finish(keys: pa.Array, results: list[list[np.ndarray]]) -> pa.RecordBatch:
        draws = len(results[0][0])
        own = keys.take(pa.array(np.repeat(np.arange(len(results)), draws)))
        draw = np.tile(np.arange(draws, dtype=np.int32), len(results))
        return pa.record_batch([own, pa.array(draw), *(pa.array(np.concatenate([r[c] for r in results])) for c in range(len(names)))], names=[key, "draw", *names])

    return finish, ", ".join(["draw int", *(f"{c} double" for c in names)])


def _profile_rows(key: str, columns: dict[str, Callable[..., float]]) -> tuple[Callable[..., pa.RecordBatch], str]:
    """A row a stream: a number for each column, of the arrays of its draws, and the number of draws."""

    def finish(keys: pa.Array, results: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = [[np.sort(x) for x in r] for r in results]
        values = [pa.array([float(f(*r)) for r in rows], pa.float64()) for f in columns.values()]
        return pa.record_batch([keys, *values, pa.array([len(r[0]) for r in rows], pa.int64())], names=[key, *columns, "draws"])

    return finish, ", ".join([*(f"{c} double" for c in columns), "draws long"])


def _quantile(ordered: np.ndarray, share: float) -> float:
    """Linear quantile, as percentile has it."""
    place = share * (len(ordered) - 1)
    low, high = math.floor(place), math.ceil(place)
    return ordered[low] if low == high else (high - place) * ordered[low] + (place - low) * ordered[high]


def _profile_columns(low: float, limit: float) -> dict[str, Callable[..., float]]:
    return {
        "g_low": lambda g, mdd: _quantile(g, low), "g_median": lambda g, mdd: _quantile(g, 0.5), "p_loss": lambda g, mdd: (g <= 0).mean(), "p_deep": lambda g, mdd: (mdd < limit).mean(),
        "mdd_median": lambda g, mdd: _quantile(mdd, 0.5),
    }


def _bootstrap(horizon: int, block: int) -> Callable[..., list[np.ndarray]]:
    """Annual growth and deepest drawdown of paths.

    A path is its blocks one after another, so the shapes of a stream's blocks are taken once a chunk and a draw only puts horizon / block of
    them together.
    """
    blocks = math.ceil(horizon / block)
    last = horizon - (blocks - 1) * block

    def outcomes(starts: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        whole, tail = _block_shapes(x, block), _block_shapes(x, last)
        level, peak, fall = (np.zeros(len(starts)) for _ in range(3))
        for k in range(blocks):
            total, high, low, inner = (c[starts[:, k]] for c in (tail if k == blocks - 1 else whole))
            fall = np.minimum(fall, np.minimum(level + low - peak, inner))
            peak, level = np.maximum(peak, level + high), level + total
        return [level / horizon * 252, np.expm1(fall)]

    return outcomes


def bootstrap_outcomes(streams: DataFrame, key: str, draws: int, horizon: int, block: int, seed: int, chunk: int = 4000) -> DataFrame:
    """(key, draw, g, mdd): annual growth and deepest drawdown of the paths of bootstrap_starts, without their rows. Positions count from 0 without gaps."""
    hashes = _hashes(streams.sparkSession, draws, math.ceil(horizon / block), seed)
    return _by_stream(_streams(streams, key, ["log_return"], block), key, hashes, block, chunk, _bootstrap(horizon, block), *_draw_rows(key, ["g", "mdd"]))


def bootstrap_profile(streams: DataFrame, key: str, draws: int, horizon: int, block: int, seed: int, low: float, limit: float, chunk: int = 4000) -> DataFrame:
    """outcome_profile of bootstrap_outcomes, made where the draws are: one row a stream leaves a task."""
    hashes = _hashes(streams.sparkSession, draws, math.ceil(horizon / block), seed)
    return _by_stream(_streams(streams, key, ["log_return"], block), key, hashes, block, chunk, _bootstrap(horizon, block), *_profile_rows(key, _profile_columns(low, limit)))


def _paired(horizon: int, block: int, span: int, share: float) -> Callable[..., list[np.ndarray]]:
    """Annual growth of a less b, and the mean of the worst share of sums over span positions of a less that of b.

    Sums are put together of pieces that divide both block and span.
    """
    blocks, piece, sums = math.ceil(horizon / block), math.gcd(block, span), horizon // span
    last, worst = horizon - (blocks - 1) * block, max(1, round(share * sums))

    def one(starts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, tail, small = (np.lib.stride_tricks.sliding_window_view(x, n).sum(axis=1) for n in (block, last, piece))
        growth = (whole.take(starts[:, :-1]).sum(axis=1) + tail.take(starts[:, -1])) / horizon * 252
        # The pieces of the block that begins at each position, so that a draw takes whole rows.
        pieces = np.stack([small[j : len(x) - block + 1 + j] for j in range(0, block, piece)], axis=1)
        s = pieces.take(starts, axis=0).reshape(len(starts), -1)[:, : sums * span // piece]
        if span > piece:
            s = s.reshape(len(starts), sums, span // piece).sum(axis=2)
        return growth, np.sort(s, axis=1)[:, :worst].mean(axis=1)

    def outcomes(starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        (ga, ta), (gb, tb) = one(starts, x), one(starts, y)
        return [ga - gb, ta - tb]

    return outcomes


def paired_outcomes(pairs: DataFrame, key: str, a: str, b: str, draws: int, horizon: int, block: int, seed: int, span: int, share: float, chunk: int = 4000) -> DataFrame:
    """(key, draw, growth, tail): of paths of both streams with the same starts, annual growth of a less b, and the mean of
    the worst share of sums over span positions of a less that of b.

    pairs (key, pos, a, b) are the sessions that both have, counted from 0.
    """
    hashes = _hashes(pairs.sparkSession, draws, math.ceil(horizon / block), seed)
    return _by_stream(_streams(pairs, key, [a, b], block), key, hashes, block, chunk, _paired(horizon, block, span, share), *_draw_rows(key, ["growth", "tail"]))


def paired_profile(pairs: DataFrame, key: str, a: str, b: str, draws: int, horizon: int, block: int, seed: int, span: int, share: float, alpha: float, chunk: int = 4000) -> DataFrame:
    """paired_delta of paired_outcomes, made where the draws are: one row a stream leaves a task."""
    columns = {}
    for at, c in enumerate(("growth", "tail")):
        columns |= {
            f"{c}_mean": lambda *x, at=at: x[at].mean(), f"{c}_lower": lambda *x, at=at: _quantile(x[at], alpha), f"{c}_upper": lambda *x, at=at: _quantile(x[at], 1 - alpha),
            f"{c}_p_positive": lambda *x, at=at: (x[at] > 0).mean(),
        }
    hashes = _hashes(pairs.sparkSession, draws, math.ceil(horizon / block), seed)
    return _by_stream(_streams(pairs, key, [a, b], block), key, hashes, block, chunk, _paired(horizon, block, span, share), *_profile_rows(key, columns))


def paired_lists(pairs: DataFrame, key: str, a: str, b: str, draws: int, horizon: int, block: int, seed: int, span: int, share: float, chunk: int = 4000) -> DataFrame:
    """(key, g, t, growth_mean, tail_mean): the draws of paired_outcomes as two ordered arrays a stream."""

    def finish(keys: pa.Array, results: list[list[np.ndarray]]) -> pa.RecordBatch:
        lists = [pa.array([np.sort(r[c]) for r in results], pa.list_(pa.float64())) for c in (0, 1)]
        means = [pa.array([float(r[c].mean()) for r in results]) for c in (0, 1)]
        return pa.record_batch([keys, *lists, *means], names=[key, "g", "t", "growth_mean", "tail_mean"])

    hashes = _hashes(pairs.sparkSession, draws, math.ceil(horizon / block), seed)
    kinds = "g array<double>, t array<double>, growth_mean double, tail_mean double"
    return _by_stream(_streams(pairs, key, [a, b], block), key, hashes, block, chunk, _paired(horizon, block, span, share), finish, kinds)


def paired_delta(outcomes: DataFrame, key: str, alpha: float) -> DataFrame:
    """Mean, alpha and 1 - alpha quantile and share above 0, over draws, of both differences of paired_outcomes."""
    aggs = [
        x
        for c in ("growth", "tail")
        for x in (
            F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile({c}, {alpha})").alias(f"{c}_lower"), F.expr(f"percentile({c}, {1 - alpha})").alias(f"{c}_upper"),
            F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_p_positive"),
        )
    ]
    return outcomes.groupBy(key).agg(*aggs, F.count("*").alias("draws"))


def tail_mean(streams: DataFrame, key: str, span: int, share: float) -> DataFrame:
    """Mean of the worst share of non-overlapping sums over span positions, at least one; the number is rounded half to even."""
    sums = streams.groupBy(key, F.floor(F.col("i") / span).alias("b")).agg(F.sum("log_return").alias("s"), F.count("*").alias("c")).where(F.col("c") == span)
    own = Window.partitionBy(key)
    ranked = sums.withColumn("r", F.row_number().over(own.orderBy("s", "b"))).withColumn("k", F.greatest(F.lit(1), F.bround(F.count("*").over(own) * share)))
    return ranked.where("r <= k").groupBy(key).agg(F.avg("s").alias("cvar"), F.count("*").alias("k"))


def ols_beta(pairs: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """Slope over pairs with both known; 0 without variance."""
    return pairs.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(key).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("beta"), F.count("*").alias("n"))


def rolling_beta(pairs: DataFrame, key: str, y: str, x: str, window: int, least: int, cap: float) -> DataFrame:
    """Slope over the window strictly before each position, clipped to [0, cap]; 0 with too few pairs."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-window, -1)
    known = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(known, F.col(y)), F.when(known, F.col(x))
    # One count for all means: a mean of its own would count the frame again for each.
    n = F.count(a).over(w)
    ab, ma, mb, bb = (F.try_divide(F.sum(x).over(w), n) for x in (a * b, a, b, b * b))
    cov, var = ab - ma * mb, bb - mb * mb
    beta = F.when((n >= least) & (var > 1e-18), F.greatest(F.lit(0.0), F.least(F.lit(cap), cov / var))).otherwise(0.0)
    return pairs.withColumn("beta", beta)


def hash_chain(rows: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """rows with own_hash, and prev_hash, the hash of the row before."""
    own = rows.withColumn("own_hash", F.sha2(payload, 256))
    return own.withColumn("prev_hash", F.lag("own_hash").over(Window.partitionBy(key).orderBy(order)))


def chain_breaks(chain: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Rows whose hash is not that of their payload, or whose prev_hash is not the hash before."""
    before = F.lag("own_hash").over(Window.partitionBy(key).orderBy(order))
    return chain.withColumn("before", before).where((F.col("own_hash") != F.sha2(payload, 256)) | ~F.col("prev_hash").eqNullSafe(F.col("before"))).drop("before")


def journal_reconcile(journal: DataFrame, account: str, order: str, delta: str) -> DataFrame:
    """Per account: the sum of its deltas, the lowest running balance, and whether it ever was negative."""
    w = Window.partitionBy(account).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    j = journal.withColumn("balance", F.sum(delta).over(w))
    return j.groupBy(account).agg(F.sum(delta).alias("final"), F.min("balance").alias("lowest"), (F.min("balance") < 0).alias("overdrawn"))


def stream_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows on which two recordings of a stream differ, or that one of them lacks."""
    x, y = a.select(*keys, F.col(value).alias("left")), b.select(*keys, F.col(value).alias("right"))
    return x.join(y, keys, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def asof_targets(decisions: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """At each position, the last decision at or before it: decisions become spans, so no row is compared with all others."""
    upto = F.lead("pos").over(Window.partitionBy(key).orderBy("pos"))
    end = positions.agg(F.max("pos").alias("end"))
    ends = decisions.withColumn("upto", upto).join(F.broadcast(end)).where("pos <= end")
    spans = ends.select(key, "target", F.col("pos").alias("decided"), F.explode(F.sequence("pos", F.coalesce(F.col("upto") - 1, "end"))).alias("pos"))
    return spans.join(positions, "pos")


def select_top(scores: DataFrame, n: int) -> DataFrame:
    """The n best of each position, ties by instrument; none where there are fewer than n."""
    w = Window.partitionBy("pos")
    r = F.row_number().over(w.orderBy(F.desc("score"), "instrument_id"))
    return scores.where("score is not null").withColumn("rank", r).withColumn("candidates", F.count("*").over(w)).where((F.col("rank") <= n) & (F.col("candidates") >= n)).drop("candidates")


def select_held(scores: DataFrame, n: int, keep_multiple: float, key: str = "sleeve") -> DataFrame:
    """(key, pos, rank, instrument_id): the n names of each decision; what is held and still ranks among the first floor(n * keep_multiple) goes first.

    Scores rank from the highest, ties by instrument. With fewer than n candidates nothing is held, and nothing is left to keep. Only
    the first max(n, floor(n * keep_multiple)) of a decision matter, so a fold over a key's decisions holds short lists.
    """
    keep = int(n * keep_multiple)
    w = Window.partitionBy(key, "pos")
    ranked = scores.where("score is not null").withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "instrument_id"))).withColumn("n", F.count("*").over(w))
    first = ranked.where(F.col("rank") <= max(n, keep)).groupBy(key, "pos").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "instrument_id"))).alias("r"))
    every = scores.select(key, "pos").distinct().join(first, [key, "pos"], "left")
    day = F.struct("pos", (F.coalesce("n", F.lit(0)) >= n).alias("enough"), F.coalesce(F.col("r.instrument_id"), F.array().cast(f"array<{dict(scores.dtypes)['instrument_id']}>")).alias("ids"))
    own = every.select(key, day.alias("day")).groupBy(key).agg(F.array_sort(F.collect_list("day")).alias("days"))

    def onward(made: Column, d: Column) -> Column:
        held = F.coalesce(F.get(made, F.size(made) - 1)["held"], F.slice(d["ids"], 1, 0))
        kept = F.filter(F.slice(d["ids"], 1, keep), lambda i: F.array_contains(held, i))
        chosen = F.slice(F.concat(kept, F.array_except(d["ids"], kept)), 1, n)
        return F.concat(made, F.array(F.struct(d["pos"].alias("pos"), F.when(d["enough"], chosen).otherwise(F.slice(d["ids"], 1, 0)).alias("held"))))

    kinds = dict(scores.dtypes)
    start = F.array().cast(f"array<struct<pos:{kinds['pos']},held:array<{kinds['instrument_id']}>>>")
    out = own.select(key, F.explode(F.aggregate("days", start, onward)).alias("x")).select(key, "x.pos", F.posexplode("x.held").alias("rank", "instrument_id"))
    return out.withColumn("rank", F.col("rank") + 1)


def trend_signals(levels: DataFrame, key: str, horizons: list[int], window: int) -> DataFrame:
    """Mean sign of change over horizons, and +1 or -1 against the mean of a full window; NULL where a part is unknown."""
    w = Window.partitionBy(key).orderBy("pos")
    signs = [F.signum(F.col("level") - F.lag("level", h).over(w)) for h in horizons]
    total = signs[0]
    for s in signs[1:]:
        total = total + s
    r = w.rowsBetween(-(window - 1), 0)
    full = F.count("level").over(r) == window
    return levels.withColumn("tsmom", total / len(horizons)).withColumn("ma_signal", F.when(full, F.when(F.col("level") > F.avg("level").over(r), 1).otherwise(-1)))


def realised_vol(levels: DataFrame, key: str, window: int) -> DataFrame:
    """Annual population deviation of the last `window` log returns; NULL unless all are known."""
    w = Window.partitionBy(key).orderBy("pos")
    r = levels.withColumn("lr", F.log(F.col("level") / F.lag("level").over(w)))
    own = w.rowsBetween(-(window - 1), 0)
    return r.withColumn("vol", F.when(F.count("lr").over(own) == window, F.stddev_pop("lr").over(own) * math.sqrt(252))).drop("lr")


def log_returns(levels: DataFrame, key: str) -> DataFrame:
    """Log and simple returns of consecutive calendar positions; NULL where the position before is absent."""
    w = Window.partitionBy(key).orderBy("pos")
    prev, ppos = F.lag("level").over(w), F.lag("pos").over(w)
    near = ppos == F.col("pos") - 1
    return levels.withColumn("log_return", F.when(near, F.log(F.col("level") / prev))).withColumn("simple_return", F.when(near, F.col("level") / prev - 1))


def mean_sleeve_returns(streams: DataFrame) -> DataFrame:
    """Mean over sleeves of the simple returns of a position."""
    return streams.groupBy("pos").agg(F.avg(F.expm1("log_return")).alias("ret"), F.count("*").alias("sleeves"))


def revision_check(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """new rows as unchanged, revised (an error) or appended, against what was recorded before."""
    was = old.select(*keys, F.col(value).alias("was"), F.lit(True).alias("seen"))
    state = F.when(F.col("seen").isNull(), "appended").when(F.col("was").eqNullSafe(F.col(value)), "unchanged").otherwise("revised")
    return new.join(was, keys, "left").select(*keys, state.alias("state"))


def effective_position(decisions: DataFrame, calendar: DataFrame, open_hour: int) -> DataFrame:
    """decisions (pos, sealed_at) with the first later position whose open follows the seal, and whether that is late."""
    opens = calendar.select(F.col("pos").alias("effective"), (F.col("session").cast("timestamp") + F.make_interval(hours=F.lit(open_hour))).alias("open_at"))
    # Seals before the first open count as of its day: there is no earlier one that they could meet.
    starts = opens.withColumn("since", F.lag("open_at").over(Window.orderBy("effective")))
    days = starts.withColumn("day", F.explode(F.sequence(F.to_date(F.coalesce("since", "open_at")), F.to_date("open_at"))))
    first = opens.agg(F.to_date(F.min("open_at")).alias("first_day"))
    d = decisions.join(first).withColumn("day", F.greatest(F.to_date("sealed_at"), "first_day")).where("sealed_at is not null")
    hit = d.join(days, "day").where((F.col("sealed_at") < F.col("open_at")) & (F.col("since").isNull() | (F.col("sealed_at") >= F.col("since"))))
    late = hit.withColumn("effective", F.greatest("effective", F.col("pos") + 1))
    return late.select(*[c for c in decisions.columns], "effective", (F.col("effective") > F.col("pos") + 1).alias("is_late"))
