"""Walk-forward scores: named feature sets, sealed rows, ranked designs, purged folds and gradient-boosted trees.

Trees are fitted by Spark's own library on the rows of a fold, so neither rows nor features pass through the driver; what it
holds is a model of bounded depth and number of trees for each year, horizon and seed.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import weekly_positions, winsor_z
from tidemark.operators.sleeves import ensemble_average
from tidemark.sources.scratch import written

#: Rank of a feature that is unknown: below all ranks, so that a tree can tell it from any.
UNKNOWN = -1.0


def feature_set(names: Iterable[str], known: Iterable[str]) -> list[str]:
    """The names in their order; a repeated or unknown one is an error, since an order is part of a model's identity."""
    out, allowed = list(names), set(known)
    if len(set(out)) != len(out):
        raise ValueError(f"repeated features: {sorted({n for n in out if out.count(n) > 1})}")
    if unknown := [n for n in out if n not in allowed]:
        raise ValueError(f"unknown features: {unknown}")
    return out


def sealed(rows: DataFrame, last: int) -> DataFrame:
    """Rows up to a position. Cut before anything is computed, so no later row can reach a feature or a label."""
    return rows.where(F.col("pos") <= last)


def ranked_design(rows: DataFrame, features: list[str], least: int) -> DataFrame:
    """rows (instrument_id, pos, ...) with each feature as its rank of (0, 1) at the position, ties by instrument; UNKNOWN where it is NULL or
    fewer than `least` are known. The windows of all features share the rows of a position: one shuffle, and neither copies nor a join."""
    day, value = Window.partitionBy("pos"), {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    rank = {f: (F.row_number().over(day.orderBy(v.asc_nulls_last(), "instrument_id")) - 0.5) / F.count(v).over(day) for f, v in value.items()}
    return rows.withColumns({f: F.when(v.isNotNull() & (F.count(v).over(day) >= least), rank[f]).otherwise(UNKNOWN) for f, v in value.items()})


def purged_fold(rows: DataFrame, target: str, horizon: int, purge: int, first: int, least: int) -> DataFrame:
    """Rows whose label is known and ends, with a purge, before position `first`; fewer than `least` are an error."""
    fold = rows.where((F.col("pos") + horizon + purge < first) & F.col(target).isNotNull())
    n = fold.count()
    if n < least:
        raise ValueError(f"{n} training rows before {first} for a horizon of {horizon}, {least} are needed")
    return fold


def authorized(sessions: DataFrame, start: date, end: date, last_certified: date) -> DataFrame:
    """Sessions of a run's window; a window that leaves [first session, last certified session] is an error."""
    first = sessions.agg(F.min("session")).first()[0]
    if first is None or start < first or end > last_certified or start > end:
        raise ValueError(f"window {start} to {end} is outside {first} to {last_certified}")
    return sessions.where(F.col("session").between(F.lit(start), F.lit(end)))


def walk_forward_scores(
    rows: DataFrame, calendar: DataFrame, features: list[str], labels: dict[int, str], years: list[int], last: int, purge: int = 5, least_rows: int = 1000, least_known: int = 5,
    seeds: tuple[int, ...] = (7,), trees: int = 20, depth: int = 4, winsor: tuple[float, float] = (0.01, 0.99),
) -> DataFrame:
    """(pos, instrument_id, score) for every universe row of the test years, from models of strictly earlier rows.

    rows: the universe's (instrument_id, pos, features, labels by horizon); nothing after position `last` is read, and a year
    that ends after it is an error. A fold's training rows are the week's last sessions whose label ends, with the purge,
    before the year's first position; its target is the label's winsorized z-score at the position. Scores of each horizon
    and seed are z-scored at a position and averaged over horizons, then seeds.
    """
    features = feature_set(features, rows.columns)
    days = sealed(calendar, last)
    spans = {r.y: (r.first, r.end) for r in calendar.groupBy(F.year("session").alias("y")).agg(F.min("pos").alias("first"), F.max("pos").alias("end")).collect()}
    for year in years:
        if year not in spans or spans[year][1] > last:
            raise ValueError(f"year {year} is not wholly within the sealed rows")
    own = sealed(rows, last)
    named = list(dict.fromkeys(labels.values()))
    design = written(VectorAssembler(inputCols=features, outputCol="x").transform(ranked_design(own.select("instrument_id", "pos", *features, *named), features, least_known)).select("instrument_id", "pos", "x", *named), "design")
    weekly = weekly_positions(days).select("pos")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scores = []
    for horizon, label in labels.items():
        z = winsor_z(design.select("instrument_id", "pos", "x", F.col(label).alias("label")).join(F.broadcast(weekly), "pos"), "label", *winsor, least_known)
        labelled = written(z.select("instrument_id", "pos", "x", F.col("z").alias("target")).where("target is not null"), "labelled")
        for year in years:
            first, end = spans[year]
            # Rows in a fixed order: sums of the trees' statistics do not depend on the sizes of files.
            fold = purged_fold(labelled, "target", horizon, purge, first, least_rows).repartition(parts, "pos").sortWithinPartitions("pos", "instrument_id")
            asked = design.where(F.col("pos").between(first, end))
            for seed in seeds:
                model = GBTRegressor(featuresCol="x", labelCol="target", predictionCol="score", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed * 1_000_003 + horizon * 10_007 + year).fit(fold)
                scores.append(model.transform(asked).select("pos", "instrument_id", F.lit(horizon).alias("horizon"), F.lit(seed).alias("seed"), "score"))
    return ensemble_average(reduce(DataFrame.unionByName, scores), least_known)
