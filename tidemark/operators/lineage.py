"""Lineage by frontiers, and which registered datasets are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of all that roots (id) reach over edges (child, parent), by the fewest steps; roots have 0.

    A round takes the last frontier one step further and leaves what was seen, so cycles end. A frontier is a written table, so
    a plan is never deeper than a round; there are as many rounds as the longest shortest path.
    """
    steps = written(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "edges")
    frontier = written(roots.select("id", F.lit(0).alias("depth")).where("id is not null").distinct(), "frontier")
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        onward = frontier.join(steps, F.col("id") == F.col("child")).select(F.col("parent").alias("id")).distinct()
        frontier = written(onward.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def same_identity(a: str, b: str, ignored: tuple[str, ...] = ("decision_time",)) -> Column:
    """Whether two identities (layer, policy, inputs map, params map) agree; ignored params never count."""

    def plain(c: str) -> Column:
        params = F.map_filter(F.coalesce(F.col(f"{c}.params"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*ignored))
        entries = [F.array_sort(F.map_entries(m)) for m in (F.coalesce(F.col(f"{c}.inputs"), F.create_map().cast("map<string,string>")), params)]
        return F.struct(F.col(f"{c}.layer"), F.col(f"{c}.policy"), *entries)

    return plain(a).eqNullSafe(plain(b))


def stale_datasets(expected: DataFrame, registry: DataFrame, upstream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, reason, depth) of what must be built again, registered kinds that nothing expects, which is an error).

    expected and registry: (kind, identity), of struct (layer, policy, inputs, params); an identity that cannot be read is
    NULL. upstream: (kind, input). Stale by itself is what is unregistered or of another identity, at depth 0; all that stands on
    it, by however many steps, is stale as well.
    """
    j = expected.select("kind", F.col("identity").alias("want")).join(registry.select("kind", F.col("identity").alias("have"), F.lit(True).alias("there")), "kind", "left")
    differs = F.col("want").isNull() | F.col("have").isNull() | ~same_identity("want", "have")
    own = j.select("kind", F.when(F.col("there").isNull(), "unregistered").when(differs, "identity_differs").alias("own"))
    roots = written(own.where("own is not null"), "stale")
    edges = upstream.select(F.col("input").alias("child"), F.col("kind").alias("parent"))
    reached = reachable(edges, roots.select(F.col("kind").alias("id"))).withColumnRenamed("id", "kind")
    stale = reached.join(roots, "kind", "left").join(expected.select("kind"), "kind", "left_semi")
    return stale.select("kind", F.coalesce("own", F.lit("upstream_stale")).alias("reason"), "depth"), registry.select("kind").join(expected, "kind", "left_anti")
