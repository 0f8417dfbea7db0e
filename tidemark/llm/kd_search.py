"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt to shards; a shard's tree splits at the median of the widest dimension and keeps a tight bounding box
for each node. The largest inner product that a box can reach is the sum over dimensions of the larger product with its
two sides, so nodes are visited best bound first and a branch is cut when its bound is below the query's kth score. A
first round searches one shard per query; its kth score is passed on as the bound for all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import write_table

#: Vectors of a shard, of a leaf, and queries of a block. A shard's vectors are sent once for each block of queries, so that no
#: task holds more than a shard and a block.
SHARD_ROWS, LEAF, QUERY_BLOCK = 8192, 64, 16384


class Tree:
    """Median splits with tight boxes over integer vectors; ids ascend within a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.low, self.high, self.left, self.right, self.span = [], [], [], [], []
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        place = np.arange(len(ids))
        stack = [(0, len(ids), -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            own = self.vectors[place[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            node = len(self.low)
            self.low.append(lo)
            self.high.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((a, b))
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            d = int(np.argmax(hi - lo)) if len(lo) else 0
            if b - a > LEAF and len(lo) and hi[d] > lo[d]:
                m = (b - a) // 2
                place[a:b] = place[a:b][np.argpartition(own[:, d], m, kind="introselect")]
                stack += [(a + m, b, node, True), (a, a + m, node, False)]
        self.ids, self.vectors = self.ids[place], self.vectors[place]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def top(self, q: np.ndarray, k: int, own_id: int, bound: int | None) -> list[tuple[int, int]]:
        """[(score, id)] of the k best other vectors, ties to smaller ids; those below bound may be missing."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        reach = np.maximum(self.low * q, self.high * q).sum(axis=1)
        heap = [(-int(reach[0]), 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if (bound is not None and -most < bound) or (len(best) == k and -most < best[0][0]):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (-int(reach[child]), child))
                continue
            a, b = self.span[node]
            scores, ids = self.vectors[a:b] @ q, self.ids[a:b]
            least = best[0][0] if len(best) == k else (bound if bound is not None else None)
            at = np.flatnonzero(scores >= least) if least is not None else np.arange(b - a)
            for i in at.tolist():
                if ids[i] != own_id:
                    item = (int(scores[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 256.0) -> DataFrame:
    """(vec_id, x array<long>): floor(factor * component as double). Null vectors, those with null or non-finite parts, and those without an id go.

    Raises where an inner product of such vectors could leave 64 bits.
    """
    x = F.col(f"`{vec_col}`")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * factor))
    most = F.aggregate(x, F.lit(0.0), lambda acc, e: F.greatest(acc, F.abs(e.cast("double") * factor) + 1))
    fits = F.size(x) * most * most < float(1 << 62)
    return vectors.where(x.isNotNull() & ~bad & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large for 64-bit inner products")).cast("array<bigint>")).alias("x")
    )


def _packed(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(np.int64)


def _search(k: int):
    """One (shard, block of queries): all queries of the block against the shard's tree."""

    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(shard) and len(queries):
            tree = Tree(shard["vec_id"].to_numpy(), _packed(shard))
            qs = _packed(queries)
            bounds = queries["bound"].to_numpy()
            for i, own in enumerate(queries["query_id"].tolist()):
                b = None if pd.isna(bounds[i]) else int(bounds[i])
                rows += [(own, v, s) for s, v in tree.top(qs[i], k, own, b)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each row whose id is divisible by `every`.

    Ties go to the smaller id; a row is no answer to itself, also where its id is repeated. Of vectors that share a query's id the
    smallest asks; as candidates all take part. Vectors of another length than
    the query's take no part in its answer; empty vectors meet each other with a score of 0. A row without id takes no part.
    An empty table gives an empty one; with fewer candidates, all are returned.
    """
    rows = write_table(integer_vectors(vectors, id_col, vec_col).withColumn("dim", F.size("x")), "vectors")
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(shards)).cast("int")
    dealt = rows.withColumn("shard", shard)
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = write_table(asked.select(
        F.col("vec_id").alias("query_id"), "x", "dim", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)).cast("int").alias("block")
    ).groupBy("query_id", "block").agg(F.min(F.struct("x", "dim")).alias("q")).select("query_id", "q.x", "q.dim", "block"), "queries")
    search = _search(k)
    schema = "query_id long, vec_id long, score long"

    def over(shard_rows: DataFrame, query_rows: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "block"]
        return shard_rows.groupBy(*keys).cogroup(query_rows.groupBy(*keys)).applyInPandas(search, schema)

    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = dealt.withColumn("block", all_blocks)
    home = F.pmod(F.xxhash64("query_id", F.lit(8)), F.lit(shards)).cast("int")
    first = over(spread, queries.withColumn("shard", home).withColumn("bound", F.lit(None).cast("long")))
    first = write_table(_best(first, k).select("query_id", "vec_id", "score"), "first-shard")
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    others = queries.join(bounds, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    found = over(spread, others).unionByName(first)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
