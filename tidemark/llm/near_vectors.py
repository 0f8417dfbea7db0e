"""Near-duplicate vectors by NN-descent (Dong, Charikar and Li, 2011) over class representatives.

Equal vectors are one node. Dense surroundings are then folded: nodes that lie within half the threshold's angle of a common
centre link with each other by the triangle inequality of angles, so such a ball is one item, and its pairs are counted, never
written out. Item lists start from blocks of sorted random-hyperplane signatures and are refined by joining
neighbours of neighbours; a list full of near items is enlarged until it isn't. Items are compared by the gap between their
balls; what a gap leaves open is decided member by member. A brute-force audit of sampled nodes measures recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import write_table
from tidemark.llm.components import components

#: Items compared at once, random-hyperplane tables of the first lists, and bits of a signature.
BLOCK, TABLES, BITS = 256, 8, 60
#: First length of a list, reverse neighbours that join at a node, and members of the least ball.
K, REVERSE, LEAST = 10, 10, 4
#: Folding passes, rounds of refinement, nodes of the audit, recall at which no more tables are added, and recall below which the answer is refused.
PASSES, ROUNDS, AUDITED, ENOUGH, REFUSED = 8, 12, 512, 0.98, 0.9
#: Angle by which coded vectors may be off, by which a decision by the triangle inequality must be clear, and by which a ball may stick out of one
#: that it is proposed for (its members are then measured one by one).
CODED, CLEAR, SLACK = 0.05, 1e-6, 0.06
#: More than the rounding of an angle next to zero.
ROUNDING = 1e-7
#: Members of one side that meet in a task.
CHUNK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square leaves the range of doubles."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(s: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(s, -1.0, 1.0))


def signatures(c: np.ndarray, seed: int) -> np.ndarray:
    """One bit for the side of each of BITS random hyperplanes."""
    planes = np.random.default_rng(seed).normal(size=(c.shape[1], BITS))
    return ((c @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64))


def _blocks(batches: Iterator[pd.DataFrame], within: str | None = None) -> Iterator[pd.DataFrame]:
    """Runs of at most BLOCK consecutive rows, each with one value of `within`."""
    for pdf in batches:
        parts = [pdf] if within is None else [p for _, p in pdf.groupby(within, sort=False)]
        for p in parts:
            for i in range(0, len(p), BLOCK):
                yield p.iloc[i : i + BLOCK]


def _vectors(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy())


def nodes(rows: DataFrame) -> DataFrame:
    """(node, x, m, least, ball, off): distinct vectors of rows (vec_id, node, x), how many share one and their smallest id; ball 0 is none."""
    found = rows.groupBy("x").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    return found.select(F.xxhash64("x").alias("node"), "x", "m", "least", F.lit(0).cast("long").alias("ball"), F.lit(0.0).alias("off"))


def items_of(members: DataFrame, centres: DataFrame | None) -> DataFrame:
    """(item, c, r, m, least): nodes without a ball, and balls with the largest angle between centre and member."""
    alone = members.where("ball = 0").select(F.col("node").alias("item"), F.col("x").alias("c"), F.lit(0.0).alias("r"), "m", "least")
    if centres is None:
        return alone
    balls = members.where("ball <> 0").groupBy(F.col("ball").alias("item")).agg(F.max("off").alias("r"), F.sum("m").alias("m"), F.min("least").alias("least"))
    return alone.unionByName(balls.join(centres.select(F.col("ball").alias("item"), "c"), "item").select("item", "c", "r", "m", "least"))


def _signed(items: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(sig=signatures(unit(_vectors(pdf["c"])), seed))

    signed = items.select("item", "c", "r", "m").mapInPandas(run, "item long, c array<float>, r double, m long, sig long")
    return signed.repartitionByRange("sig", "item").sortWithinPartitions("sig", "item")


def proposed_balls(items: DataFrame, seed: int, radius: float) -> DataFrame:
    """(item, ball, c): items of a block that may share a ball, greedily from the fullest surroundings, with its centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            c, r, m, ids = unit(_vectors(pdf["c"])), pdf["r"].to_numpy(), pdf["m"].to_numpy(), pdf["item"].to_numpy()
            near = _angles(c @ c.T) <= 2 * radius
            free = np.ones(len(ids), bool)
            while free.any():
                fullest = int(np.argmax((near & free).sum(axis=1) * free))
                around = near[fullest] & free
                if around.sum() < (LEAST if (r[around] == 0).all() else 2):
                    break
                centre = unit(m[around] @ c[around][None, :, :])[0].astype(np.float32)
                own = around & (_angles(c @ unit(centre[None, :])[0]) + r <= radius + SLACK * (r > 0))
                free &= ~around
                if own.sum() >= 2:
                    ball = np.int64(hash((int(ids[own].min()), seed)) & 0x7FFFFFFFFFFFFFFF)
                    yield pd.DataFrame({"item": ids[own], "ball": ball, "c": [centre] * int(own.sum())})

    return _signed(items, seed).mapInPandas(run, "item long, ball long, c array<float>")


def folded(members: DataFrame, radius: float) -> tuple[DataFrame, DataFrame | None]:
    """Members with their balls, and the balls' centres. A member further than the radius from a new centre stands alone again."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                moved = (pdf["to"] != 0).to_numpy()
                ball, off = pdf["ball"].to_numpy(copy=True), pdf["off"].to_numpy(copy=True)
                if moved.any():
                    angle = _angles((unit(_vectors(pdf["x"][moved])) * unit(_vectors(pdf["c"][moved]))).sum(axis=1)) + ROUNDING
                    ball[moved] = np.where(angle <= radius, pdf["to"].to_numpy()[moved], 0)
                    off[moved] = np.where(angle <= radius, angle, 0.0)
                yield pdf[["node", "x", "m", "least"]].assign(ball=ball, off=off)

    centres: DataFrame | None = None
    before = members.count()
    for step in range(PASSES):
        found = write_table(proposed_balls(items_of(members, centres), 100 + step, radius), "ball-proposals")
        if found.isEmpty():
            break
        to = found.select(F.col("item"), F.col("ball").alias("to"), "c")
        joined = members.withColumn("item", F.coalesce(F.nullif("ball", F.lit(0)), "node")).join(to, "item", "left").withColumn("to", F.coalesce("to", F.lit(0)))
        members = write_table(joined.select("node", "x", "m", "least", "ball", "off", "to", "c").mapInPandas(measured, members.schema), "ball-members")
        new = found.select("ball", "c").dropDuplicates(["ball"])
        every = new if centres is None else centres.unionByName(new)
        centres = write_table(every.join(members.select("ball").where("ball <> 0").distinct(), "ball", "left_semi"), "ball-centres")
        now = items_of(members, centres).count()
        if now > 0.98 * before:
            break
        before = now
    return members, centres


def _coded(items: DataFrame, tables: range) -> DataFrame:
    """(t, sig, item, q, r): one row a table, with the centre coded in a byte for each component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                c = unit(_vectors(pdf["c"]))
                q = [b.tobytes() for b in _codes(c)]
                for t in tables:
                    yield pd.DataFrame({"t": t, "sig": signatures(c, 1000 + t), "item": pdf["item"], "q": q, "r": pdf["r"]})

    return items.select("item", "c", "r").mapInPandas(run, "t int, sig long, item long, q binary, r double")


def _codes(c: np.ndarray) -> np.ndarray:
    return np.rint(127 * c / np.abs(c).max(axis=1, keepdims=True)).astype(np.int8)


def _decoded(q: pd.Series) -> np.ndarray:
    n = len(q)
    x = np.frombuffer(b"".join(q), np.int8).reshape(n, -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _top(u: np.ndarray, v: np.ndarray, gap: np.ndarray, k: np.ndarray) -> pd.DataFrame:
    """The k nearest of each u, without repeats."""
    out = pd.DataFrame({"u": u, "v": v, "gap": gap, "k": k}).drop_duplicates(["u", "v"]).sort_values(["u", "gap", "v"])
    return out[out.groupby("u").cumcount() < out["k"]][["u", "v", "gap"]]


def first_lists(items: DataFrame, tables: range) -> DataFrame:
    """(u, v, gap): the nearest items within blocks of each table's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches, "t"):
            if len(pdf) > 1:
                c, r, ids = _decoded(pdf["q"]), pdf["r"].to_numpy(), pdf["item"].to_numpy()
                gap = _angles(c @ c.T) - r[:, None] - r[None, :]
                np.fill_diagonal(gap, np.inf)
                take = np.argpartition(gap, min(K, len(ids) - 1) - 1, axis=1)[:, : min(K, len(ids) - 1)]
                yield pd.DataFrame({"u": np.repeat(ids, take.shape[1]), "v": ids[take].ravel(), "gap": np.take_along_axis(gap, take, 1).ravel()})

    dealt = _coded(items, tables).repartitionByRange("t", "sig", "item").sortWithinPartitions("t", "sig", "item")
    return dealt.mapInPandas(run, "u long, v long, gap double")


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs among the neighbours of each w, at least one of them new, that get into the list of either."""
    pdf = pdf.sort_values(["w", "a", "fresh"], ascending=[True, True, False]).drop_duplicates(["w", "a"])
    c, r, ids = _decoded(pdf["q"]), pdf["r"].to_numpy(), pdf["a"].to_numpy()
    fresh, worst, k = pdf["fresh"].to_numpy(), pdf["worst"].to_numpy(), pdf["k"].to_numpy()
    cut = np.flatnonzero(np.diff(pdf["w"].to_numpy())) + 1
    us, vs, gaps, ks = [], [], [], []
    for s, e in zip(np.r_[0, cut], np.r_[cut, len(pdf)], strict=True):
        for b in range(s, e, CHUNK):
            i = slice(b, min(b + CHUNK, e))
            gap = _angles(c[i] @ c[s:e].T) - r[i, None] - r[None, s:e]
            x, y = np.nonzero((gap < worst[i, None]) & (fresh[i, None] | fresh[None, s:e]))
            x, y, g = x + b, y + s, gap[x, y]
            other = x != y
            us.append(ids[x[other]])
            vs.append(ids[y[other]])
            gaps.append(g[other])
            ks.append(k[x[other]])
    return _top(*(np.concatenate(a) for a in (us, vs, gaps, ks)))


def _cut_lists(found: DataFrame, limits: DataFrame | None) -> DataFrame:
    """(u, v, gap, fresh, k): each u's nearest, as many as its limit says. `found` (u, v, gap, fresh) may name a pair twice."""
    one = found.repartition("u").groupBy("u", "v").agg(F.min("gap").alias("gap"), F.min("fresh").alias("fresh"))
    one = one.withColumn("k", F.lit(K)) if limits is None else one.join(limits, "u", "left").withColumn("k", F.coalesce("k", F.lit(K)))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("gap", "v")))
    return ranked.where(F.col("rank") <= F.col("k")).select("u", "v", "gap", "fresh", "k")


def refined(lists: DataFrame, codes: DataFrame, limits: DataFrame | None, n: int) -> DataFrame:
    """One round: neighbours of neighbours, both ways, join at the node between them."""
    back = lists.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v")))).where(F.col("rank") <= REVERSE)
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("a"), "fresh").unionByName(back.select(F.col("v").alias("w"), F.col("u").alias("a"), "fresh"))
    state = lists.groupBy(F.col("u").alias("a")).agg(F.max("k").alias("k"), F.max("gap").alias("worst"), F.count("*").alias("n"))
    known = codes.join(state, "a", "left").select("a", "q", "r", F.coalesce("k", F.lit(K)).alias("k"), F.when(F.col("n") >= F.col("k"), F.col("worst")).otherwise(F.lit(math.inf)).alias("worst"))
    blocks = max(1, -(-n // 2048))
    meeting = around.join(known, "a").withColumn("part", F.pmod(F.xxhash64("w"), F.lit(blocks)))
    found = meeting.groupBy("part").applyInPandas(_meet, "u long, v long, gap double")
    old = lists.select("u", "v", "gap", F.lit(False).alias("fresh"))
    return _cut_lists(old.unionByName(found.withColumn("fresh", F.lit(True))), limits)


def neighbour_lists(items: DataFrame, reach: float, tables: range, lists: DataFrame | None = None) -> DataFrame:
    """(u, v, gap, fresh, k) after as many rounds as find near items. A list whose every entry is near is doubled and joined again."""
    n = items.count()
    codes = write_table(_coded(items, range(1)).select(F.col("item").alias("a"), "q", "r"), "codes")
    found = first_lists(items, tables).withColumn("fresh", F.lit(True))
    if lists is not None:
        found = found.unionByName(lists.select("u", "v", "gap", F.lit(False).alias("fresh")))
    limits = None if lists is None else lists.select("u", "k").distinct()
    lists = write_table(_cut_lists(found, limits), "lists")
    near = F.col("gap") <= reach + CODED
    for _ in range(ROUNDS):
        state = lists.groupBy("u").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.count_if(near).alias("near"))
        grow = F.col("near") >= F.col("k")
        limits = write_table(state.where(grow | (F.col("k") > K)).select("u", F.when(grow, 2 * F.col("k")).otherwise(F.col("k")).alias("k"), grow.alias("grown")), "limits")
        grown = not limits.where("grown").isEmpty()
        if grown:
            again = F.col("fresh") | F.coalesce("grown", F.lit(False))
            lists = lists.drop("k").join(limits, "u", "left").select("u", "v", "gap", again.alias("fresh"), F.coalesce("k", F.lit(K)).alias("k"))
        lists = write_table(refined(lists, codes, limits.select("u", "k"), n), "lists")
        if not grown and lists.where(near & F.col("fresh")).count() <= 0.001 * lists.where(near).count():
            break
    return lists


def _judged(theta: float, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Item pairs: 1 when all their members link, 0 when open; others go. Two nodes are compared by their exact cosine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cos = (unit(_vectors(pdf["ca"])) * unit(_vectors(pdf["cb"]))).sum(axis=1)
                ang, r = _angles(cos), (pdf["ra"] + pdf["rb"]).to_numpy()
                every = np.where(r == 0, cos >= least, ang + r <= theta - CLEAR)
                some = np.where(r == 0, cos >= least, ang - r <= theta + CLEAR)
                yield pdf.assign(every=every.astype("int32"))[some][["a", "b", "every"]]

    return run


def _crossed(least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Members of two items, a chunk of each side: how many vectors of the other side each links with."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"item": [], "other": [], "node": [], "links": []}).astype("int64")
        hit = unit(_vectors(left["x"])) @ unit(_vectors(right["x"])).T >= least
        there = pd.DataFrame({"item": left["item"], "other": left["other"], "node": left["node"], "links": hit @ right["m"].to_numpy()})
        back = pd.DataFrame({"item": right["item"], "other": right["other"], "node": right["node"], "links": left["m"].to_numpy() @ hit})
        out = pd.concat([there, back])
        return out[out["links"] > 0].astype("int64")

    return run


def linked(members: DataFrame, items: DataFrame, lists: DataFrame, theta: float, least: float) -> DataFrame:
    """(node, n_links, component): links of each node by the item pairs found, and its smallest reachable id."""
    pairs = lists.where(F.col("gap") <= theta + CODED).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    side = items.select("item", "c", "r")
    named = pairs.join(side.select(F.col("item").alias("a"), F.col("c").alias("ca"), F.col("r").alias("ra")), "a")
    named = named.join(side.select(F.col("item").alias("b"), F.col("c").alias("cb"), F.col("r").alias("rb")), "b")
    judged = write_table(named.select("a", "b", "ca", "cb", "ra", "rb").mapInPandas(_judged(theta, least), "a long, b long, every int"), "item-pairs")
    of = members.select("node", "x", "m", F.coalesce(F.nullif("ball", F.lit(0)), "node").alias("item"))

    parts = items.select("item", F.ceil(F.col("m") / CHUNK).cast("long").alias("parts"))
    still = judged.where("every = 0").join(parts.select(F.col("item").alias("a"), F.col("parts").alias("na")), "a").join(parts.select(F.col("item").alias("b"), F.col("parts").alias("nb")), "b")

    def side_of(own: str, other: str, mine: str, theirs: str) -> DataFrame:
        dealt = still.select(F.col(own).alias("item"), F.col(other).alias("other"), "a", "b", "na", "nb").join(of, "item")
        place = F.pmod(F.xxhash64("node", F.lit(5)), F.col(f"n{own}")).alias(mine)
        named = [F.col(c).alias(c) for c in ("a", "b", "item", "other", "node", "x", "m")]
        return dealt.select(*named, place, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1)).alias(theirs))

    keys = ["a", "b", "pa", "pb"]
    crossed = side_of("a", "b", "pa", "pb").groupBy(*keys).cogroup(side_of("b", "a", "pb", "pa").groupBy(*keys)).applyInPandas(_crossed(least), "item long, other long, node long, links long")
    crossed = write_table(crossed.groupBy("item", "other", "node").agg(F.sum("links").alias("links")), "member-links")

    sure = judged.where("every = 1").select("a", "b")
    edges = sure.unionByName(crossed.select(F.col("item").alias("a"), F.col("other").alias("b")).distinct())
    sizes = items.select("item", "m", "least")
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    full = both.join(sizes.select(F.col("item").alias("b"), "m"), "b").groupBy(F.col("a").alias("item")).agg(F.sum("m").alias("more"))
    reach = sizes.join(components(edges).withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    first = reach.groupBy("component").agg(F.min("least").alias("first"))
    per_item = reach.join(first, "component").join(full, "item", "left").select("item", (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("base"), "first")
    per_node = crossed.groupBy("node").agg(F.sum("links").alias("links"))
    out = of.select("node", "item").join(per_item, "item").join(per_node, "node", "left")
    return out.select("node", (F.col("base") + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("first").alias("component"))


def audited(members: DataFrame, found: DataFrame, least: float) -> float:
    """Mean share of its links that a sampled node was given, over those with any; sampled are the AUDITED smallest node hashes."""
    sample = members.select("node", "x").orderBy("node").limit(AUDITED).collect()
    asked, x = [r.node for r in sample], unit(np.array([r.x for r in sample]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(asked), np.int64)
        for pdf in batches:
            if len(pdf):
                total += ((x @ unit(_vectors(pdf["x"])).T) >= least) @ pdf["m"].to_numpy()
        yield pd.DataFrame({"node": asked, "links": total})

    truth = members.select("x", "m").mapInPandas(run, "node long, links long").groupBy("node").agg((F.sum("links") - 1).alias("links"))
    first = truth.where("links > 0").join(found.select("node", "n_links"), "node").agg(F.avg(F.col("n_links") / F.col("links"))).first()
    return 1.0 if first[0] is None else float(first[0])


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): each row's links of a cosine not below the threshold, and the smallest id it reaches.

    Null, empty and zero vectors and those with null or non-finite parts link with nothing, as do vectors of different
    length; a row without an id has no links and no component and is not kept. Equal rows link with each other, also where
    they share an id. An empty table gives an empty one. Raises where the audit finds too few of the links.
    """
    v = F.col(f"`{vec_col}`").cast("array<float>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = F.exists(v, lambda e: e != 0)
    x = F.when(v.isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~bad & some, F.transform(v, lambda e: e + F.lit(0.0).cast("float")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    theta = math.acos(cosine)
    good = rows.where("x is not null")
    per_node = None
    for (d,) in good.select(F.size("x")).distinct().collect():
        members, centres = folded(write_table(nodes(good.where(F.size("x") == d)), "vector-nodes"), theta / 2 - CLEAR)
        items = write_table(items_of(members, centres), "vector-items")
        lists, recall = None, 0.0
        for step in range(4):
            lists = neighbour_lists(items, theta, range(step * TABLES, (step + 1) * TABLES), lists)
            found = write_table(linked(members, items, lists, theta, cosine), "node-links")
            recall = audited(members, found, cosine)
            if recall >= ENOUGH:
                break
        if recall < REFUSED:
            raise RuntimeError(f"recall {recall:.3f} after all tables")
        per_node = found if per_node is None else per_node.unionByName(found)
    if per_node is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    out = rows.select("vec_id", F.when(F.col("x").isNotNull(), F.xxhash64("x")).alias("node")).join(per_node, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
