"""N-gram Jaccard self-join by vertical partitioning (after FS-Join and partition-based set joins).

The global order of n-grams is the order of their 64-bit hashes. It is cut into m fragments per size class, and a text's
set falls into m parts. Two sets of one class with Jaccard >= t differ in at most d = (1-t)/(1+t) * 2 * hi elements (hi:
largest size of the class), so with m > d some parts must be equal. Equal parts are found by their keys, each part's
overlap is counted on its own, and the partial overlaps are summed per pair. A sum that reaches the bound proves the
link; of the others, pairs that coarse counts of the parts cannot exclude are counted over their whole sets. Classes overlap by a factor t, so no pair falls between two.

Groups of one key are not expanded into pairs: in each round every member is paired with one centre, and components found
so far drop out. What is left are texts that share parts with texts of other components. Each of them leaves out its c - 1
most frequent keys, c being the number of equal parts that any partner must share with it; those that still meet another
component are joined exactly on the rarest n-grams of their whole sets (a prefix filter in order of frequency), which
tells apart many variants of one text. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import doc_texts, write_table
from tidemark.llm.components import components
from tidemark.llm.shingles import lowered, mix, shingle_set

#: Ratio of the largest to the smallest size of a class.
CLASS_RATIO = 1.6


def spare(d: int) -> int:
    """Fragments beyond d, so that equal parts remain besides the empty ones: few sets have more empty parts than this."""
    return 3 + d // 6 if d else 0


def size_classes(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(class, d) of the classes that a set of n belongs to: one or two. t = num / den."""
    t = num / den
    step = math.log(CLASS_RATIO * t)
    out = []
    last = int(math.log(max(n, 1)) / step) + 1
    for c in range(max(0, last - 4), last + 1):
        lo = math.exp(step * c)
        hi = lo * CLASS_RATIO
        if lo * (1 - 1e-9) <= n <= hi * (1 + 1e-9):
            d = (den - num) * 2 * math.floor(hi * (1 + 1e-9)) // (den + num)
            out.append((c, d))
    return out


def fragments(shingles: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, size, class) of every part of a sorted set. Empty parts have keys too, if the set has more than spare(d) of them."""
    keys, sizes, classes = [], [], []
    with np.errstate(over="ignore"):
        mixed = mix(shingles * np.uint64(0xA24BAED4963EE407))
        for c, d in size_classes(len(shingles), num, den):
            m = d + 1 + spare(d)
            cell = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            cells, size = cell[at], np.diff(np.concatenate((at, [len(shingles)])))
            total = np.add.reduceat(mixed, at)
            if m - len(cells) > spare(d):
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), cells)
                cells, size = np.concatenate((cells, empty)), np.concatenate((size, np.zeros(len(empty), size.dtype)))
                total = np.concatenate((total, np.zeros(len(empty), np.uint64)))
            keys.append(mix(total + cells * np.uint64(0x9FB21C651E98DF25) + np.uint64(c + 1) * np.uint64(0xD1342543DE82EF95)))
            sizes.append(size)
            classes.append(np.full(len(size), c))
    return np.concatenate(keys), np.concatenate(sizes), np.concatenate(classes)


def cell_counts(shingles: np.ndarray, d: int) -> bytes:
    """Elements in each of some equal ranges of the hash order, about four in a range; the minima of two sets bound their overlap."""
    cells = max(16, 3 * d // 2)
    at = ((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def sure_parts(shingles: np.ndarray, d: int) -> int:
    """Non-empty equal parts that a linked set of the class has in common with this one, at least."""
    m = d + 1 + spare(d)
    empty = m - len(np.unique(((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)))
    return max(1, m - d - empty)


PARTS = "doc_id long, n long, first_id long, keys array<long>, metas array<int>, cells array<struct<cls: int, sure: int, counts: binary>>"


def _parts(k: int, num: int, den: int):
    """A row for each text: the parts of its set; a repeated set in the same task only names the text that had it first."""

    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("first_id", pa.int64()),
        ("keys", pa.list_(pa.int64())), ("metas", pa.list_(pa.int32())),
        ("cells", pa.list_(pa.struct([("cls", pa.int32()), ("sure", pa.int32()), ("counts", pa.binary())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts, strict=True):
                with np.errstate(over="ignore"):
                    s = shingle_set(lowered(text.as_py()), k)
                    mark = (len(s), int(s.sum()), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum())) if len(s) else None
                if mark is None or mark in seen:
                    rows.append((doc_id, len(s), seen.get(mark, doc_id), None, None, None))
                    continue
                seen[mark] = doc_id
                key, size, cls = fragments(s, num, den)
                cells = [
                    {"cls": c, "sure": sure_parts(s, d), "counts": cell_counts(s, d)}
                    for c, d in size_classes(len(s), num, den)
                ]
                rows.append((doc_id, len(s), doc_id, key.view(np.int64), (cls << 16 | np.minimum(size, 65535)).astype(np.int32), cells))
                if len(rows) >= 512:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    def _batch(rows, schema):
        columns = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _enough(inter, na, nb, num: int, den: int):
    return F.lit(den) * inter >= F.lit(num) * (na + nb - inter)


def _may_reach(num: int, den: int):
    """Pairs whose overlap, bounded by the minima of the cells' counts, may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, na, nb in zip(*(batch.column(n) for n in ("ca", "cb", "na", "nb")), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                most = int(np.minimum(u, v).sum(dtype=np.int64))
                need = num * (na.as_py() + nb.as_py())
                keep.append((den + num) * most >= need or int(u.max()) == 255 or int(v.max()) == 255)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _reach(num: int, den: int):
    """Pairs whose whole sets, packed as sorted 64-bit values, reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                inter = len(np.intersect1d(u, v, assume_unique=True))
                keep.append((den + num) * inter >= num * (len(u) + len(v)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                packed = [shingle_set(lowered(t.as_py()), k).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "grams"])

    return run


def _both(pairs: DataFrame, side: DataFrame, on: list[str], name: str, a: str, b: str) -> DataFrame:
    """pairs with column name of side, joined for each end of a pair, as columns a and b."""
    rest = [c for c in on if c != "doc_id"]
    for end, out in (("a", a), ("b", b)):
        pairs = pairs.join(side.select(F.col("doc_id").alias(end), *rest, F.col(name).alias(out)), [end, *rest])
    return pairs


def _proved(pairs: DataFrame, texts: DataFrame, parts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links among pairs (a, b, na, nb, cls, lb): by the summed partial overlaps, or else by the overlap of the whole sets."""
    enough = _enough(F.col("lb"), F.col("na"), F.col("nb"), num, den)
    sure = pairs.where(enough).select("a", "b")
    cells = parts.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.cls", "c.counts")
    open_ = _both(pairs.where(~enough), cells, ["doc_id", "cls"], "counts", "ca", "cb")
    open_ = write_table(open_.mapInArrow(_may_reach(num, den), "a long, b long, na long, nb long"), "open-pairs")
    if open_.isEmpty():
        return sure
    wanted = open_.select(F.col("a").alias("doc_id")).unionByName(open_.select(F.col("b").alias("doc_id"))).distinct()
    sets = write_table(texts.join(wanted, "doc_id").mapInArrow(_sets(k), "doc_id long, grams binary"), "sets")
    met = _both(open_, sets, ["doc_id"], "grams", "ga", "gb")
    return sure.unionByName(met.mapInArrow(_reach(num, den), "a long, b long"))


def _summed(met: DataFrame) -> DataFrame:
    """Partial overlaps summed per pair; a pair of two classes takes the better sum, not both."""
    each = met.groupBy("a", "b", "na", "nb", "cls").agg(F.sum("size").alias("lb"))
    best = each.groupBy("a", "b", "na", "nb").agg(F.max(F.struct("lb", "cls")).alias("best"))
    return best.select("a", "b", "na", "nb", F.col("best.cls").alias("cls"), F.col("best.lb").alias("lb"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, component, ...) of keys that two components or more share."""
    w = Window.partitionBy("key")
    both = rows.withColumn("lo", F.min("component").over(w)).withColumn("hi", F.max("component").over(w))
    return both.where("lo < hi").drop("lo", "hi")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            sets = [np.frombuffer(g.as_py(), np.int64) for g in part.column(1)]
            doc_ids = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.record_batch([pa.array(doc_ids), pa.array(np.concatenate(sets))], names=["doc_id", "gram"])


def _rarest_links(left: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """All links between texts of left (doc_id, component) that are in different components.

    A linked pair shares an n-gram among the n - ceil(t n) + 1 rarest of either text. Those that occur once among these
    texts take their places in the prefix, but need not be kept.
    """
    ids = left.select("doc_id")
    sets = write_table(texts.join(ids, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_sets(k), "doc_id long, grams binary"), "left-sets")
    rows = sets.mapInArrow(_grams, "doc_id long, gram long")
    rows = rows.withColumn("many", F.count("*").over(Window.partitionBy("gram"))).where("many > 1")
    own = Window.partitionBy("doc_id")
    sized = left.join(sets.select("doc_id", (F.octet_length("grams") / 8).cast("long").alias("n")), "doc_id")
    placed = rows.withColumn("place", F.row_number().over(own.orderBy("many", "gram"))).withColumn("common", F.count("*").over(own))
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.col("common"))
    kept = placed.join(sized, "doc_id").where(F.col("place") <= prefix).withColumn("after", F.col("common") - F.col("place"))
    kept = write_table(kept.select("gram", "doc_id", "component", "n", "after"), "prefixes")
    x, y = kept.alias("x"), kept.alias("y")
    # At the rarest common n-gram of a pair, no more can be common than what comes after it in either.
    fits = _enough(1 + F.least("x.after", "y.after"), F.col("x.n"), F.col("y.n"), num, den)
    met = x.join(y, F.expr("x.gram = y.gram and x.doc_id < y.doc_id and x.component <> y.component") & fits)
    pairs = met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    return _both(pairs, sets, ["doc_id"], "grams", "ga", "gb").mapInArrow(_reach(num, den), "a long, b long")


def jaccard_components(
    docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 1
) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of texts linked by 100 * |A n B| / |A u B| >= 100 * num / den.

    Words are runs of characters other than ASCII white space, A-Z lowered. A null or empty text, or one without words,
    has no shingle and is linked with nothing; fewer than k words make one shingle. Rows that repeat an id count once
    for each row; ties cannot change the result, since components do not depend on an order. Extra columns are ignored.
    """
    texts = doc_texts(docs, id_col, text_col)
    parts = write_table(
        texts.mapInArrow(_parts(k, num, den), PARTS), "parts"
    )
    w = Window.partitionBy("key")
    rows = parts.where("keys is not null").select(
        "doc_id", "n", F.explode(F.arrays_zip("keys", "metas")).alias("p")
    ).select(
        F.col("p.keys").alias("key"), "doc_id", F.shiftleft("n", 32).bitwiseOR(F.col("p.metas").cast("long")).alias("meta")
    )
    shared = rows.withColumn("lo", F.min("doc_id").over(w)).withColumn("hi", F.max("doc_id").over(w)).withColumn("many", F.count("*").over(w)).where("lo < hi")
    shared = write_table(
        shared.select(
            "key", "doc_id", "many", F.shiftright("meta", 32).alias("n"),
            F.shiftright("meta", 16).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("cls"),
            F.col("meta").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("size"),
        ),
        "met",
    )
    # The text that others were made from shares the most parts with them: it is the best centre.
    hub = shared.groupBy("doc_id").agg(F.sum("many").alias("hub"))
    shared = write_table(shared.join(hub, "doc_id"), "shared")
    links = parts.where("first_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    labelled = shared.withColumn("component", F.col("doc_id"))
    for turn in range(star_rounds):
        first = (-F.col("hub"), F.col("doc_id"))[turn % 2]
        order = F.struct(first.alias("first"), "doc_id", "n", "component")
        centre = labelled.groupBy("key").agg(F.min(order).alias("c")).select(
            "key", F.col("c.doc_id").alias("cd"), F.col("c.n").alias("cn"), F.col("c.component").alias("cc")
        )
        met = labelled.join(centre, "key").where("cc <> component").select(
            F.least("doc_id", "cd").alias("a"), F.greatest("doc_id", "cd").alias("b"),
            F.when(F.col("doc_id") < F.col("cd"), F.col("n")).otherwise(F.col("cn")).alias("na"),
            F.when(F.col("doc_id") < F.col("cd"), F.col("cn")).otherwise(F.col("n")).alias("nb"), "cls", "size",
        )
        fits = met.where(_enough(F.least("na", "nb"), F.col("na"), F.col("nb"), num, den))
        pairs = write_table(_summed(fits), "pairs")
        links = write_table(links.unionByName(_proved(pairs, texts, parts, k, num, den)), "links")
        label = components(links)
        named = labelled.drop("component").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        labelled = write_table(_mixed(named.withColumn("component", F.coalesce("component", "doc_id"))), "labelled")
    place = F.row_number().over(Window.partitionBy("doc_id", "cls").orderBy(F.desc("many"), "key"))
    sure = parts.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.cls", "c.sure")
    rare = shared.select("key", "doc_id", "cls", "many").join(sure, ["doc_id", "cls"]).withColumn("place", place).where("place >= sure")
    rare = _mixed(labelled.join(rare.select("key", "doc_id", "cls"), ["key", "doc_id", "cls"]))
    left = write_table(rare.groupBy("doc_id").agg(F.min("component").alias("component")), "left")
    if not left.isEmpty():
        links = write_table(links.unionByName(_rarest_links(left, texts, k, num, den)), "links")
    label = components(links)
    return parts.select("doc_id", F.col("n").alias("n_shingles")).join(
        label.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose component has a smaller id; texts without words all stay. Columns are unchanged.

    Null and empty texts stay, as do all rows of the id that is kept; rows with a null id are never judged. An empty table
    gives an empty one.
    """
    found = jaccard_components(docs, k, num, den)
    return docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
