"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets. One min-wise order (the 64-bit shingle hash) gives each item its
bottom-k sketch; k is set per partition so that a text with containment >= num/den must hold one of the k smallest hashes
(k = q - ceil(q * num / den) + 1). A long text is not sketched by a fixed number of values, where short items would
drown: its sketch is every hash that does not exceed the partition's largest sketch value, so recall is exact and the
sketch still leaves most shingles out. Texts that meet a sketch value are verified on the words themselves.

The items are few beside the texts and go to the tasks in blocks of a bounded number of shingles; a larger benchmark
means more passes over the texts, never a larger broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_texts
from tidemark.llm.shingles import shingle_hashes, word_hashes

#: Characters of items in one block; a single longer item makes a block of its own.
BLOCK_CHARS = 4 << 20
#: Ratio of the largest to the smallest size in a partition.
SIZE_RATIO = 1.5

_gap = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower-cased letters and digits, one space between words."""
    return _gap.sub(" ", text.lower()).strip()


class Items:
    """The sketches and shingles of one block of items."""

    def __init__(self, rows: list[tuple[int, str]], k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.grams: dict[int, list[tuple[int, frozenset]]] = defaultdict(list)
        sized: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n, (item_id, text) in enumerate(rows):
            words = normal(text).split()
            if not words:
                continue
            width = min(k, len(words))
            hashes = np.unique(shingle_hashes(word_hashes(" ".join(words).encode()), width))
            self.grams[n] = (item_id, width, frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))
            sized[width, int(np.log(len(hashes)) / np.log(SIZE_RATIO))].append((n, hashes))
        #: By shingle width and size class: sorted sketch values, the items they belong to.
        self.parts: list[tuple[int, np.ndarray, list[list[int]]]] = []
        for (width, _), members in sorted(sized.items()):
            by_value: dict[int, list[int]] = defaultdict(list)
            for n, hashes in members:
                q = len(hashes)
                for h in hashes[: q + (-q * num // den) + 1].tolist():
                    by_value[h].append(n)
            values = sorted(by_value)
            self.parts.append((width, np.array(values, np.uint64), [by_value[v] for v in values]))

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, shingles shared, shingles of the item) of the items that text contains."""
        flat = normal(text)
        words = word_hashes(flat.encode("utf-8", "surrogatepass"))
        hashed: dict[int, np.ndarray] = {}
        hits: set[int] = set()
        for width, values, owners in self.parts:
            if width not in hashed:
                hashed[width] = shingle_hashes(words, width) if len(words) >= width else words[:0]
            h = hashed[width]
            h = h[h <= values[-1]]
            at = np.searchsorted(values, h)
            for i in np.unique(at[values[at] == h]).tolist():
                hits.update(owners[i])
        out = []
        if hits:
            split = flat.split()
            own: dict[int, set] = {}
            for n in hits:
                item_id, width, grams = self.grams[n]
                if width not in own:
                    own[width] = {" ".join(split[i : i + width]) for i in range(len(split) - width + 1)}
                shared = len(grams & own[width])
                if shared * self.den >= len(grams) * self.num:
                    out.append((item_id, shared, len(grams)))
        return sorted(out)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, one block at a time on the driver."""
    block: list[tuple[int, str]] = []
    chars = 0
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        chars += len(r.text)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): items of which a text holds num/den of the distinct k-word shingles or more.

    Words are lower-cased runs of letters and digits. An item of fewer than k words is one shingle of all its words. Null
    or empty texts and items are never part of a result; repeated rows and items give a row each; extra columns are
    ignored; no items or no texts give an empty table.
    """
    texts = doc_texts(docs)
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    found = None
    for block in item_blocks(items):
        index = Items(block, k, num, den)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc_id, *hit)
                    for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for hit in index.found(t.as_py())
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.record_batch(
                    [pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "shared", "item_shingles"]
                )

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return texts.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows that contain an item; judged in place, so no join moves a text. Columns are unchanged.

    Null and empty texts stay; rows that repeat an id are judged each; no items leave docs as they are, an empty table too.
    """
    for block in item_blocks(items):
        index = Items(block, k, num, den)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not index.found(t.as_py() or "") for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
