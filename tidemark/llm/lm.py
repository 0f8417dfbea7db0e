"""Hierarchical Pitman-Yor language model whose Chinese-restaurant seatings are sampled.

Each word, and the end of a text, is the context of a restaurant of the words that follow it. All these restaurants share
one parent, the restaurant of no context, whose base is even over the known words with a share for unknown ones. A table
of a context's restaurant is a customer of the parent. A sweep takes all customers of a dish out and seats them again, given
the parent's probabilities and the other dishes' tables of the sweep before (`seating.resample`, a block Gibbs step with a
Metropolis test); the parent then meets the changed number of customers. Probabilities are averaged over the sweeps
after the first.

Words are 64-bit hashes. Texts are read once: each task cuts its texts into chunks and sends a chunk's pairs of
neighbouring words to buckets by the context's hash, with the place of their text in the chunk. Contexts that a sample
shows to be frequent are spread over all buckets by pair; only their totals, as many as buckets at most times a constant,
pass through the driver. A bucket holds whole restaurants (or a part of a spread one), seats its pairs, and at last adds
up the log probabilities per chunk and text. The parent's probabilities reach the buckets by a broadcast of the TOP most
frequent words and by a join for all others. Equal texts of a chunk are counted with their number and scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_texts, write_bucketed, write_table
from tidemark.llm.seating import Seatings, arrive, resample
from tidemark.llm.shingles import lowered, mix, spaced_words

#: Bytes of text in a chunk, and on average in a bucket.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 10 << 20
#: Rows of the sample that shows which contexts are frequent; a context is spread over the buckets if its share exceeds
#: one in SPREAD times their number. It settles only where pairs are worked on.
SAMPLE_ROWS, SPREAD = 20_000, 8
#: Most frequent words whose probabilities are broadcast.
TOP = 1 << 16
#: Stands for a word that is not among the sample's most frequent, whose places are sent in place of their hashes.
RARE = np.uint16(0xFFFF)
STRENGTH = 1.0
#: Sweeps, and how many of the first are not averaged.
SWEEPS, BURN_IN = 3, 1
END = np.uint64(0x51ED270B7F3A9C15)
_pair = np.uint64(0xA0761D6478BD642F)
_piece = 1 << 19


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, their bytes in planes."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(planes), 3)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in (x.split(",") for x in raw[4:at].decode().split(";")):
        dtype, n = np.dtype(kind), int(n)
        size = n * dtype.itemsize
        out.append(np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
        at += size
    return out


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of data cut at spaces or line feeds."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _piece)
        if end < len(data):
            cut = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end))
            if cut < 0:
                found = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
                cut = min(found, default=len(data))
            end = cut
        yield at, data[at:end]
        at = end


def text_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, index of the text) of every token, an end after each text; the context of a first word is the end."""
    data = b"\n".join(texts)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    found = [(h, s + at) for at, part in _pieces(data) for h, s in (spaced_words(part),)]
    words = np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64)
    starts = np.concatenate([s for _, s in found]) if found else np.empty(0, np.int64)
    own = np.searchsorted(np.cumsum(sizes), starts, side="right").astype(np.int32)
    after = np.full(len(words) + len(texts), END)
    after[np.arange(len(words)) + own] = words
    before = np.concatenate(([END], after[:-1]))
    return before, after, np.repeat(np.arange(len(texts), dtype=np.int32), np.bincount(own, minlength=len(texts)) + 1)


def _route(before: np.ndarray, after: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """64-bit values whose upper bits choose the bucket: of the context, or of the pair where the context is spread."""
    with np.errstate(over="ignore"):
        return np.where(_inside(before, spread), mix(before * _pair + after), before)


def _inside(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _bucket(route: np.ndarray, buckets: int) -> np.ndarray:
    return ((route >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(texts: list[bytes]) -> pa.RecordBatch:
        found, n = np.unique(text_pairs(texts)[1], return_counts=True)
        return pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], names=["w", "n"])

    held, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            held.append(lowered(t.as_py()))
            size += len(held[-1]) + 1
            if size >= CHUNK_BYTES:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)


CHUNKS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.binary())])
CHUNKS_SQL = "bucket int, chunk long, pairs binary, doc_ids array<long>, texts binary"


def _codes(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places of words among the sorted frequent ones, or RARE."""
    if not len(frequent):
        return np.full(len(words), RARE)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, at, RARE).astype(np.uint16)


def _hashes(codes: np.ndarray, rare: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    out = np.append(frequent, END)[np.minimum(codes, len(frequent))]
    out[codes == RARE] = rare
    return out


def _chunks(buckets: int, spread: np.ndarray, frequent: np.ndarray):
    """Of each chunk: a row with its documents, and one for each bucket with the pairs that belong there."""

    def chunk(number: int, doc_ids: list, seen: dict[bytes, list[int]], groups: list[int], rows: list[int]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(seen), np.int64)
        for g, learned in zip(groups, rows, strict=True):
            times[g] += learned
        order = np.argsort(times, kind="stable")  # equal numbers of learned copies side by side: a few marks tell them
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = list(seen)
        before, after, own = text_pairs([keys[i] for i in order])
        lengths = np.bincount(own, minlength=len(keys)).astype(np.uint32)
        # A null id is written as 0 and marked.
        null = np.array([i is None for i in doc_ids])
        about = packed(place[np.array(groups, np.int64)].astype(np.uint16), lengths, null.astype(np.uint8))
        yield _row(CHUNKS, number % buckets, number, None, [i or 0 for i in doc_ids], about)
        copies, first = np.unique(times[order], return_index=True)
        code = _codes(after, frequent)
        code_before = np.concatenate((_codes(np.array([END]), frequent), code[:-1]))
        route = _route(before, after, spread)
        order = np.argsort(route, kind="stable")
        before, after, own, bucket = before[order], after[order], own[order].astype(np.uint16), _bucket(route[order], buckets)
        code, code_before = code[order], code_before[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
            x, y = code_before[a:b], code[a:b]
            rare = (before[a:b][x == RARE], after[a:b][y == RARE])
            data = packed(x, y, *rare, own[a:b], copies.astype(np.uint32), first.astype(np.uint32), np.array([len(keys)], np.uint32))
            yield _row(CHUNKS, int(bucket[a]), number, data, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        doc_ids, groups, rows, seen = [], [], [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, learned = (c[i].as_py() for c in batch.columns)
                data = lowered(text)
                doc_ids.append(doc_id)
                groups.append(seen.setdefault(data, len(seen)))
                rows.append(int(learned))
                size += len(data) + 8
                if size >= CHUNK_BYTES or len(seen) == 1 << 16:
                    yield from chunk(number, doc_ids, seen, groups, rows)
                    number, size, doc_ids, groups, rows, seen = number + 1, 0, [], [], [], {}
        if doc_ids:
            yield from chunk(number, doc_ids, seen, groups, rows)

    return run


BUCKETS = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("tokens", pa.binary()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.binary())])
BUCKETS_SQL = "bucket int, pairs binary, tokens binary, chunk long, doc_ids array<long>, texts binary"


def _merged(frequent: np.ndarray):
    """Rows that come by bucket to one row for each: its distinct pairs with their training counts, and where their tokens are."""

    def close(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts = [unpacked(data) for _, data in held]
        before = np.concatenate([_hashes(p[0], p[2], frequent) for p in parts])
        after = np.concatenate([_hashes(p[1], p[3], frequent) for p in parts])
        learned = np.concatenate([p[5][np.searchsorted(p[6], p[4], side="right") - 1] for p in parts])
        texts = np.array([int(p[7][0]) for p in parts], np.int64)
        own = np.concatenate([p[4].astype(np.uint32) + np.uint32(o) for p, o in zip(parts, np.cumsum(texts) - texts, strict=True)])
        del parts
        contexts, c = np.unique(before, return_inverse=True)
        key = c.astype(np.uint64) << np.uint64(32)
        del before, c
        words, w = np.unique(after, return_inverse=True)
        key |= w.astype(np.uint64)
        del after, w
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.add.reduceat(learned[order].astype(np.int64), at).astype(np.uint32)
        pairs = packed(contexts, words, (key[at] >> np.uint64(32)).astype(np.uint32), key[at].astype(np.uint32), count)
        run = np.diff(np.append(at, len(key))).astype(np.uint32)
        tokens = packed(np.array([n for n, _ in held], np.int64), texts, run, own[order])
        return _row(BUCKETS, bucket, pairs, tokens, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, []
        for batch in batches:
            for b, chunk, pairs, doc_ids, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pairs is None:
                    yield _row(BUCKETS, b, None, None, chunk, doc_ids, texts)
                    continue
                if b != bucket and held:
                    yield close(bucket, held)
                    held = []
                bucket = b
                held.append((chunk, pairs))
        if held:
            yield close(bucket, held)

    return run


def _totals(spread: np.ndarray):
    """(kind, key, a, b): 0 word, training count, contexts; 1 spread context, distinct followers; 2 pairs that occur key times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                contexts, words, c, w, count = unpacked(data)
                learned = count > 0
                tokens, met = np.bincount(w, count, len(words)).astype(np.int64), np.bincount(w[learned], minlength=len(words))
                own = met > 0
                wide = np.flatnonzero(_inside(contexts, spread))
                followers = np.bincount(c[learned], minlength=len(contexts))[wide]
                key = np.concatenate((words[own].view(np.int64), contexts[wide].view(np.int64), [1, 2]))
                a = np.concatenate((tokens[own], followers, [(count == 1).sum(), (count == 2).sum()]))
                b = np.concatenate((met[own], np.zeros(len(wide) + 2, np.int64)))
                kind = np.repeat([0, 1, 2], [own.sum(), len(wide), 2]).astype(np.int8)
                yield pa.record_batch([pa.array(kind), pa.array(key), pa.array(a), pa.array(b)], names=["kind", "key", "a", "b"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the pairs with more than one customer, whose tables are not settled, and their restaurants' totals."""
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            contexts, words, c, w, count = unpacked(data)
            many = count > 1
            total = np.bincount(c, count, len(contexts)).astype(np.int64)
            followers = np.bincount(c[count > 0], minlength=len(contexts))
            own_c, c = np.unique(c[many], return_inverse=True)
            own_w, w = np.unique(w[many], return_inverse=True)
            n = int(many.sum())
            state = packed(
                contexts[own_c], total[own_c], followers[own_c], words[own_w], c.astype(np.uint32), w.astype(np.uint32), count[many],
                np.zeros(n, np.uint32), np.empty(0, np.int64),
            )
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([state], pa.binary())], names=["bucket", "state"])


def _asked(column: int, top: np.ndarray):
    """(bucket, w): words of each bucket whose probabilities are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = unpacked(data)[column]
                words = words[~_inside(words, top)]
                yield pa.record_batch([pa.array(np.full(len(words), bucket, np.int32)), pa.array(words.view(np.int64))], names=["bucket", "w"])

    return run


class Top:
    """Values of the most frequent words, by hash."""

    def __init__(self, words: DataFrame, *columns: str):
        got = words.where("top").select("w", *columns).toArrow()
        w = got.column("w").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(w)
        self.words, self.values = w[order], [got.column(c).to_numpy()[order] for c in columns]

    def of(self, words: np.ndarray, told: pd.DataFrame, *columns: str) -> list[np.ndarray]:
        """The values of words, from these or from rows told (w, columns); 0 where neither has them."""
        out = [np.zeros(len(words)) for _ in columns]
        more = told["w"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(more)
        for keys, values in ((self.words, self.values), (more[order], [told[c].to_numpy()[order] for c in columns])):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                hit = keys[at] == words
                for x, v in zip(out, values, strict=True):
                    x[hit] = v[at[hit]]
        return out


def _seeds(keys: np.ndarray, sweep: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64(sweep + 1) * np.uint64(0xD6E8FEB86659FD93))


def context_tables(contexts: np.ndarray, followers: np.ndarray, c: np.ndarray, more: np.ndarray, spread: dict[int, int]) -> np.ndarray:
    """Tables of each restaurant: one a follower and those beyond the first; of spread ones the totals of all buckets."""
    tables = followers + np.bincount(c, more, len(contexts)).astype(np.int64)
    for i in np.flatnonzero(_inside(contexts, np.array(sorted(spread), np.uint64))):
        tables[i] = spread[int(contexts[i])]
    return tables


def _sweep(top: Top, spread: dict[int, int], discount: float, sweep: int):
    """One bucket: all its repeated pairs seated again; with the numbers of tables beyond the first by word and by spread context."""

    def run(key: tuple, state: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in state["state"]:
            contexts, total, followers, words, c, w, count, extra, at = unpacked(data)
            (p,) = top.of(words, told, "p")
            now, customers = Seatings(extra, at), count.astype(np.int64)
            others = context_tables(contexts, followers, c, now.counts, spread)[c] - (now.counts + 1)
            a, b = (STRENGTH + discount * others) * p[w], discount * p[w]
            with np.errstate(over="ignore"):
                seeds = _seeds(contexts[c] * _pair + words[w], sweep)
            new = resample(now, customers, a, b, discount, seeds) if sweep else arrive(customers, a, b, discount, seeds)
            made = packed(contexts, total, followers, words, c, w, count, new.counts.astype(np.uint32), new.at)
            by_word = np.bincount(w, new.counts, len(words)).astype(np.int64)
            own = by_word > 0
            wide = np.flatnonzero(_inside(contexts, np.array(sorted(spread), np.uint64)))
            by_context = np.bincount(c, new.counts, len(contexts)).astype(np.int64)[wide]
            rows.append((key[0], made, packed(words[own], by_word[own], contexts[wide], by_context)))
        return pd.DataFrame(rows, columns=["bucket", "state", "sums"])

    return run


def _sweep_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n) of a sweep: 0 word, 1 spread context."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            words, n, contexts, m = unpacked(data)
            kind = np.repeat([0, 1], [len(words), len(contexts)]).astype(np.int8)
            yield pa.record_batch(
                [pa.array(kind), pa.array(np.concatenate((words, contexts)).view(np.int64)), pa.array(np.concatenate((n, m)))], names=["kind", "key", "n"]
            )


def _parent(tables: int, base: float, discount: float, sweep: int):
    """The parent's dishes after a sweep: (w, c, contexts, top, ps, customers, at), the seating followed to the new number of customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            customers, before = batch.column("customers").to_numpy().astype(np.int64), batch.column("present").to_numpy().astype(np.int64)
            lists = batch.column("at").combine_chunks() if isinstance(batch.column("at"), pa.ChunkedArray) else batch.column("at")
            old = Seatings(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
            words = batch.column("w").to_numpy().astype(np.int64).view(np.uint64)
            others = tables - (old.counts + 1)
            a, b = (STRENGTH + discount * others) * base, np.full(len(words), discount * base)
            kept = old.cut(customers)
            now = arrive(customers, a, b, discount, _seeds(words, 2 * sweep), kept, np.minimum(before, customers))
            if sweep:
                now = resample(now, customers, a, b, discount, _seeds(words, 2 * sweep + 1))
            at = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(now.counts)).astype(np.int32)), pa.array(now.at))
            yield pa.record_batch([*(batch.column(c) for c in ("w", "c", "contexts", "top", "ps", "customers")), at], names=["w", "c", "contexts", "top", "ps", "customers", "at"])

    return run


WORDS_SQL = "w long, c long, contexts long, top boolean, ps array<double>, customers long, at array<long>"


def _scored(samples: list[tuple[float, dict[int, int]]], spread_counts: dict[int, int], top: Top, discount: float, n: int, v: int):
    """One bucket: packed sums per chunk and text of tokens, known ones, base and model log probabilities.

    samples: the unknown word's probability in the parent and the spread contexts' tables, of each averaged sweep.
    """
    columns = ["c", *(f"p{i}" for i in range(len(samples)))]
    wide = np.array(sorted(spread_counts), np.uint64)

    def run(key: tuple, bucket: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        states = [unpacked(x) for x in told[told["state"].notna()].sort_values("sample")["state"]]
        told = told[told["state"].isna()]
        for pairs, tokens in zip(bucket["pairs"], bucket["tokens"], strict=True):
            contexts, words, c, w, count = unpacked(pairs)
            known, *ps = top.of(words, told, *columns)
            total = np.bincount(c, count, len(contexts))
            followers = np.bincount(c[count > 0], minlength=len(contexts))
            for i in np.flatnonzero(_inside(contexts, wide)):
                total[i] = spread_counts[int(contexts[i])]
            many = np.flatnonzero(count > 1)
            p = np.zeros(len(c))
            for (unknown, spread), mine, extra in zip(samples, ps, states, strict=True):
                more = np.zeros(len(c), np.int64)
                more[many] = extra[0]
                tables = context_tables(contexts, followers, c, more, spread)
                parent = np.where(known > 0, mine, unknown)
                own = np.where(count > 0, count - discount * (1 + more), 0.0)
                p += (own + (STRENGTH + discount * tables[c]) * parent[w]) / (STRENGTH + total[c])
            score, base = np.log10(p / len(samples)), np.log10((known + 1) / (n + (v + 1)))[w]
            chunks, texts, run_length, own = unpacked(tokens)
            each = np.repeat(np.arange(len(c), dtype=np.int32), run_length)
            size = int(texts.sum())
            many_tokens = np.bincount(own, minlength=size)
            seen = np.bincount(own, (known > 0)[w][each], size)
            sums = [np.bincount(own, x[each], size) for x in (base, score)]
            end = np.cumsum(texts)
            for chunk, a, b in zip(chunks.tolist(), end - texts, end, strict=True):
                at = np.flatnonzero(many_tokens[a:b]) + a
                rows.append((chunk, packed((at - a).astype(np.uint16), seen[at].astype(np.uint32), sums[0][at], sums[1][at].astype(np.float32))))
        return pd.DataFrame(rows, columns=["chunk", "sums"])

    return run


def _samples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the written states only the tables beyond the first, which scoring needs."""
    for batch in batches:
        kept = [packed(unpacked(x)[7]) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary())], names=["bucket", "state"])


def _per_text(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's sums added up, one row for each of its documents."""
    head = rows[rows["texts"].notna()].iloc[0]
    own, lengths, null = unpacked(head["texts"])
    known, base, score = (np.zeros(len(lengths)) for _ in range(3))
    for data in rows["sums"].dropna():
        at, k, b, s = unpacked(data)
        known[at] += k
        base[at] += b
        score[at] += s
    ids = pd.arrays.IntegerArray(np.array(head["doc_ids"], np.int64), null > 0)
    out = {"doc_id": ids, "n_tokens": lengths[own].astype(np.int64), "n_known": known[own].astype(np.int64), "base_score": base[own], "score": score[own]}
    return pd.DataFrame(out)


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every text; learned from those not held out.

    Tokens are the words of a text, A-Z lowered, and one end; a null or empty text has the end alone. Every row is scored by
    itself, also where its id is repeated; a null id is not held out and stays null. A word that no training text has is the
    unknown type. Extra columns are ignored; an empty table gives an empty one, and with no training text all words are unknown.
    """
    texts = doc_texts(docs, id_col, text_col).select("doc_id", "text", (~held_out()).alias("learned"))
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("text") + 8)).first()
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    share = max(1, -(-rows // SAMPLE_ROWS))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text").mapInArrow(_sampled_words, "w long, n long")
    sample = write_table(sample.groupBy("w").agg(F.sum("n").alias("n")), "sampled-words")
    least = (sample.agg(F.sum("n")).first()[0] or 0) / (SPREAD * buckets)
    often = sample.where(F.col("n") > least).collect() if buckets > 1 else []  # fewer than SPREAD * buckets words can be
    spread = np.sort(np.array([r.w for r in often], np.int64).view(np.uint64))

    often = sample.orderBy(F.desc("n"), "w").limit(int(RARE)).toArrow().column("w").to_numpy()
    frequent = np.sort(often.astype(np.int64).view(np.uint64))

    chunks = texts.mapInArrow(_chunks(buckets, spread, frequent), CHUNKS_SQL)
    by_bucket = chunks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged(frequent), BUCKETS_SQL)
    merged = write_bucketed(by_bucket, "pairs", "bucket", buckets)
    pairs = merged.where("pairs is not null")
    sums = pairs.select("pairs").mapInArrow(_totals(spread), "kind byte, key long, a long, b long")
    sums = write_table(sums.groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "totals")
    words = sums.where("kind = 0").select(F.col("key").alias("w"), F.col("a").alias("c"), F.col("b").alias("contexts"))
    n, v, once, twice, customers, only = (
        x or 0
        for x in words.agg(
            F.sum("c"), F.count("*"), *(F.sum((F.col("contexts") == i).cast("long")) for i in (1, 2)), F.sum("contexts"), F.sum((F.col("c") == 1).cast("long"))
        ).first()
    )
    followers = {int(np.int64(r.key).view(np.uint64)): r.a for r in sums.where("kind = 1").collect()}
    met = {r.key: r.a for r in sums.where("kind = 2").collect()}
    of_pairs, of_words = _discount(met.get(1, 0), met.get(2, 0)), _discount(once, twice)
    # The base's share for the unknown word is that of words seen once among all types.
    unknown = (only + 1) / (v + only + 2)
    base = (1 - unknown) / max(1, v)

    top = F.broadcast(words.where("c > 1").orderBy(F.desc("contexts"), "w").limit(TOP).select("w", F.lit(True).alias("top")))
    # A word seen once is one customer at one table in every sweep.
    state = words.where("c > 1").join(top, "w", "left").withColumn("top", F.coalesce("top", F.lit(False))).withColumn("ps", F.array().cast("array<double>"))
    state = state.withColumn("customers", F.col("contexts")).withColumn("present", F.lit(1).cast("long")).withColumn("at", F.array().cast("array<long>"))
    state = write_table(state.mapInArrow(_parent(v, base, of_words, 0), WORDS_SQL), "words")
    tables = only + (state.agg(F.sum(F.size("at") + 1)).first()[0] or 0)

    def parent_p(tables: int, customers: int):
        own = F.col("customers") - F.lit(of_words) * (F.size("at") + 1)
        return (own + F.lit((STRENGTH + of_words * tables) * base)) / F.lit(float(STRENGTH + customers))

    def parent_once(tables: int, customers: int) -> float:
        return (1 - of_words + (STRENGTH + of_words * tables) * base) / (STRENGTH + customers)

    seats = write_bucketed(pairs.select("bucket", "pairs").mapInArrow(_repeated, "bucket int, state binary"), "seats", "bucket", buckets)
    hot = Top(state).words
    asked = write_table(seats.mapInArrow(_asked(3, hot), "bucket int, w long"), "asked")
    totals, samples, singles, kept = dict(followers), [], [], None
    for sweep in range(SWEEPS):
        now = state.select("w", "top", parent_p(tables, customers).cast("float").alias("p"))
        told = asked.join(now.select("w", "p"), "w")
        seats = seats.select("bucket", "state").groupBy("bucket").cogroup(told.groupBy("bucket"))
        seats = seats.applyInPandas(_sweep(Top(now, "p"), totals, of_pairs, sweep), "bucket int, state binary, sums binary")
        seats = write_bucketed(seats, "seats", "bucket", buckets)
        more = seats.select("sums").mapInArrow(_sweep_sums, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
        more = write_table(more, "sweep-sums")
        wide = {int(np.int64(r.key).view(np.uint64)): r.n for r in more.where("kind = 1").collect()}
        totals = {k: x + wide.get(k, 0) for k, x in followers.items()}
        own = more.where("kind = 0").select(F.col("key").alias("w"), "n")
        state = state.withColumnRenamed("customers", "present").join(own, "w", "left").withColumn("customers", F.col("contexts") + F.coalesce("n", F.lit(0)))
        state = write_table(state.mapInArrow(_parent(tables, base, of_words, sweep + 1), WORDS_SQL), "words")
        tables, customers = (only + (x or 0) for x in state.agg(F.sum(F.size("at") + 1), F.sum("customers")).first())
        if sweep >= BURN_IN:
            state = state.withColumn("ps", F.concat("ps", F.array(parent_p(tables, customers))))
            samples.append(((STRENGTH + of_words * tables) * unknown / (STRENGTH + customers), totals))
            singles.append(parent_once(tables, customers))
            own = seats.select("bucket", "state").mapInArrow(_samples_of, "bucket int, state binary").withColumn("sample", F.lit(len(samples))).withColumn("w", F.lit(0).cast("long"))
            kept = own if kept is None else kept.unionByName(own)

    columns = [F.col("ps")[i].cast("float").alias(f"p{i}") for i in range(len(samples))]
    final = state.select("w", "top", "c", *columns)
    once = words.where("c = 1").select("w", "c", *(F.lit(p).cast("float").alias(f"p{i}") for i, p in enumerate(singles)))
    told = pairs.select("bucket", "pairs").mapInArrow(_asked(1, hot), "bucket int, w long").join(final.drop("top").unionByName(once), "w")
    told = told.unionByName(kept, allowMissingColumns=True)
    counts = {k: 0 for k in followers}
    if counts:
        wanted = sums.where("kind = 1").select(F.col("key").alias("w")).join(words, "w").select("w", "c").collect()
        counts |= {int(np.int64(r.w).view(np.uint64)): r.c for r in wanted}
    scored = _scored(samples, counts, Top(final, "c", *(f"p{i}" for i in range(len(samples)))), of_pairs, n, v)
    by_chunk = pairs.select("bucket", "pairs", "tokens").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(scored, "chunk long, sums binary")
    rows_of = by_chunk.unionByName(merged.where("doc_ids is not null").select("chunk", "doc_ids", "texts"), allowMissingColumns=True)
    each = rows_of.groupBy("chunk").applyInPandas(_per_text, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return each.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
