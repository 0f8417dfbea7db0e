"""Phrase collocations from depth-truncated suffix trees, partitioned vertically as in ERA (Mansour et al., 2011).

A suffix is a position's word and up to four that follow it in its piece. A first pass counts words, the next two count
pairs and triples of what is left in hashed counters; a suffix ends before a word, pair or triple that cannot be frequent, so
what is left of it holds every frequent phrase. Prefixes of two words are dealt to parts, so that no node of two words or more is
cut; a part with more suffixes than the budget is dealt again by prefixes of a word more. Each part's subtree is its sorted leaves: a node at
depth d is a run of leaves that agree in d words, and the node's count is the sum of their totals. Words are 64-bit hashes
salted with their language; a collision that could touch a count is found and raised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import write_table
from tidemark.llm.shingles import WEIGHTS, lowered, mix

#: Words of the longest phrase, and the columns that hold a suffix; 0 ends it.
DEPTH = 5
WORDS = [f"w{i}" for i in range(1, DEPTH + 1)]
#: Bytes of text that are hashed at once, suffixes that a task gathers before it hands them on, and suffixes a group may hold.
CHUNK, GATHERED, BUDGET = 1 << 20, 1 << 19, 500_000
#: Parts that prefixes of one length are dealt to, a power of two, and shares of all leaves that a part may hold at most.
PARTS, SHARES = 1024, 128
PACKED = "part long, n long, leaves binary"
#: Least and most bits of a filter's address: a filter of the most takes 4 MB, its counters 32 MB of a task.
LEAST_BITS, MOST_BITS = 20, 25
#: What parts pieces, what parts words, and both.
PIECE, BLANK = b".,;:!?\n\v\f\r", b" \t"

#: Odd: a word's bytes are the digits of a number to this base.
BASE = 0xD1342543DE82EF95
_powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 16, BASE, np.uint64)])
_ends = np.zeros(256, bool)
_ends[list(PIECE)] = True
_gaps = _ends.copy()
_gaps[list(BLANK)] = True


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _cuts(data: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes, cut where pieces end; a longer piece stays whole."""
    begin = 0
    while len(data) - begin > CHUNK:
        cut = max(data.rfind(bytes([e]), begin, begin + CHUNK) for e in PIECE)
        if cut < 0:
            cut = min((at for e in PIECE if (at := data.find(bytes([e]), begin + CHUNK)) >= 0), default=-1)
        if cut < 0:
            break
        yield data[begin : cut + 1]
        begin = cut + 1
    yield data[begin:]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """(lang, bytes): texts of a language, lower-cased and joined by an end of piece."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            for part in _cuts(lowered(text)):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if size[lang] >= CHUNK:
                    size.pop(lang)
                    yield lang, b"\n".join(held.pop(lang))
        if sum(size.values()) >= 4 * CHUNK:
            yield from ((x, b"\n".join(parts)) for x, parts in held.items())
            held, size = {}, {}
    yield from ((x, b"\n".join(parts)) for x, parts in held.items())


def _power(place: np.ndarray) -> np.ndarray:
    """Powers of the base; those of places far into a very long word are put together from two."""
    low = _powers[place & 0xFFFF]
    if len(place) and int(place.max()) > 0xFFFF:
        far = np.array([pow(BASE, int(i) << 16, 1 << 64) for i in range((int(place.max()) >> 16) + 1)], np.uint64)
        low = low * far[place >> 16]
    return low


def hashed(lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash in this language, never 0; whether the next one is in the same piece; begin and end."""
    a = np.frombuffer(data, np.uint8)
    edge = np.diff(np.r_[False, ~_gaps[a], False].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, bool), starts, ends
    lengths = ends - starts
    within = np.flatnonzero(~_gaps[a])
    place = within - np.repeat(starts, lengths)
    digits = (a[within].astype(np.uint64) + np.uint64(1)) * _power(place)
    h = mix(mix(np.add.reduceat(digits, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)) ^ _salt(lang))
    h[h == 0] = 1
    piece = np.searchsorted(np.flatnonzero(_ends[a]), starts)
    return h, np.append(piece[1:] == piece[:-1], False), starts, ends


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, lang, word, f): how often each word of a language occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, data in _chunks(batches):
            h, _, starts, ends = hashed(lang, data)
            if len(h):
                one, at, c = np.unique(h, return_index=True, return_counts=True)
                words = [data[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pd.DataFrame({"h": one.view(np.int64), "lang": lang, "word": words, "c": c})

    counted = docs.mapInPandas(run, "h long, lang string, word string, c long")
    return counted.groupBy("h", "lang", "word").agg(F.sum("c").alias("f"))


def _filter(positions: DataFrame, bits: int) -> np.ndarray:
    """Packed bits that are set at the positions (column `at`), put together in blocks of 2^15 on the executors."""
    held = positions.groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767).cast("long")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in held:
        out[r.block * 4096 : r.block * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _grams(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Place of each run of k words in a filter."""
    total = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * WEIGHTS[j]
    return mix(total) & np.uint64((1 << bits) - 1)


def _passing(h: np.ndarray, same: np.ndarray, filters: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For k = 1, 2, ..: whether the k words from each place on are of one piece and may be frequent, by the filters of all lengths up to k.

    With one filter more than is given: there the two runs of one word less that it holds have passed.
    """
    out = [_set(filters[0], h & np.uint64((1 << bits) - 1))]
    for k in range(2, len(filters) + 2):
        if len(h) < k:
            out.append(np.zeros(0, bool))
            continue
        on = out[-1][:-1] & out[-1][1:]
        if k == 2:
            on &= same[:-1]
        if k <= len(filters):
            at = np.flatnonzero(on)
            on[at] = _set(filters[k - 1], _grams(h, k, bits)[at])
        out.append(on)
    return out


def gram_filter(docs: DataFrame, filters: list[np.ndarray], bits: int, least: int) -> np.ndarray:
    """Bits of the hashed counters that runs of one word more than the filters know raise to `least`; a run without its bit is rarer.

    Only runs whose parts pass the filters are counted.
    """
    kind = np.uint8 if least <= 255 else np.uint32
    most, k = np.iinfo(kind).max, len(filters) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(1 << bits, kind)
        for lang, data in _chunks(batches):
            h, same, _, _ = hashed(lang, data)
            if len(h) >= k:
                at, c = np.unique(_grams(h, k, bits)[_passing(h, same, filters, bits)[-1]], return_counts=True)
                counters[at] = np.minimum(counters[at].astype(np.int64) + c, most).astype(kind)
        for i in range(0, len(counters), 1 << LEAST_BITS):
            at = np.flatnonzero(counters[i : i + (1 << LEAST_BITS)]) + i
            yield pd.DataFrame({"at": at.astype(np.int32), "c": counters[at].astype(np.int64)})

    counted = docs.mapInPandas(run, "at int, c long").groupBy("at").agg(F.sum("c").alias("c"))
    return _filter(counted.where(F.col("c") >= least), bits)


def _leaves(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes as one, with the sum of their totals."""
    order = np.lexsort(w.T[::-1])
    w, c = w[order], c[order]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(axis=1)))
    return w[first], np.add.reduceat(c, first)


def _packed(w: np.ndarray, c: np.ndarray, length: int) -> pd.DataFrame:
    """Leaves by the part that their first words (so many) are dealt to; a part's number tells the length, too."""
    total = np.zeros(len(w), np.uint64)
    for j in range(length):
        total += w[:, j] * WEIGHTS[j]
    part = (mix(total) & np.uint64(PARTS - 1)).astype(np.int64) + length * PARTS
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    spans = zip(first, np.append(first[1:], len(order)), strict=True)
    rows = [(part[order[a]], b - a, w[order[a:b]].tobytes() + c[order[a:b]].tobytes()) for a, b in spans]
    return pd.DataFrame(rows, columns=["part", "n", "leaves"])


def _unpacked(leaves: pd.Series, n: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(np.frombuffer(x, np.uint64, k * DEPTH).reshape(k, DEPTH), np.frombuffer(x, np.int64, k, k * DEPTH * 8)) for x, k in zip(leaves, n, strict=True)]
    return np.concatenate([w for w, _ in pairs]), np.concatenate([c for _, c in pairs])


def suffixes(docs: DataFrame, filters: list[np.ndarray], bits: int) -> DataFrame:
    """(part, n, leaves): suffixes of two words or more, up to the first word, pair or triple that is rare, with how often a task met each.

    A task's leaves go packed, one row for each part that the first two words deal them to.
    """

    def frame(w: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        return _packed(w, c, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for lang, data in _chunks(batches):
            h, same, _, _ = hashed(lang, data)
            _, pair, triple, _ = _passing(h, same, filters, bits)
            at = np.flatnonzero(pair)
            if not len(at):
                continue
            w = np.zeros((len(at), DEPTH), np.uint64)
            w[:, 0], w[:, 1] = h[at], h[at + 1]
            going = np.ones(len(at), bool)
            for j in range(2, DEPTH):
                place = at + j - 2
                going &= place < len(triple)
                going[going] = triple[place[going]]
                w[going, j] = h[at[going] + j]
            held.append(_leaves(w, np.ones(len(at), np.int64)))
            rows += len(held[-1][0])
            if rows >= GATHERED:
                held = [_leaves(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
                rows = len(held[0][0])
                if rows >= GATHERED // 2:
                    yield frame(*held[0])
                    held, rows = [], 0
        if held:
            yield frame(*_leaves(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])))

    return docs.mapInPandas(run, PACKED)


def grouped(leaves: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Leaves in parts of at most a budget, where their words allow it: a part with more is dealt again by one word more of each prefix.

    The budget is no more than a small share of all leaves. The driver holds the numbers of the parts over it, fewer than shares.
    """
    total = leaves.agg(F.sum("n")).first()[0] or 0
    budget = max(1, min(budget, total // SHARES))

    def split(length: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(len(pdf)):
                    yield _packed(*_unpacked(pdf["leaves"].iloc[i : i + 1], pdf["n"].iloc[i : i + 1]), length)

        return run

    for length in range(3, DEPTH + 1):
        over = [r.part for r in leaves.where(F.col("part") >= (length - 1) * PARTS).groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > budget).collect()]
        if not over:
            break
        heavy = F.col("part").isin(over)
        leaves = write_table(leaves.where(~heavy).unionByName(leaves.where(heavy).mapInPandas(split(length), PACKED)), "suffixes")
    return leaves


def _subtree(least: int):
    """Counts of a part's nodes. Those above its prefixes are parts of a count, whatever their size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, c = _leaves(*_unpacked(pdf["leaves"], pdf["n"]))
        prefix = int(pdf["part"].iloc[0]) // PARTS
        out = []
        differs = np.ones(len(w), bool)
        agree = np.ones(len(w) - 1, bool)
        for d in range(DEPTH):
            agree &= w[1:, d] == w[:-1, d]
            differs[1:] = ~agree
            if not d:
                continue
            first = np.flatnonzero(differs)
            total = np.add.reduceat(c, first)
            keep = (w[first, d] != 0) & ((total >= least) | (prefix > d + 1))
            node = np.zeros((int(keep.sum()), DEPTH), np.int64)
            node[:, : d + 1] = w[first[keep], : d + 1].view(np.int64)
            out.append(pd.DataFrame(node, columns=WORDS).assign(f=total[keep]))
        return pd.concat(out)

    return run


def frequent_phrases(docs: DataFrame, dictionary: DataFrame, least: int) -> DataFrame:
    """(p array<long>, a): phrases of two to five words that occur at least `least` times, as hashes of their words."""
    n = dictionary.agg(F.sum("f")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(n).bit_length()))
    words = _filter(dictionary.where(F.col("f") >= least).select(F.col("h").bitwiseAND((1 << bits) - 1).cast("int").alias("at")), bits)
    filters = [words]
    for _ in range(2):
        filters.append(gram_filter(docs, filters, bits, least))
    leaves = write_table(suffixes(docs, filters, bits), "suffixes")
    nodes = grouped(leaves).groupBy("part").applyInPandas(_subtree(least), ", ".join(f"{w} long" for w in WORDS) + ", f long")
    whole = nodes.groupBy(*WORDS).agg(F.sum("f").alias("a")).where(F.col("a") >= least)
    return write_table(whole.select(F.filter(F.array(*WORDS), lambda w: w != 0).alias("p"), "a"), "phrases")


def _tail(p: Column, k: Column | int) -> Column:
    """All words of p after the first k."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(p, k + 1, F.size(p) - k)


def collocations(docs: DataFrame, least: int = 100, share: int = 100, limit: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by the score of their weakest cut.

    A phrase that occurs in a longer one at least share % as often as at all is dropped. Null texts are empty, a null language
    is `und`; texts without words, an empty table and languages without a frequent phrase give no row; repeated rows
    count as often as they are there. Ties go by count, then by the phrase's bytes. Other columns are left behind.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    dictionary = write_table(word_counts(texts), "words")
    if not dictionary.groupBy("h").agg(F.count("*").alias("k"), F.sum("f").alias("f")).where((F.col("k") > 1) & (F.col("f") >= least)).isEmpty():
        raise ValueError("two words share a hash")
    frequent = dictionary.where(F.col("f") >= least)
    phrases = frequent_phrases(texts, dictionary, least)

    parts = phrases.unionByName(frequent.select(F.array("h").alias("p"), F.col("f").alias("a")))
    size = F.size("p")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.slice("p", 1, size - 1), _tail(F.col("p"), 1))).alias("p"), "a")
    inside = inner.groupBy("p").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, "p", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).select("p", "a")

    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("left"), _tail(F.col("p"), F.col("k")).alias("right"))
    cut = cut.join(parts.select(F.col("p").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("p").alias("right"), F.col("a").alias("r")), "right")
    totals = dictionary.groupBy("lang").agg(F.sum("f").alias("n"))
    named = frequent.select(F.col("h").alias("first"), "lang").join(totals, "lang")
    cut = cut.withColumn("first", F.col("p")[0]).join(named, "first")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cut = cut.withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"]))
    weakest = cut.groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = weakest.select("p", "a", "lang", "n", "cut.score", "cut.l", "cut.r")
    by_score = [F.desc("score"), F.desc("a")]
    top = best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*by_score))).where(F.col("rank") <= limit).drop("rank")

    spelled = top.select("p", F.posexplode("p").alias("at", "h")).join(frequent.select("h", "word"), "h").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.concat_ws(" ", F.col("words.word")).alias("phrase")
    told = top.join(spelled.select("p", phrase), "p")
    ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase"))).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
