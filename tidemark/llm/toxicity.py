"""Toxicity by a noisy channel: suspicious spans are decoded to the likeliest clean spelling, then the restored text is scored.

Channel: a writer replaces letters by look-alikes, spreads a word over single characters, repeats letters, or puts marks
between letters. The lattice of a span has, at each position, an arc for each letter that the sign may stand for, for a
dropped separator and for a dropped repeat; each arc has a fixed channel cost. A character trigram model of the corpus'
clean words weighs the paths, and a Viterbi search takes the best. A span that can only stand for itself has one path and
is not searched. Restored words and their prefixes are the features of a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import doc_texts, write_table

# Signs and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*·~'"
# Channel costs in nats.
COST_LOOKALIKE, COST_DROP, COST_REPEAT, COST_KEEP_SIGN = 1.0, 0.5, 0.4, 6.0

#: Most labelled rows that the regression is fitted on (the first by hashed id).
FIT_ROWS = 20_000
#: A feature is kept if it is in MIN_ROWS rows and its likelihood ratio against the labels, for either label, reaches LEAST_RATIO
#: (a chi-square of one degree: one chance in ten thousand). The labels decide how many there are.
MIN_ROWS, LEAST_RATIO = 5, 15.1
#: Prefix lengths that are features besides the word.
PREFIXES = (4, 5)
#: Length of the speller's n-grams, and the least share of all letters that one must have to be kept: at most 1 / LEAST_SHARE
#: of each length have it, which bounds the table at any size of the corpus.
ORDER, LEAST_SHARE = 4, 1e-6
#: Entries of a worker's memo of words.
MEMO = 120_000

_word = re.compile(r"[^\W\d_]+")
_single = r"(?:[^\W_]|[@$!|+(€£¡])"
#: Three or more single letters or signs with a space between them.
_spaced = re.compile(rf"(\s)({_single}(?: {_single}){{2,}})(?![^\s.,;:?!])")
#: A sign or digit between letters or before two, or a tripled letter.
_noisy = re.compile(r"[^\W\d_][0-9@$!|+(€£¡.\-_*·~]+[^\W\d_]|[0-9@$|+(€£¡][^\W\d_]{2}|([^\W\d_])\1\1")
_tail = ".,;:!?\"')#%&*"
_edge = "\x02"


def _code(ch: str) -> int:
    """15 bits: the code point itself up to 0x6FFF; those above share the last 4,096 values and never a lower one."""
    at = ord(ch)
    return at if at < 0x7000 else 0x7000 | at & 0xFFF


class Speller:
    """Character n-grams with interpolated orders, and the Viterbi search over a span's lattice."""

    def __init__(self, grams: dict[int, int]):
        """grams: packed n-gram (15 bits a character, its length above bit 60) to count."""
        self.grams = grams
        self.totals: dict[int, int] = {}
        for k, n in grams.items():
            self.totals[k >> 15] = self.totals.get(k >> 15, 0) + n
        self.letters = max(2, sum(k >> 60 == 1 for k in grams))
        self.memo: dict[str, str] = {}
        self.costs: dict[tuple[str, str], float] = {}

    def cost(self, context: str, letter: str) -> float:
        """-log P(letter | context), each order smoothed by the one below."""
        key = (context, letter)
        if (known := self.costs.get(key)) is not None:
            return known
        p, packed, shift = 1.0 / (self.letters + 1), _code(letter), 15
        for n in range(ORDER):
            if n:
                packed |= _code(context[-n]) << shift
                shift += 15
            whole = packed | (n + 1) << 60
            p = (self.grams.get(whole, 0) + 4.0 * p) / (self.totals.get(whole >> 15, 0) + 4.0)
        self.costs[key] = out = -math.log(p)
        return out

    def decode(self, span: str) -> str:
        """The likeliest clean word for a span of signs and letters without white space."""
        if (known := self.memo.get(span)) is not None:
            return known
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[span] = out = self._best(span)
        return out

    def _best(self, span: str) -> str:
        # A path is its last letter and the path before; of equal costs the first found stays.
        beams: dict[tuple[str, str], tuple[float, tuple | None]] = {(_edge * (ORDER - 1), ""): (0.0, None)}
        for at, sign in enumerate(span):
            nxt: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            repeat = span[max(0, at - 2) : at + 3].count(sign) > 2

            def push(state, cost, path, nxt=nxt):
                old = nxt.get(state)
                if old is None or cost < old[0]:
                    nxt[state] = (cost, path)

            for (ctx, last), (cost, path) in beams.items():
                plain = sign.isalpha()
                for letter in sign if plain else LOOKALIKES.get(sign, ""):
                    paid = cost if plain else cost + COST_LOOKALIKE
                    if letter == last and repeat:
                        push((ctx, last), paid + COST_REPEAT, path)
                    push((ctx[1:] + letter, letter), paid + self.cost(ctx, letter), (letter, path))
                if not plain:
                    push((ctx, last), cost + (COST_DROP if sign in SEPARATORS else COST_KEEP_SIGN), path)
            beams = nxt
        path = min(((cost + self.cost(ctx, _edge), path) for (ctx, _), (cost, path) in beams.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            letter, path = path
            out.append(letter)
        return "".join(reversed(out))


def restored_token(token: str, speller: Speller) -> str:
    """The clean spelling of a token without white space; addresses and tokens with no noise stay as they are."""
    if not _noisy.search(token) or "://" in token or ("@" in token and "." in token):
        return token
    core = token.rstrip(_tail)
    if not _noisy.search(core) or 2 * sum(ch.isdigit() for ch in core) > len(core) + 1:
        return token
    return speller.decode(core) + token[len(core) :]


def _joined(text: str, speller: Speller) -> str:
    return _spaced.sub(lambda m: m[1] + speller.decode(m[2].replace(" ", "")), f" {text.lower()}")[1:]


def restore(text: str, speller: Speller) -> str:
    """Lower-cased text with every suspicious span followed by its clean spelling; nothing else changes."""
    return re.sub(r"\S+", lambda m: restored_token(m.group(), speller), _joined(text, speller))


def token_features(token: str, speller: Speller) -> list[str]:
    """Words and word prefixes of a restored token."""
    found = []
    for w in _word.findall(restored_token(token, speller)):
        found.append(f"={w}")
        found.extend(f"^{w[:n]}" for n in PREFIXES if len(w) > n)
    return found


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the character n-grams of words, from whole texts; a word's n-grams are counted once for each time it occurs."""
    words: Counter = Counter()

    def fold() -> pa.RecordBatch:
        clean = [(w, n) for t, n in words.items() if (w := t.rstrip(_tail)).isalpha()]
        words.clear()
        total: list[tuple[np.ndarray, np.ndarray]] = []
        if clean:
            pad = _edge * (ORDER - 1)
            a = np.frombuffer("".join(pad + w + _edge for w, _ in clean).encode("utf-32-le"), np.uint32).astype(np.int64)
            a = np.where(a < 0x7000, a, 0x7000 | a & 0xFFF)
            lengths = np.array([len(w) + ORDER for w, _ in clean])
            weight = np.repeat(np.array([n for _, n in clean], np.int64), lengths)
            offset = np.arange(len(a)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.flatnonzero(offset >= ORDER - 1)
            key, w = a[at], weight[at]
            for k in range(1, ORDER + 1):
                if k > 1:
                    key = key | a[at - (k - 1)] << (15 * (k - 1))
                found, back = np.unique(key, return_inverse=True)
                total.append((found | k << 60, np.bincount(back, w).astype(np.int64)))
        keys, counts = (np.concatenate(x) for x in zip(*total, strict=True)) if total else (np.empty(0, np.int64),) * 2
        return pa.record_batch([pa.array(keys), pa.array(counts)], names=["gram", "n"])

    for batch in batches:
        for t in batch.column(0):
            words.update(t.as_py().lower().split())
            if len(words) > MEMO:
                yield fold()
    yield fold()


def fit_speller(texts: DataFrame) -> Speller:
    """Character statistics over all texts: the n-grams whose share of all letters is LEAST_SHARE or more."""
    grams = write_table(
        texts.select("text").mapInArrow(_letter_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams"
    )
    letters = grams.where(F.shiftright("gram", 60) == 1).agg(F.sum("n")).first()[0] or 0
    kept = grams.where(F.col("n") >= LEAST_SHARE * letters).toArrow()
    return Speller(dict(zip(kept.column("gram").to_pylist(), kept.column("n").to_pylist(), strict=True)))


class Scorer:
    """Logistic regression over present features; a token's features are looked up once and remembered."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array, speller: Speller) -> Iterator[float]:
        weights = self.weights

        class Memo(dict):
            def __missing__(self, token: str) -> tuple:
                if len(self) > MEMO:
                    self.clear()
                self[token] = found = tuple(f for f in token_features(token, speller) if f in weights)
                return found

        memo = Memo()
        for t in texts:
            tokens = set(_joined(t.as_py() or "", speller).split())
            hits = set().union(*filter(None, map(memo.__getitem__, tokens)))
            x = self.bias + sum(weights[f] for f in sorted(hits))
            yield 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def _feature_rows(speller: Speller):
    class Memo(dict):
        def __missing__(self, token: str) -> tuple:
            if len(self) > MEMO:
                self.clear()
            self[token] = found = tuple(token_features(token, speller))
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            found = [sorted(set().union(*map(memo.__getitem__, set(_joined(t.as_py(), speller).split())))) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(2)], names=["doc_id", "fs", "y"])

    return run


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, features: int, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights and, last, the bias, with a ridge penalty on the weights: Newton steps by conjugate gradients.

    row and col are the places of the ones, so that work and memory follow the ones and not rows times features.
    """
    n = len(y)
    penalty = np.append(np.full(features, ridge), 1e-6)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[col], n) + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, r[row], features), r.sum())

    w = np.zeros(features + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        scale = np.append(np.bincount(col, h[row], features), h.sum()) + penalty
        step, left = np.zeros_like(w), back(y - p) - penalty * w
        z = left / scale
        way, size = z, left @ z
        goal = 1e-12 * size
        for _ in range(features + 1):
            if size <= goal:
                break
            curved = back(h * forward(way)) + penalty * way
            far = size / (way @ curved)
            step, left = step + far * way, left - far * curved
            z = left / scale
            size, old = left @ z, size
            way = z + size / old * way
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _indexed(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[f] for f in fs.as_py() if f in index] for fs in batch.column(0)]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["fs", "y"])

    return run


def fit_scorer(labelled: DataFrame, speller: Speller) -> Scorer:
    """labelled: (doc_id, text, y 0/1), at most FIT_ROWS of them."""
    rows = write_table(labelled.select("doc_id", "text", "y").mapInArrow(_feature_rows(speller), "doc_id long, fs array<string>, y int"), "features")
    n1, n = rows.agg(F.sum("y"), F.count("*")).first()
    n1, n = n1 or 0, n or 0
    if not n1 or n1 == n:
        return Scorer({}, math.log((n1 + 0.5) / (n - n1 + 0.5)))
    p1 = n1 / n
    counted = rows.select("y", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("k")).where(f"k >= {MIN_ROWS}")
    a, k = F.col("a"), F.col("k")
    cells = ((a, k * p1), (k - a, k * (1 - p1)), (n1 - a, (n - k) * p1), (n - n1 - k + a, (n - k) * (1 - p1)))
    gain = sum((F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells), F.lit(0.0))
    best = sorted(r.f for r in counted.where(2 * gain >= LEAST_RATIO).select("f").collect())
    index = {f: i for i, f in enumerate(best)}
    taken = rows.select("fs", "y").mapInArrow(_indexed(index), "fs array<int>, y int").toArrow()
    ones = [np.asarray(fs.as_py(), np.int64) for fs in taken.column("fs")]
    row = np.repeat(np.arange(len(ones)), [len(o) for o in ones])
    w = _logistic(row, np.concatenate([np.empty(0, np.int64), *ones]), taken.column("y").to_numpy().astype(float), len(best))
    return Scorer({f: float(w[i]) for f, i in index.items()}, float(w[-1]))


def _scores(speller: Speller, scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = list(scorer.scores(batch.column(1), speller))
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def restored_texts(docs: DataFrame, speller: Speller) -> DataFrame:
    """(doc_id, restored): the deobfuscated, lower-cased text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [restore(t.as_py(), speller) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(clean, pa.string())], names=["doc_id", "restored"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, restored string")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def toxicity_models(docs: DataFrame, labels: DataFrame) -> tuple[Speller, Scorer]:
    """Speller from all texts; scorer from labelled rows outside the held-out third. Null labels are left out.

    FIT_ROWS bounds the rows fitted on, and so the side that is broadcast.
    """
    texts = doc_texts(docs)
    speller = fit_speller(texts)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    scorer = fit_scorer(texts.where(~held_out()).join(F.broadcast(known), "doc_id"), speller)
    return speller, scorer


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts get the score of a text without features. Rows that repeat an id are scored each; a row without
    an id is scored, not held out, and has no label. With no
    labelled row, or labels of one kind only, every text gets the smoothed base rate. Extra columns are ignored.
    """
    speller, scorer = toxicity_models(docs, labels)
    scored = doc_texts(docs).mapInArrow(_scores(speller, scorer), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; scored in place, so no join moves a text.

    Null and empty texts are scored as texts without features; rows that repeat an id are judged each. Columns are unchanged
    whatever their names, but text is read; an empty table gives an empty one.
    """
    speller, scorer = toxicity_models(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = [s < threshold for s in scorer.scores(batch.column(at), speller)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
