"""Phrase collocations against counting by loops."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import collocations


def brute(rows, least, share, limit):
    count = {}
    for lang, text in rows:
        own = count.setdefault("und" if lang is None else lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            ws = re.findall("[^ \t]+", piece)
            own.update(tuple(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = any(100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, i, phrase, -a, left, right, n, -s) for i, (s, a, _, phrase, left, right) in enumerate(sorted(ranked)[:limit], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "NASA", "état", "größe", "naïve", "x" * 300, "é", "É", "0", "-"]
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[9, 3, 5, 4, 2, 2, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 40))
        out.append((rng.choice(["en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v\f", "!?"]) for w in words)))
    out += [("en", "ha " * 400), ("en", None), ("de", ""), (None, ".,;"), ("fr", "one"), ("", "of the of the of the of the")]
    return out + [("en", "new york stock exchange opens. new york")] * 12


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, 1, 2, 3.0, "p") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, w1 long, a long, score double, p string").repartition(3)

    return make


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, table, small):
    if small:  # every prefix is over the budget, texts are cut, and tasks hand on what they hold
        monkeypatch.setattr(collocations, "CHUNK", 50)
        monkeypatch.setattr(collocations, "GATHERED", 20)
        plain = collocations.grouped
        monkeypatch.setattr(collocations, "grouped", lambda leaves: plain(leaves, 3))
    rows = texts(1, 120)
    got = sorted(tuple(r) for r in collocations.collocations(table(rows), least=5, share=100, limit=40).collect())
    assert got == brute(rows, 5, 100, 40)


def test_share_and_counters_over_a_byte(spark, table):
    rows = texts(2, 60)
    got = sorted(tuple(r) for r in collocations.collocations(table(rows), least=300, share=60, limit=10).collect())
    assert got == brute(rows, 300, 60, 10) and got


def test_collocations_of_nothing(spark, table):
    assert collocations.collocations(table([("en", None), (None, "")])).count() == 0
    assert collocations.collocations(table([("en", "x")]).limit(0)).count() == 0


def test_cuts_are_whole_pieces():
    data = b"aa bb.cc dd\n" * 30
    parts = list(collocations._cuts(data))
    assert b"".join(parts) == data
    collocations_chunk, collocations.CHUNK = collocations.CHUNK, 20
    try:
        parts = list(collocations._cuts(data))
        assert b"".join(parts) == data and all(p[-1:] in b".\n" for p in parts[:-1]) and max(map(len, parts)) <= 20
        assert list(collocations._cuts(b"a" * 50)) == [b"a" * 50]
        assert list(collocations._cuts(b"a" * 50 + b".b")) == [b"a" * 50 + b".", b"b"]
    finally:
        collocations.CHUNK = collocations_chunk


def test_leaves_and_subtree():
    w = np.array([[1, 2, 0, 0, 0], [1, 2, 3, 0, 0], [1, 2, 0, 0, 0], [4, 2, 0, 0, 0]], np.uint64)
    leaves, c = collocations._leaves(w, np.array([1, 1, 1, 5]))
    assert sorted(zip(leaves[:, 2].tolist(), c.tolist(), strict=True)) == [(0, 2), (0, 5), (3, 1)]
    pdf = pd.DataFrame([(2 * collocations.PARTS, len(c), leaves.tobytes() + c.tobytes())], columns=["part", "n", "leaves"])
    got = collocations._subtree(3)(pdf)
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(1, 2, 0, 0, 0, 3), (4, 2, 0, 0, 0, 5)]
    assert len(collocations._subtree(3)(pdf.assign(part=4 * collocations.PARTS))) == 3
    packed = collocations._packed(leaves, c, 2)
    again = collocations._unpacked(packed["leaves"], packed["n"])
    assert packed["n"].sum() == len(c)
    assert sorted(zip(map(tuple, again[0].tolist()), again[1].tolist(), strict=True)) == sorted(zip(map(tuple, leaves.tolist()), c.tolist(), strict=True))


def test_hashes_of_long_words_tell_places_apart():
    long = [b"a" * 70_000 + b"b" + b"a" * i for i in range(5)] + [b"b" + b"a" * 70_000, b"a" * 70_001, b"", b"a", b"b", b"ab", b"ba"]
    h, same, starts, ends = collocations.hashed("en", b" ".join(long))
    data = b" ".join(long)
    assert len(set(h.tolist())) == len({data[s:e] for s, e in zip(starts, ends, strict=True)}) == len(long) - 1
    assert same[:-1].all() and not same[-1]
    assert (collocations.hashed("en", b"a " + long[2])[0][1] == h[2]) and collocations.hashed("fr", long[2])[0][0] != h[2]
