"""Near-duplicate vectors and whitening against brute force."""

import math

import numpy as np
import pytest

from tidemark.llm import near_vectors, whitening


def test_centres_of_huge_sums_stay_exact():
    centre = whitening.Centre(3, np.array([3 * 10**15 + 1], dtype=object))
    import pandas as pd

    assert centre.rows(pd.Series([[10**15 + 2]]))[0, 0] == 2 - 1 / 3


SCHEMA = "vec_id long, embedding array<float>, node long, item long, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)


def brute_links(rows, cosine):
    """Per row: links, smallest id reached."""
    unit = {}
    for at, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            unit[at] = a / np.linalg.norm(a)
    links = {at: [b for b in unit if b != at and len(unit[b]) == len(unit[at]) and unit[at] @ unit[b] >= cosine] for at in unit}
    out = []
    for at, (i, _) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            for b in links.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links.get(at, [])), least, i is not None and least == i))
    return out


def clustered(rng, d, sizes, noise):
    rows = []
    for size in sizes:
        centre = rng.normal(size=d)
        rows += [(centre + noise * rng.normal(size=d)).tolist() for _ in range(size)]
    return rows


@pytest.mark.parametrize("noise", [0.12, 0.33])
def test_near_vectors(spark, noise):
    """Groups far inside the threshold's angle, and groups whose pairs lie on both sides of it, among strays and odd rows."""
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 12, [60, 25, 3, 2, 2], noise) + rng.normal(size=(150, 12)).tolist()
    vectors += [vectors[3]] * 5
    rows = list(enumerate(vectors))
    rows += [(2, vectors[100]), (900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [math.inf] * 12), (905, []), (906, [1.0] * 3), (907, [2.0] * 3), (None, vectors[0])]
    rows += [(908, [1e30] * 12), (909, [2e30] * 12), (910, [-0.0] * 11 + [1.0]), (911, [0.0] * 11 + [1.0])]
    got = sorted(tuple(r) for r in near_vectors.near_vectors(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").fillna(-1).collect())
    assert got == sorted((-1 if i is None else i, n, -1 if c is None else c, k) for i, n, c, k in brute_links(rows, 0.9))


def test_near_vectors_without_rows(spark):
    assert near_vectors.near_vectors(frame(spark, [])).count() == 0
    got = near_vectors.near_vectors(frame(spark, [(1, None), (None, None)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 0, None, False), (1, 0, 1, True)]


def test_full_lists_are_enlarged(spark, monkeypatch):
    """Forty vectors that are all linked, with no ball to hold them: lists of four grow until none is full."""
    monkeypatch.setattr(near_vectors, "K", 4)
    monkeypatch.setattr(near_vectors, "PASSES", 0)
    rng = np.random.default_rng(5)
    rows = list(enumerate(clustered(rng, 16, [40], 0.1) + rng.normal(size=(30, 16)).tolist()))
    got = sorted(tuple(r) for r in near_vectors.near_vectors(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == sorted(brute_links(rows, 0.9))


def test_audit_refuses_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "audited", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        near_vectors.near_vectors(frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01])]))


def test_whitening(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    good = np.c_[base, base[:, 0], np.ones(300)].astype(np.float32)
    rows = [(i if i != 7 else None, v.tolist()) for i, v in enumerate(good)] + [(5, good[5].tolist()), (2**62 + 1, good[9].tolist())]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows])
    odd = [(800, None), (801, [math.nan] * 8), (802, [None] * 8), (803, [1.0] * 3)]
    n, sums = len(x), x.sum(axis=0)
    a = (n * x - sums) / n
    e, turn = np.linalg.eigh(a.T @ a / n)
    e, turn = e[::-1], turn[:, ::-1]
    k = int((e > 1e-9 * e[0]).sum())
    assert k == 6
    want = a @ turn[:, :k] / np.sqrt(e[:k])
    got = whitening.whitened(frame(spark, rows + odd)).toPandas()
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert got.groupby("component").explained.first().tolist() == pytest.approx((e[:k] / e.sum()).tolist(), rel=1e-9)
    deviation = {(int(i) if i is not None else None): int(((n * v - sums) ** 2).sum()) for (i, _), v in zip(rows, x, strict=True)}
    ids = {r.vec_id: int(r.deviation) for r in whitening.whitened(frame(spark, rows)).select("vec_id", "deviation").distinct().collect()}
    assert ids == deviation
    for c in range(1, k + 1):
        own = got[got.component == c]
        mine, theirs = np.sort(own.whitened.to_numpy()), np.sort(want[:, c - 1])
        assert min(np.abs(mine - theirs).max(), np.abs(mine - np.sort(-theirs)).max()) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whitened(frame(spark, rows)).count() == 0
