"""Whitening of integer vectors by shifted CholeskyQR (Fukaya et al., 2020).

The centred rows are never decomposed whole. Each pass takes them through the triangular factors found so far, sums the
Gram matrix of the outcome over all tasks and factors it by Cholesky; the first pass adds a shift to the diagonal, so that
a Gram matrix of poor condition has a factor too. The product R of all factors has the singular values of the centred rows,
and R's right singular vectors are the components. Only sums of the size of a Gram matrix reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components returned, and the passes after which the rows must be orthogonal.
COMPONENTS, PASSES = 32, 12
#: Largest departure of a Gram matrix from the identity at which the passes end.
ORTHOGONAL = 1e-9
#: Directions whose singular value is below this share of the largest carry no variance.
RANK = 1e-10


def scaled_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<long>): floor(factor * component as double) + offset; null vectors and those with null or non-finite parts go."""
    v = F.col(f"`{vec_col}`")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = F.transform(v, lambda e: F.floor(e.cast("double") * factor) + F.lit(offset).cast("long"))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))


def common_length(rows: DataFrame) -> int:
    """The length that most vectors have, the larger of two with as many; 0 without rows."""
    first = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def column_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each dimension."""
    first = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d))).first()
    return first[0], np.array([int(v) for v in first[1:]], dtype=object)


@dataclass(frozen=True)
class Centre:
    """n rows with sums S: x - S/n of each row, from the integers n * x - S."""

    n: int
    sums: np.ndarray

    def rows(self, x: pd.Series) -> np.ndarray:
        whole = self.sums // self.n
        low = np.stack(x.to_numpy()).astype(np.int64) - whole.astype(np.int64)
        return low.astype(float) - ((self.sums - whole * self.n) / self.n).astype(float)


def gram(rows: DataFrame, centre: Centre, through: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all rows of the outer products of what `through` makes of them: one matrix a task, added up by entry."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                q = through(centre.rows(pdf["x"]))
                total += q.T @ q
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"entry": (i * d + j).astype("int64"), "value": total[i, j]})

    found = rows.select("x").mapInPandas(partial, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(d * d)
    out[[r.entry for r in found]] = [r.value for r in found]
    out = out.reshape(d, d)
    return np.triu(out) + np.triu(out, 1).T


def _upper_inverse(r: np.ndarray) -> np.ndarray:
    """Inverse of an upper triangular matrix by back substitution."""
    d = len(r)
    out = np.zeros_like(r)
    for i in range(d - 1, -1, -1):
        out[i] = (np.eye(d)[i] - r[i, i + 1 :] @ out[i + 1 :]) / r[i, i]
    return out


def _solved(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows through the triangular solves of all factors, one after another."""
    inverses = [_upper_inverse(r) for r in factors]

    def through(a: np.ndarray) -> np.ndarray:
        for inv in inverses:
            a = a @ inv
        return a

    return through


def _shift(g: np.ndarray, n: int) -> float:
    d = len(g)
    return 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(g, 2))


def _factored(g: np.ndarray, n: int) -> np.ndarray:
    """Upper R with R'R = g, shifted further where rounding has left g without a factor."""
    shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, _shift(g, n))


def triangular_factor(rows: DataFrame, centre: Centre, g: np.ndarray) -> np.ndarray:
    """R with R'R the Gram matrix of the centred rows, of which g is a first sum.

    What the last pass leaves of the identity is taken into R, so a direction without variance ends as a singular value
    next to zero, whatever the shifts put there.
    """
    d = len(g)
    r, factors = np.eye(d), []
    for k in range(PASSES):
        step = _factored(g + (_shift(g, centre.n) if k == 0 else 0.0) * np.eye(d), centre.n)
        r = step @ r
        factors.append(step)
        g = gram(rows, centre, _solved(factors), d)
        if np.abs(g - np.eye(d)).max() < ORTHOGONAL:
            break
    left, turn = np.linalg.eigh(g)
    return np.sqrt(np.maximum(left, 0.0))[:, None] * (turn.T @ r)


@dataclass(frozen=True)
class Whitening:
    """Components by falling variance: columns of `directions`, their variances, and the share of all variance."""

    centre: Centre
    directions: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def scores(self, x: pd.Series) -> np.ndarray:
        return self.centre.rows(x) @ (self.directions / np.sqrt(self.variances))


def fitted(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Components of all rows (x array<long> of length d). Those without variance are left out, so there may be fewer or none."""
    n, sums = column_sums(rows, d)
    centre = Centre(n, sums)
    moved = gram(rows, centre, lambda a: a, d)
    vary = np.flatnonzero(np.diag(moved) > 0)
    if not len(vary):
        return Whitening(centre, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    varying = rows.select(F.transform(F.array(*(F.lit(int(i)) for i in vary)), lambda i: F.get("x", i)).alias("x"))
    _, sigma, vt = np.linalg.svd(triangular_factor(varying, Centre(n, sums[vary]), moved[np.ix_(vary, vary)]))
    keep = np.flatnonzero(sigma > RANK * sigma[0])[:components]
    directions = np.zeros((d, len(keep)))
    directions[vary] = vt[keep].T
    e = sigma**2 / n
    return Whitening(centre, directions, e[keep], e[keep] / e.sum())


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity; one more pass over all rows."""
    k = len(model.variances)
    if not k:
        return 0.0
    inverse = model.directions / np.sqrt(model.variances)
    g = gram(rows, model.centre, lambda a: a @ inverse, k) / model.centre.n
    return float(np.abs(g - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, factor: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error): a row for each vector and component.

    Null vectors and those with null or non-finite parts go; repeated rows and rows without an id stay and count. Vectors
    of another length than most have (ties: the longer) take no part. Directions without variance give no component: one
    row, equal rows, vectors without parts and an empty table give an empty result. Columns besides the two are left behind.
    """
    spark = vectors.sparkSession
    rows = scaled_vectors(vectors, id_col, vec_col, factor, offset)
    d = common_length(rows)
    fields = [("vec_id", T.LongType()), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(a, t) for a, t in fields])
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    model = fitted(rows, d, components)
    if not len(model.variances):
        return spark.createDataFrame([], schema)
    n, sums, error = model.centre.n, model.centre.sums, identity_error(rows, model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": pdf["deviation"], "scores": list(model.scores(pdf["x"]))})

    wide = T.DecimalType(38, 0)
    gaps = F.zip_with("x", F.array(*(F.lit(str(s)).cast(wide) for s in sums)), lambda x, s: F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") - s)
    squares = F.aggregate(gaps, F.lit(0).cast(wide), lambda acc, g: (acc + g.cast("decimal(19,0)") * g.cast("decimal(19,0)")).cast(wide))
    # Ids go through pandas as text: long with a null among them would become double.
    out = rows.select(F.col("vec_id").cast("string"), "x", squares.alias("deviation")).mapInPandas(scored, "vec_id string, deviation decimal(38,0), scores array<double>")
    out = out.select(F.col("vec_id").cast("long"), "deviation", F.posexplode("scores").alias("at", "whitened"))
    shares = F.array(*(F.lit(float(s)) for s in model.shares))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
