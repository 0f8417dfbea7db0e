"""Walk-forward scores over the shared tables. Trees are no SQL: tests compare folds, seals and ranks with hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import modeling as M
from tidemark.plans.features import CELLS, observed_cells
from tidemark.sources import tables as T

FEATURES = ["ret_5", "ret_21", "mom_63_21", "vol20", "range20", "dvol60", "on20", "id20"]


def _rows(spark, sf_dir):
    named = {n: c for n, c in (X.momentum_features() | X.volatility_features() | X.session_features()).items() if n in FEATURES}
    return X.select_features(X.unit_open(observed_cells(spark, sf_dir), T.sessions(spark, sf_dir)), named | X.labels((5, 21)))


def walk_forward(spark, sf_dir):
    """Scores of two years by models of the years before each; the last year and a half is sealed."""
    return M.walk_forward_scores(_rows(spark, sf_dir), T.sessions(spark, sf_dir), FEATURES, {5: "y5", 21: "y21"}, [1998, 1999], last=1950, least_rows=500, trees=5, depth=3)


def ranked_design(spark, sf_dir):
    rows = X.select_features(observed_cells(spark, sf_dir), {"ret_1d": F.col("rcc"), "ron": F.col("ron"), "rid": F.col("rid")})
    got = M.ranked_design(M.sealed(rows, 1500), ["ret_1d", "ron", "rid"], 8)
    return got.select("instrument_id", "pos", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("ret_1d", "ron", "rid")))


QUERIES = {f.__name__: f for f in (walk_forward, ranked_design)}


def _rank(c: str) -> str:
    place = f"(row_number() OVER (PARTITION BY pos, {c} IS NULL ORDER BY {c}, instrument_id) - 0.5::DOUBLE) / count({c}) OVER (PARTITION BY pos)"
    return f"floor(CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY pos) >= 8 THEN {place} ELSE -1 END * 1e6 + 0.5) / 1e6"


SQL = {
    "ranked_design": f"""WITH {CELLS}, f AS (SELECT instrument_id, pos, rcc AS ret_1d, ron, rid FROM c WHERE present AND pos <= 1500)
SELECT instrument_id, pos, {", ".join(f"{_rank(c)} AS {c}" for c in ("ret_1d", "ron", "rid"))} FROM f""",
}
DATES: dict[str, tuple[str, ...]] = {}
