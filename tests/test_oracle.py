"""Every market query that SQL can express gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans import market


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(None if isinstance(v[i], float) and math.isnan(v[i]) else float(v[i]) if isinstance(v[i], int | float) and not isinstance(v[i], bool) else v[i] for i in order) for v in values]
    return [names[i] for i in order], sorted(plain, key=str)


@pytest.mark.parametrize("name", sorted(market.SQL))
def test_query_equals_sql(spark, db, name):
    df = market.QUERIES[name](spark, SF)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(market.SQL[name])
    want_names, want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got_names == want_names
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (a, b)
