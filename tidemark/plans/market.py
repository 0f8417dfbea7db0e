"""All queries of the market library. Dates and instants are given as text, so that any engine shows them alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import actions, audit, catalog, evaluation, evidence, features, levels, modeling, notices, panel, pit, reports, research, silver, streams, trading

MODULES = (panel, catalog, audit, silver, features, levels, evaluation, research, pit, actions, notices, evidence, modeling, reports, trading, streams)

Query = Callable[[SparkSession, str], DataFrame]


def _as_text(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        shown = {c: F.date_format(c, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd HH:mm:ss") for c, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz")}
        return df.withColumns(shown) if shown else df

    return run


def _sql_as_text(sql: str, dates: tuple[str, ...], instants: tuple[str, ...]) -> str:
    if not dates and not instants:
        return sql
    shown = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in instants]
    return f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql})"


QUERIES: dict[str, Query] = {name: _as_text(query) for m in MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {
    name: _sql_as_text(sql, m.DATES.get(name, ()), getattr(m, "INSTANTS", {}).get(name, ())) for m in MODULES for name, sql in m.SQL.items()
}
