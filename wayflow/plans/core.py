"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name.

    ``doubles``: columns rounded to 6 places on both sides, as sums of floats depend on order; a billionth moves exact halves off the edge.
    """

    def put(f: Query) -> Query:
        key, rounded = name or f.__name__, doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) + F.lit(0.0) for c in rounded}) if rounded else df

        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql if not rounded else wrap(sql, rounded)
        return f

    return put


def wrap(sql: str, rounded: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 6) + 0.0 AS {c}' for c in rounded)}) FROM ({sql})"
