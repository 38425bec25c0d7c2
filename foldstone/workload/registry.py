"""Registration of queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; ``sql`` is its twin, absent where SQL cannot say it."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the order in which an engine adds them up does not show.

    Half away from zero on the scaled double, as DuckDB rounds; stays in generated code, which
    ``F.round`` on doubles does not.
    """
    scale = float(10**digits)

    def near(x):
        return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale

    return df.select(*[
        near(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
