"""Run registered queries and compare them with their SQL twins in DuckDB.

``python -m foldstone.workload.check [folder] [name ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "array<double>": "DOUBLE[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows) -> list[tuple]:
    return sorted((tuple(_plain(v) for v in r) for r in rows),
                  key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    mine = _sorted(df.select(*[df[n] for n in names]).collect())
    con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in con.description}
    rows = con.fetchall()
    if sorted(kinds) != names:
        return f"columns {names} against {sorted(kinds)}"
    at = [list(kinds).index(n) for n in names]
    theirs = _sorted([[r[i] for i in at] for r in rows])
    types = dict(df.dtypes)
    for n in names:
        wanted = {"NUMBER": None, "STRING": None}.get(kinds[n], kinds[n])
        if wanted and SAME_TYPE.get(types[n], types[n]) != wanted:
            return f"type of {n}: {types[n]} against {kinds[n]}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} rows differ in {names}, first {bad[0]}" if bad else None


def main(folder: str, only: list[str]) -> int:
    from foldstone.session import get_session
    from foldstone.workload import ORACLES, QUERIES

    spark = get_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    con, failed = connect(folder), 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in ORACLES:
                df = fn(spark, folder)
                problem = compare(df, con, ORACLES[name])
                state = "equal" if problem is None else f"DIFFERS {problem}"
            else:
                state, problem = f"{len(fn(spark, folder).collect())} rows", None
        except Exception as error:  # report and go on with the other queries
            state = problem = f"FAILED {type(error).__name__} {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {state}", flush=True)
        spark.catalog.clearCache()
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001",
                       sys.argv[2:])))
