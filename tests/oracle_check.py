"""Compare registered queries with their SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    cleaned = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(map(str, row)) for row in cleaned.itertuples(index=False)))


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    a, b = _rows(actual), _rows(expected)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; only left {sorted(set(a) - set(b))[:2]}, only right {sorted(set(b) - set(a))[:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, bad = make_session(), open_tables(sf_dir), 0
    for name in names:
        try:
            t = time.time()
            actual = queries()[name](spark, sf_dir).toPandas()
            took = time.time() - t
            sql = oracle_sql().get(name)
            problem = "no SQL" if sql is None else difference(actual, con.execute(sql).df())
        except Exception as e:  # report and go on with the next query
            problem, took = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        print(f"{name:28s} {took:6.2f}s {problem or f'equal ({len(actual)} rows)'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
