"""Runs queries and their SQL side by side on one test data folder."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by content, dates and moments as text."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if frame[name].dtype.kind == "M":
            frame[name] = frame[name].astype("datetime64[us]")
        elif frame[name].dtype.kind == "O":
            missing = frame[name].isna()
            frame[name] = frame[name].map(lambda v: str(v).replace(" 00:00:00", ""))
            frame.loc[missing, name] = None
    return frame.sort_values(list(frame.columns), na_position="last", kind="stable").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None if equal, else what differs first."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = canonical(left), canonical(right)
    for name in a.columns:
        x, y = a[name], b[name]
        unequal = ~((x == y) | (x.isna() & y.isna()))
        if unequal.any():
            at = unequal.idxmax()
            return f"{name}: {int(unequal.sum())} values, first {x[at]!r} != {y[at]!r} in {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return None


def main(folder: str, names: list[str]) -> int:
    from stagecast.session import local_session
    from verification import oracle, queries

    spark, con = local_session(8), connect(folder)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    runs, sqls = queries.registry(), oracle.registry()
    failed = 0
    for name in names or list(runs):
        start = time.time()
        try:
            left = runs[name](spark, folder).toPandas()
            middle = time.time()
            if name not in sqls:
                print(f"{name}: {len(left)} rows, no SQL")
                continue
            right = con.execute(sqls[name]).fetchdf()
            found = difference(left, right)
        except Exception as error:  # report and go on with the next query
            found, middle = f"{type(error).__name__}: {str(error)[:600]}", time.time()
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} spark {middle - start:.1f}s sql {time.time() - middle:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
