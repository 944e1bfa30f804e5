"""Run registered queries next to their SQL: ``python -m tests.compare [sf_dir] [key ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TESTDATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def without_masks(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers with nulls as floats, whichever way a reader returned them."""
    masked = [c for c in frame.columns if pd.api.types.is_extension_array_dtype(frame[c].dtype) and frame[c].dtype.kind in "iu" and frame[c].isna().any()]
    return frame.astype({c: "float64" for c in masked})


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if column.dtype == object:
            frame[name] = column.map(lambda v: None if v is None or v is pd.NA else str(list(v) if isinstance(v, np.ndarray) else v))
    return frame.sort_values(list(frame.columns), ignore_index=True, na_position="first") if len(frame.columns) else frame


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    left, right = canonical(without_masks(spark_frame)), canonical(without_masks(sql_frame))
    kinds = [(c, str(left[c].dtype), str(right[c].dtype)) for c in left.columns if left[c].dtype.kind != right[c].dtype.kind]
    if kinds and len(left):
        return f"types {kinds}"
    for name in left.columns:
        a, b = left[name], right[name]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = int(np.argmin(same.to_numpy()))
            return f"{name}[{at}]: {left.iloc[at].to_dict()} vs {right.iloc[at].to_dict()}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from weftline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else f"{TESTDATA}/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for key in sys.argv[2:] or queries:
        t0 = time.time()
        try:
            ours = queries[key](spark, sf_dir).toPandas()
            t1 = time.time()
            if key not in sql:
                print(f"ROWS {key} {len(ours)} {t1 - t0:.1f}s", flush=True)
                continue
            theirs = con.execute(sql[key]).df()
            problem = differences(ours, theirs)
            print(f"{'OK  ' if problem is None else 'DIFF'} {key} rows={len(ours)} {t1 - t0:.1f}s sql={time.time() - t1:.1f}s {problem or ''}", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {key} {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
