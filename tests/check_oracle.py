"""Run registered queries against their checking SQL: python tests/check_oracle.py [folder] [name …]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            df[c] = s.map(lambda v: "NULL" if pd.isna(v) else str(int(v)) if float(v).is_integer() else repr(float(v)))
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.map(lambda v: "NULL" if pd.isna(v) else str(pd.Timestamp(v).tz_localize(None) if pd.Timestamp(v).tzinfo else v))
        else:
            df[c] = s.map(lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when both hold the same rows under the same column names."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = canonical(left), canonical(right)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        cols = [c for c in a.columns if a.loc[i, c] != b.loc[i, c]]
        return f"{int(bad.sum())} rows differ, first in {[(c, a.loc[i, c][:80], b.loc[i, c][:80]) for c in cols]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from redline.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    sql, failed = oracle_sql(), []
    for name, fn in queries().items():
        if args and name not in args:
            continue
        started = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - started
            if name not in sql:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            started = time.time()
            want = con.execute(sql[name]).df()
            problem = difference(got, want)
            types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if c in want.columns and str(got[c].dtype)[:5] != str(want[c].dtype)[:5]]
            print(f"{'FAIL ' if problem else 'ok   '} {name} {len(got)} {took:.1f}s sql {time.time() - started:.1f}s {problem or ''} {types or ''}", flush=True)
            if problem:
                failed.append(name)
        except Exception as error:
            failed.append(name)
            print(f"ERROR {name} {str(error)[:600]}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
