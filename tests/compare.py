"""Run registered queries against their SQL: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sessionrec.sources.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both frames hold the same rows, exactly."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = normal(got), normal(want)
    for column in got.columns:
        if got[column].dtype != want[column].dtype:
            return f"type of {column}: {got[column].dtype} != {want[column].dtype}"
        same = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        if not same.all():
            at = same[~same].index[0]
            return (
                f"{(~same).sum()} values of {column}, first {got[column][at]} != "
                f"{want[column][at]}\n{got.loc[at].to_dict()}\n{want.loc[at].to_dict()}"
            )
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(sf_dir)
    registered, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(registered)
    failed = []
    for name in names:
        start = time.time()
        try:
            got = registered[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = None
            if name in sql:
                start = time.time()
                problem = differences(got, con.execute(sql[name]).df())
                took_sql = time.time() - start
            state = "same" if name in sql and not problem else ("rows" if not problem else "DIFF")
            print(f"{state} {name} rows={len(got)} spark={took:.1f}s sql={took_sql if name in sql else 0:.1f}s", flush=True)
        except Exception as error:  # report and go on
            problem = str(error)[:1500]
            print(f"FAIL {name}", flush=True)
        if problem:
            print("   ", problem, flush=True)
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")


if __name__ == "__main__":
    main()
