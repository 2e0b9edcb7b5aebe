"""Runs a query in Spark and its oracle in DuckDB and compares them as multisets."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a description of the first differences."""
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = _rows(want_columns, cursor.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(want_columns) != sorted(spark_df.columns):
        return f"columns: spark {sorted(spark_df.columns)}, oracle {sorted(want_columns)}"
    if want == got:
        kinds = {type(v) for row in got for v in row}, {type(v) for row in want for v in row}
        if kinds[0] != kinds[1]:
            return f"types: spark {kinds[0]}, oracle {kinds[1]}"
        return None
    extra, absent = list((got - want).items())[:4], list((want - got).items())[:4]
    return (
        f"columns {sorted(want_columns)}; rows: spark {sum(got.values())}, oracle "
        f"{sum(want.values())}\n  only spark: {extra}\n  only oracle: {absent}"
    )
