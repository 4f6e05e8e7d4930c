"""Compares a registered query with its SQL, ignoring row and column order."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    types = {d[0]: str(d[1]) for d in found.description}
    theirs = rows_of(columns, found.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            return f"{a} != {b} ({types})"
    return None
