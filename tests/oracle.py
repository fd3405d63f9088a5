"""Comparison of a Spark result with SQL in DuckDB over the same tables."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, bool)) else str(v)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


def differ(df, sql, con):
    """None if rows and column names are the same, else an example."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs, ours = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, SQL {sorted(names)}"
    if ours != theirs:
        return f"{len(ours)} rows, SQL {len(theirs)}: {[(a, b) for a, b in zip(ours, theirs) if a != b][:2]}"
    return None
