"""Runs queries on Spark and their SQL on DuckDB over the same files, and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    own = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return own


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "item"):
        return cell(v.item())
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, query, sql) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connection(sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; only here {[r for r in mine if r not in set(theirs)][:2]}; only there {[r for r in theirs if r not in set(mine)][:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, such as {bad[:2]}" if bad else None
