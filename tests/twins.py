"""Run a registered query and its SQL twin and compare them value by value."""

from __future__ import annotations

import math
import os
import glob

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if hasattr(value, "isoformat"):
        return str(value)[:26]
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(cell(r[i]) for i in order) for r in rows]


def compare(spark, con, sf_dir, build, sql):
    """(spark rows, sql rows, sample of differences)."""
    df = build(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return len(mine), -1, [("columns", sorted(df.columns), sorted(names))]
    theirs = rows_of(names, cursor.fetchall())
    from collections import Counter

    a, b = Counter(map(repr, mine)), Counter(map(repr, theirs))
    return len(mine), len(theirs), [("spark", x) for x in list((a - b))[:3]] + [("sql", x) for x in list((b - a))[:3]]
