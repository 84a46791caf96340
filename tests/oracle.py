"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5g}" if abs(x) < 1e-4 else f"{x:.6g}"
    if x is None or isinstance(x, (bool, str)):
        return repr(x)
    if isinstance(x, int) or type(x).__name__ == "Decimal":
        return str(int(x)) if x == int(x) else f"{float(x):.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_cell, x)) + "]"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def difference(spark, con, sf, query, sql):
    """None if query and SQL agree, else what differs."""
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[:2]}" if bad else None
