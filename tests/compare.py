"""Spark rows against DuckDB rows: names, counts and values, in any order."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if hasattr(x, "as_tuple"):
        return round(float(x), 5)
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """None, or what differs."""
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = canonical([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    for g, w in zip(got[1], want[1], strict=True):
        if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)) for a, b in zip(g, w, strict=True)):
            return f"{g} and {w}"
    return None
