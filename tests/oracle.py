"""Runs a query's SQL twin in DuckDB and compares rows without regard to order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.8g}" if abs(float(v)) < 1e15 else str(v)
    return str(v)


def same(df, con, sql):
    names = sorted(df.columns)
    mine = sorted(tuple(map(str, map(cell, r))) for r in df.select(*names).collect())
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(d[0] for d in con.description) == names
    theirs = sorted(tuple(map(str, map(cell, r))) for r in theirs)
    assert len(mine) == len(theirs)
    assert mine == theirs
