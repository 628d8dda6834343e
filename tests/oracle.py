"""Rows of a query and of its SQL in DuckDB, made comparable."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(p):
            p = f"{p}/*.parquet"
        if glob.glob(p):
            c.execute(f"create view {t} as select * from '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)
