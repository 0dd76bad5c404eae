"""Compares a query with its SQL: rows as multisets, columns by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    return f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x)


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert names == sorted(columns)
    order = [columns.index(c) for c in names]
    want = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    assert got == want
    return len(got)
