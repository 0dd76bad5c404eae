"""Compares a query with its SQL: rows as multisets, columns by name."""

import duckdb


def connect(sf_dir, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(cursor):
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(str(r[i]) for i in order) for r in cursor.fetchall()))


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    columns, want = rows_of(con.execute(sql))
    assert names == columns
    assert got == want
    return got
