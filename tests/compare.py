"""Comparison of a query with its SQL, as rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9) + 0.0
    return [_plain(y) for y in x] if isinstance(x, list) else x


def rows(names, columns, found):
    return sorted(repr([_plain(r[columns.index(n)]) for n in names]) for r in found)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    there = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(there.columns)
    assert rows(names, df.columns, df.collect()) == rows(names, there.columns, there.fetchall())
