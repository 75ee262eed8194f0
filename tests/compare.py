"""A query's rows against its SQL's."""

import glob
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def assert_same(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    q = connection(sf_dir).execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in q.fetchall())
    assert got == want
