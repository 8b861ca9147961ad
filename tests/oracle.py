"""Comparing a registered query with its SQL, as sets of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def same(df, sql: str, sf_dir: str) -> None:
    rows, names = df.collect(), sorted(df.columns)
    con = connect(sf_dir)
    result = con.execute(sql)
    at = {d[0]: k for k, d in enumerate(result.description)}
    assert sorted(at) == names
    ours = sorted(tuple(plain(r[n]) for n in names) for r in rows)
    theirs = sorted(tuple(plain(r[at[n]]) for n in names) for r in result.fetchall())
    assert ours == theirs
