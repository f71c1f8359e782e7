"""Comparison of a query's rows with its SQL on DuckDB."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{float(x) + 0.0:.6g}"
    return str(x)


def rows(columns, data):
    return sorted(tuple(_plain(r[c]) for c in columns) for r in data)


def assert_same(df, con, sql):
    got = [r.asDict() for r in df.collect()]
    ref = con.sql(sql)
    names = [d[0] for d in ref.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in ref.fetchall()]
    a, b = rows(sorted(names), got), rows(sorted(names), want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
