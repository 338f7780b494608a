"""Compare a query's rows with its DuckDB statement, as the driver does."""

import datetime
import os

import duckdb


def norm(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        name = f.split(".parquet")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{f}'")
    return con


def both(spark, sf, query, sql, con=None):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = (con or connect(sf)).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    return got, want
