"""Comparison of a query with its SQL on one of the test folders."""

import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return str(v)


def connection(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    columns = sorted(names)
    return columns, sorted(tuple(normal(x[names.index(c)]) for c in columns) for x in r.fetchall())
