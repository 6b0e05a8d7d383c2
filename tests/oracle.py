"""Runs a query in Spark and its SQL in DuckDB and holds the rows against each other."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal, int)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    return x.isoformat() if isinstance(x, (datetime.datetime, datetime.date)) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), x) for x in r])


def compare(df, con, sql):
    """What differs; nothing if the rows are the same."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    kinds = {n: str(t) for n, t in zip([c[0] for c in cur.description], [c[1] for c in cur.description])}
    mine = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    odd = {n: (mine[n], kinds[n]) for n in mine if mine[n] in same and same[mine[n]] != kinds[n]}
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows; types {odd}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return f"{len(diff)} of {len(got[1])} rows differ, as {diff[0]}; types {odd}"
    return f"types {odd}" if odd else ""
