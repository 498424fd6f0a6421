"""Compare a query with its SQL run by DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(plain(x) for x in r) for r in df.select(*cols).collect()], key=repr)


def rows_of_sql(folder, sql):
    r = connection(folder).sql(sql)
    cols = list(r.columns)
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted([tuple(plain(x[i]) for i in at) for x in r.fetchall()], key=repr)
