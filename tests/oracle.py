"""Compare a Spark query with its SQL on the same Parquet files."""

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    """(row count, list of differences)."""
    df = fn(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    n = sum(ours[1].values())
    if ours[0] != theirs[0]:
        return n, [f"columns {ours[0]} != {theirs[0]}"]
    extra, missing = ours[1] - theirs[1], theirs[1] - ours[1]
    diff = [f"spark only ({sum(extra.values())}): {list(extra)[:3]}"] if extra else []
    if missing:
        diff.append(f"sql only ({sum(missing.values())}): {list(missing)[:3]}")
    return n, diff
