"""Compare a Spark result with the DuckDB result of the oracle SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return json.dumps([norm(x) for x in v])
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(row[i]) for i in order) for row in rows), key=lambda t: tuple((x is None, str(type(x)), x) if x is not None else (True, "", "") for x in t))


def kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def check(df, sql, con):
    """List of differences; empty when equal.  Returns (problems, row count)."""
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} vs {sorted(want_cols)}"], len(got)
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    names = sorted(got_cols)
    for a, b in zip(got, want):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(names, a, b) if x != y or kind(x) != kind(y)]
            problems.append(f"row {a[:4]}: {diff}")
            if len(problems) > 3:
                break
    return problems, len(got)
