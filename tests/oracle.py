"""Compares queries with their SQL in DuckDB, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, db, sf_dir, query, sql) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = db.execute(sql)
    want_names, want = rows([c[0] for c in rel.description], rel.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
