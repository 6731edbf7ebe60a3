"""Compares registered queries with their SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    return f"{len(bad)} of {len(got)} rows, such as {bad[:2]}" if bad else f"types {odd}" if odd else None
