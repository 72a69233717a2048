"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return v


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows; else a few that differ."""
    df = query(spark, sf_dir)
    names, theirs = duck(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in theirs)
    if mine == want:
        return ""
    more, less = mine - want, want - mine
    return f"{sum(mine.values())} and {sum(want.values())} rows; only Spark {sum(more.values())}: {list(more)[:3]}; only DuckDB {sum(less.values())}: {list(less)[:3]}"
