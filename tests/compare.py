"""Run queries beside their SQL oracles, as the acceptance check does."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """(matches, rows, seconds, difference) of one query."""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, len(got), seconds, f"columns {df.columns} against {names}"
    left, right = _rows(df.columns, got), _rows(names, expected)
    if left == right:
        return True, len(got), seconds, ""
    extra = [r for r in left if r not in set(right)][:3]
    missing = [r for r in right if r not in set(left)][:3]
    return False, len(got), seconds, f"{len(left)} rows against {len(right)}; extra {extra}; missing {missing}"
