"""Compares a query's rows with those of its SQL in DuckDB."""
from __future__ import annotations

import math
import os
from functools import lru_cache

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@lru_cache(maxsize=2)
def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "__float__") and not isinstance(x, int | bool):
        return float(f"{float(x):.9g}")
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
        return f"{name}: {len(got[1])} and {len(want[1])} rows; only here {a}; only in SQL {b}"
    return ""
