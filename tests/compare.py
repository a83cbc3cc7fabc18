"""Spark's rows against DuckDB's."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{round(v, 5) + 0.0:.8g}"
    return str(v)


def assert_same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a = sorted(tuple(_plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    b = sorted(tuple(_plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in want.fetchall())
    assert a == b
