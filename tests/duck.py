"""Compares queries with DuckDB's answer to their SQL on the same tables."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def plain(x):
    """A value that sorts beside others: numbers to nine digits, as sums vary in order."""
    if x is None:
        return (0, "")
    if isinstance(x, (list, tuple)):
        return (1, str([plain(y) for y in x]))
    if isinstance(x, (float, int)) and not isinstance(x, bool) or hasattr(x, "quantize"):
        return (1, "nan" if math.isnan(x) else f"{float(x):.9g}")
    return (1, str(x))


def same_rows(spark, db, query, sql, sf_dir=SF):
    df, want = query(spark, sf_dir), db.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[k]) for k in places) for r in want.fetchall())
