"""Compares a query with its SQL in DuckDB on the smallest test tables."""

from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def compare(spark, query, sql):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = query(spark, str(DATA)), db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    order = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=order)
    assert got == sorted((tuple(plain(r[want.columns.index(n)]) for n in names) for r in want.fetchall()), key=order)
