"""Rows of a query against rows of its SQL in DuckDB, without regard to order."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if v is None or isinstance(v, bool | int | str) else str(v)


def same_rows(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    theirs = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=key)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    assert ours == theirs
