"""Compares a query's rows with those of its SQL in DuckDB."""
import datetime
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for file in os.listdir(sf_dir):
        if file.endswith(".parquet"):
            c.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    try:
        return None if math.isnan(x) else float(f"{float(x):.9g}") + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def same(df, sql: str, sf_dir: str) -> None:
    got = connection(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())
