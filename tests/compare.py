"""Run one registered query in Spark and its SQL in DuckDB and compare the bags."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((value is not None, str(value)) for value in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)


def sql_rows(con, sql):
    result = con.execute(sql)
    found = [c[0] for c in result.description]
    names = sorted(found)
    order = [found.index(n) for n in names]
    rows = [tuple(r[i] for i in order) for r in result.fetchall()]
    return names, sorted(rows, key=_key), {c[0]: str(c[1]) for c in result.description}


EXPECTED = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def difference(df, con, sql) -> str | None:
    """None if both agree on columns, types and every value."""
    names, left = spark_rows(df)
    other, right, kinds = sql_rows(con, sql)
    if names != other:
        return f"columns {names} != {other}"
    wrong = {n: (t, kinds[n]) for n, t in df.dtypes if EXPECTED.get(t) != kinds[n]}
    if wrong:
        return f"types {wrong}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for mine, theirs in zip(left, right):
        if mine != theirs:
            return f"{names}: {mine} != {theirs}"
    return None
