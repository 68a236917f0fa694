"""Run a query on Spark and its SQL on DuckDB and compare all rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value) if value is not None else None


def _rows(rows, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs in names, types or rows; empty when nothing does."""
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    expected = con.execute(sql).fetchall()
    spark_types = {n: DUCK_TYPES.get(t, t) for n, t in df.dtypes}
    found = []
    if spark_types != types:
        spark_only, sql_only = spark_types.items() - types.items(), types.items() - spark_types.items()
        found.append(f"types: spark {sorted(spark_only)} sql {sorted(sql_only)}")
    got, want = _rows(df.collect(), df.columns), _rows(expected, list(types))
    if got != want:
        extra, lacking = list((got - want).items())[:2], list((want - got).items())[:2]
        found.append(f"rows: {sum(got.values())} and {sum(want.values())}; only spark {extra}; only sql {lacking}")
    if not want:
        found.append("no rows")
    return found
