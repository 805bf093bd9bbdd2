"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(t) -> str:
    return str(t).replace("large_", "")


def _sorted_columns(table: str, schema) -> str:
    return f"SELECT {', '.join(f'"{n}"' for n in sorted(schema.names))} FROM {table}"


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs first."""
    a, b = df.toArrow(), con.sql(sql).to_arrow_table()
    ca, cb = sorted(a.column_names), sorted(b.column_names)
    if ca != cb:
        return f"columns {ca} != {cb}"
    types = [
        (c, _plain(a.schema.field(c).type), _plain(b.schema.field(c).type))
        for c in ca
        if _plain(a.schema.field(c).type) != _plain(b.schema.field(c).type)
    ]
    if types:
        return f"types {types}"
    if a.num_rows != b.num_rows:
        return f"rows {a.num_rows} != {b.num_rows}"
    con.register("spark_rows", a)
    con.register("sql_rows", b)
    x, y = _sorted_columns("spark_rows", a.schema), _sorted_columns("sql_rows", b.schema)
    diff = con.sql(f"({x}) EXCEPT ALL ({y})").limit(2).fetchall()
    if diff:
        other = con.sql(f"({y}) EXCEPT ALL ({x})").limit(2).fetchall()
        return f"{ca}: {diff} != {other}"
    return None if a.num_rows else "both empty"
