"""Spark result against DuckDB oracle on the same tables: columns, rows and values."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=8")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _normal(value):
    if isinstance(value, float) and value == int(value):
        return repr(int(value))
    return repr(value)


def normal_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_normal(r[i]) for i in order) for r in rows)


def oracle_rows(con, sql: str):
    result = con.execute(sql)
    return normal_rows([d[0] for d in result.description], result.fetchall())


def spark_rows(df):
    return normal_rows(df.columns, [tuple(r) for r in df.collect()])


def difference(df, con, sql: str) -> str | None:
    """None when equal, otherwise a short text."""
    got_columns, got = spark_rows(df)
    want_columns, want = oracle_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} vs {len(want)}; extra {sorted(extra)[:3]}; missing {sorted(missing)[:3]}"
    return None
