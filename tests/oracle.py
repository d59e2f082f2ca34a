"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    return con


def plain(value) -> str:
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    wanted = rows_of(relation.columns, relation.fetchall())
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    assert found[1] == wanted[1]
