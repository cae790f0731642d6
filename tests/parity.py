"""Comparison of a query with its DuckDB SQL: schema family, row count and values in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> None:
    mine = rows_of(df.columns, df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not different, (len(different), different[:2])
    kinds = {d[0]: str(d[1]).upper() for d in got.description}
    for name, kind in df.dtypes:
        if kind in ("int", "bigint", "double", "boolean", "string"):
            want = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}[kind]
            if kinds[name] not in ("NUMBER", "STRING", "BOOL"):
                assert kinds[name] == want, (name, kind, kinds[name])
