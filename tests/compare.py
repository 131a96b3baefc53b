"""Runs a query and its DuckDB SQL on the same folder and compares the rows as multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float):
        return round(value, 12)
    return value


def rows_of(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def oracle_rows(sql: str, sf_dir: str = SF) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for file in Path(sf_dir).iterdir():
        con.execute(f"create view {file.stem} as select * from '{file}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def assert_same(spark, run, sql: str, sf_dir: str = SF) -> None:
    df = run(spark, sf_dir)
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    found = rows_of(df)
    assert found == expected, f"only in Spark: {list((found - expected).items())[:3]}; only in SQL: {list((expected - found).items())[:3]}"
