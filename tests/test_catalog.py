"""Each catalogued query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from sigspark.plans import catalog, numeric


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    cells = [[None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) else v for v in frame[c].tolist()] for c in columns]
    return sorted(zip(*cells, strict=True), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, tables, name):
    got = numeric.QUERIES[name](spark, sf_dir)
    expected = tables.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got.toPandas()) == rows_of(expected)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert {"start", "end", "len"} == set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
