"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from quarry import catalogue


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = sql.sql(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str)).values.tolist()
    assert tidy(got) == tidy(want)
