"""Every query with a DuckDB equivalent gives the same rows, names and types."""

import math
from pathlib import Path

import duckdb
import pytest

from promptloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 5) + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    rows = sorted(tuple(norm(r[c]) for c in want.columns) for r in df.collect())
    assert rows == sorted(tuple(map(norm, r)) for r in want.fetchall())


def test_every_query_without_sql_is_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"bradley_terry_interval", "bradley_terry_strength", "wilcoxon_holm", "near_duplicates"}
