"""Queries of the subpackage that have SQL, against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

from corvine.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
