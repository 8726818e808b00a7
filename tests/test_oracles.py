"""Every registered query outside the removable subpackage against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from cosecha.plans.catalog import build_registry

SF = "/root/testdata/sf0.001"
REGISTRY = build_registry()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_agrees_with_its_oracle(spark, tables, name):
    found = REGISTRY.queries[name](spark, SF).toPandas()
    wanted = tables.execute(REGISTRY.oracles[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    assert rows(found, columns) == rows(wanted, columns)
    assert len(set(found.columns)) == len(found.columns)


def test_every_query_has_an_oracle_but_the_fuzzy_one():
    assert set(REGISTRY.queries) - set(REGISTRY.oracles) == {"D15_fuzzy_best_match"}
