import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{fixtures.SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{fixtures.SF_DIR}/pages.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    return fixtures.awkward_documents(spark)


@pytest.fixture(scope="session")
def nothing(spark):
    return fixtures.awkward_documents(spark, [])


@pytest.fixture
def duck():
    """DuckDB connection over given Spark tables."""

    def connect(**tables):
        con = duckdb.connect()
        for name, table in tables.items():
            con.register(f"{name}_rows", table.toArrow())
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_rows")
        return con

    return connect
