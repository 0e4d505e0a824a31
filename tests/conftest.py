import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

import compare  # noqa: E402
from learnloom.session import build_session, cleanup  # noqa: E402
from learnloom.sources import testdata  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HOT = "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    cleanup(session)


@pytest.fixture(scope="session")
def tables(spark):
    return testdata.tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def oracle():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="session")
def hot_tables(spark):
    """A third of all answers belong to one learner, who spans many small blocks."""
    from pyspark.sql import functions as F

    events = testdata.read(spark, SF_DIR, "events").withColumn("user_id", F.expr(HOT))
    return testdata.Tables(spark, SF_DIR, 100, events)


@pytest.fixture(scope="session")
def hot_oracle():
    con = compare.connect(SF_DIR)
    con.execute(
        f"CREATE OR REPLACE VIEW events AS SELECT * REPLACE ({HOT} AS user_id) "
        f"FROM read_parquet('{SF_DIR}/events.parquet')"
    )
    return con
