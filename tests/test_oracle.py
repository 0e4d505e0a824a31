"""Every registered query against its SQL oracle, on plain data and with a hot learner."""

import pytest

import compare
from learnloom.plans.all_queries import ORACLE, PLANS, QUERIES


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(PLANS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, tables, oracle):
    assert compare.difference(PLANS[name](tables), oracle, ORACLE[name]) is None


# The learner log is what a hot learner skews; bank and text queries do not read it.
LEARNER_QUERIES = sorted(n for n in ORACLE if "learner_id" in ORACLE[n] and not n.startswith("stream") and not n.endswith("_blocks"))


@pytest.mark.parametrize("name", LEARNER_QUERIES)
def test_query_with_hot_learner(name, hot_tables, hot_oracle):
    assert compare.difference(PLANS[name](hot_tables), hot_oracle, ORACLE[name]) is None


def test_hot_learner_is_split(hot_tables):
    assert hot_tables.split
    assert hot_tables.answers.groupBy("learner_id", "block").count().agg({"count": "max"}).first()[0] <= 100
