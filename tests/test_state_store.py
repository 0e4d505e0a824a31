"""A stored version is there as a whole or not at all."""

import pytest

from learnloom.sources.state_store import StateStore

KEYS = {"skills": ["learner_id", "skill_id"], "subjects": ["learner_id"]}


def tables(spark, mastery, target):
    return {
        "skills": spark.createDataFrame(mastery, "learner_id long, skill_id string, mastery double"),
        "subjects": spark.createDataFrame(target, "learner_id long, target int"),
    }


def rows(store, name, *version):
    return sorted(tuple(r) for r in store.read(name, *version).collect())


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"), KEYS, merge_after=2)


def test_newest_row_per_key(spark, store):
    assert store.commit(0, tables(spark, [(1, "a", 45.0), (1, "b", 50.0)], [(1, 1)]))
    assert store.commit(3, tables(spark, [(1, "b", 58.0)], [(1, 2), (2, 1)]))
    assert rows(store, "skills") == [(1, "a", 45.0), (1, "b", 58.0)] and rows(store, "subjects") == [(1, 2), (2, 1)]
    assert rows(store, "skills", 2) == [(1, "a", 45.0), (1, "b", 50.0)]


def test_batch_run_twice_changes_nothing(spark, store):
    store.commit(0, tables(spark, [(1, "a", 45.0)], [(1, 1)]))
    assert not store.commit(0, tables(spark, [(1, "a", 99.0)], [(1, 9)]))
    assert rows(store, "skills") == [(1, "a", 45.0)] and store.versions() == [0]


def test_run_that_dies_between_two_tables(spark, store, monkeypatch):
    store.commit(0, tables(spark, [(1, "a", 45.0)], [(1, 1)]))
    broken = tables(spark, [(1, "a", 60.0)], [(1, 2)])
    broken["subjects"] = broken["subjects"].selectExpr("learner_id", "if(target > 0, raise_error('lost'), target) AS target")
    with pytest.raises(Exception, match="lost"):
        store.commit(1, broken)
    assert rows(store, "skills") == [(1, "a", 45.0)] and rows(store, "subjects") == [(1, 1)]
    assert store.commit(1, tables(spark, [(1, "a", 60.0)], [(1, 2)]))
    assert rows(store, "skills") == [(1, "a", 60.0)] and rows(store, "subjects") == [(1, 2)]
    assert store.vacuum() == 1  # what the broken run has left
    assert rows(store, "skills") == [(1, "a", 60.0)]


def test_merged_folders_hold_all_rows(spark, store):
    for version in range(6):
        store.commit(version, tables(spark, [(1, "a", float(version)), (version, "b", 1.0)], [(version, version)]))
    assert rows(store, "skills") == sorted([(1, "a", 5.0)] + [(v, "b", 1.0) for v in range(6)])
    assert rows(store, "subjects") == [(v, v) for v in range(6)]
    assert len(store._manifest(5)["folders"]) <= 2 and store.vacuum() > 0
    assert rows(store, "subjects") == [(v, v) for v in range(6)] and store.versions() == [5]


def test_two_writers_of_one_version(spark, store):
    store.commit(0, tables(spark, [(1, "a", 45.0)], [(1, 1)]))
    with pytest.raises(FileExistsError):
        store._publish(0, {"folders": [], "schemas": {}})
    assert rows(store, "skills") == [(1, "a", 45.0)]


def test_nothing_stored(store):
    assert store.versions() == []
    with pytest.raises(LookupError):
        store.read("skills")
