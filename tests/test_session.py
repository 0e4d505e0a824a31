"""Life cycle of intermediate tables, and answers that follow their input."""

import os
import shutil

import compare
import pyarrow.parquet as pq
from learnloom import session
from learnloom.plans.all_queries import ORACLE, QUERIES
from learnloom.sources import testdata
from pyspark.sql import functions as F


def test_scratch_deletes_what_it_wrote(spark):
    with session.Scratch(spark) as scratch:
        first = scratch.save(spark.range(5).toDF("a"))
        second = scratch.save(first.withColumn("b", F.col("a") * 2))
        scratch.drop(first)
        assert second.count() == 5 and len(os.listdir(scratch.root)) == 1
    assert not os.path.exists(scratch.root)


def test_cleanup_empties_folder_and_catalogue(spark, monkeypatch):
    monkeypatch.setattr(session, "_TABLES", {})
    monkeypatch.setattr(session, "_FOLDERS", {})
    before = {t.name for t in spark.catalog.listTables()}
    table = session.materialise(spark.range(100).toDF("a"), ["a"], buckets=3)
    plain = session.materialise(table)
    assert plain.count() == 100 and table.rdd.getNumPartitions() == 3
    made = [p for paths in session._FOLDERS.values() for p in paths]
    session.cleanup(spark)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert len(made) == 2 and not any(os.path.exists(p) for p in made)


def test_buckets_follow_the_bytes(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.bucket_count(spark, 1) == least
    assert session.bucket_count(spark, 1000 * session.BUCKET_BYTES) == 1000


def test_changed_input_changes_the_answer(spark, tmp_path):
    sf = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", sf)
    os.chmod(sf, 0o755)
    name = "daily_stats"
    assert compare.difference(QUERIES[name](spark, str(sf)), compare.connect(str(sf)), ORACLE[name]) is None
    events = pq.read_table("/root/testdata/sf0.001/events.parquet").slice(0, 400)
    os.chmod(sf / "events.parquet", 0o644)
    pq.write_table(events, sf / "events.parquet")
    assert compare.difference(QUERIES[name](spark, str(sf)), compare.connect(str(sf)), ORACLE[name]) is None
    assert testdata.tables(spark, str(sf)).table("events").count() == len(events)


def test_a_bucket_holds_no_more_answers_than_a_task_sorts_in_memory(spark):
    answers, stored = 36_000_000, 20  # bytes of an answer in the events of the test tables
    assert answers / session.bucket_count(spark, answers * stored) <= 1_000_000
