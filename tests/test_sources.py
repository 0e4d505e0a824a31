"""Text bank, state export and sinks."""

import pytest
from pyspark.sql import functions as F

from learnloom.functions import facts
from learnloom.operators import bank as B
from learnloom.sources import bank_text, state_json

GOOD = "| q1 | math | add_within10 | 1 | 1 + 1 | 1 | 2 | 3 | 1 | hint |"
BAD = {
    "columns": "| q2 | math | add_within10 | 1 | 1 + 1 | 1 | 2 | 3 | 1 |",
    "id": "|  | math | add_within10 | 1 | p | 1 | 2 | 3 | 1 | h |",
    "subject": "| q3 | art | add_within10 | 1 | p | 1 | 2 | 3 | 1 | h |",
    "skill_id": "| q4 | math |  | 1 | p | 1 | 2 | 3 | 1 | h |",
    "difficulty": "| q5 | math | s | 6 | p | 1 | 2 | 3 | 1 | h |",
    "answer_index": "| q6 | math | s | 5 | p | 1 | 2 | 3 | 3 | h |",
}


def write(tmp_path, lines):
    body = ["# bank", "| not | this |", bank_text.START, "| id | … |", "|---|---|", *lines, "a remark", bank_text.END, GOOD]
    (tmp_path / "bank.md").write_text("\n".join(body), encoding="utf8")
    return str(tmp_path / "bank.md")


def test_read_and_validate(spark, tmp_path):
    rows = bank_text.read_bank_text(spark, write(tmp_path, [GOOD, *BAD.values(), "  " + GOOD.replace("q1", "q9")]))
    accepted, rejected = B.validate_bank(rows)
    assert [(r.ordinal, r.question_id) for r in accepted.orderBy("ordinal").collect()] == [(0, "q1"), (7, "q9")]
    assert {tuple(r.reasons) for r in rejected.collect()} == {(k,) for k in BAD}


def test_read_splits_a_large_file(spark, tmp_path):
    """Small read splits: row order and numbering hold across them."""
    lines = [GOOD.replace("q1", f"q{i}") for i in range(500)]
    path = write(tmp_path, lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = bank_text.read_bank_text(spark, path).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ordinal, r.cells[0]) for r in rows] == [(i, f"q{i}") for i in range(500)]


def test_strict_fails(spark, tmp_path):
    with pytest.raises(Exception, match="bad bank row: subject"):
        bank_text.load_bank(spark, write(tmp_path, [GOOD, BAD["subject"]])).collect()


def test_write_bank_prunes_by_subject(spark, tmp_path, tables):
    path = str(tmp_path / "bank")
    bank_text.write_bank(tables.bank, path)
    life = spark.read.parquet(path).where("subject = 'life'")
    assert life.count() == tables.bank.where("subject = 'life'").count()
    assert all("subject=life" in f for f in life.inputFiles()) or "PartitionFilters: [isnotnull(subject" in str(
        life._jdf.queryExecution().executedPlan()
    )
    bank_text.write_bank(tables.bank, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == tables.bank.count()


def test_save_state_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, '{"subjectClears":{"math":2},"skillProgress":{"s":{"mastery":50,"misconceptions":{"unknown_guess":{"priority":30}}}}}'), (2, "{}"), (3, "[1]"), (4, "broken")],
        "learner_id int, state string",
    )
    tables = state_json.normalize_state(rows, 1000, "learner_id")
    state_json.save_state(tables, str(tmp_path))
    for name, table in tables.items():
        back = state_json.read_state(spark, str(tmp_path), name)
        assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    clears = tables["subject_clears"].where("subject = 'math'").orderBy("learner_id").collect()
    assert [r.clears for r in clears] == [2.0, 0.0, 0.0, 0.0]
    assert tables["misconceptions"].first().priority == 30.0


FACT_CASES = [
    ("life", "clock_hour", "", ["3じ"], "clock"),
    ("life", "clock_hour", "", ["13じ"], None),
    ("life", "clock_hour", "", ["3じ20ふん"], None),
    ("life", "money_sum", "10えんだま　3まい", ["x"], "money"),
    ("life", "money_sum", "10えんだま 0まい", ["30えん"], None),
    ("life", "money_change", "80えん を 100えんで しはらいました", ["x"], "money"),
    ("life", "money_change", "80えん を 100えん", ["20えん"], None),
    ("math", "fractions_basic", "4とうぶん", ["x"], "fraction"),
    ("math", "fractions_basic", "", ["3/2"], None),
    ("math", "fractions_basic", "", ["2 / 3"], "fraction"),
    ("insight", "route_optimization", "A 1+2、B 3", ["B"], "route"),
    ("insight", "route_optimization", "A 1+2、B 0", ["B"], None),
    ("insight", "route_optimization", "A 1+2、B 3", [""], None),
    ("insight", "odd_one_out", "", ["a", "b", "c"], "odd_one_out"),
    ("insight", "odd_one_out", "", ["a", "　", "c"], None),
    ("math", "clock_hour", "", ["3じ"], None),
]


def test_facts_and_near_misses(spark):
    df = spark.createDataFrame(
        [(i, *c[:4], 0) for i, c in enumerate(FACT_CASES)],
        "i int, subject string, skill_id string, prompt string, choices array<string>, answer_index int",
    )
    got = {r.i: r.kind for r in facts.with_facts(df).collect()}
    assert got == {i: c[4] for i, c in enumerate(FACT_CASES)}


def test_shortest_route_first_on_ties(spark):
    df = spark.createDataFrame(
        [("insight", "route_optimization", "ルート C 9、 みち B 2+2ほ、A 4。?", ["nothing"], 0), ("insight", "route_optimization", "ルートC 9、みちB 1", ["コースC"], 0)],
        "subject string, skill_id string, prompt string, choices array<string>, answer_index int",
    )
    assert [r.b for r in facts.with_facts(df).select(F.col("route.best_route").alias("b")).collect()] == ["みち B", "ルートC"]


def test_bank_cells_are_built_once_for_all_rules(spark):
    good = ["q1", "math", "add", "3.0", "p", "a", "b", "c", "", "h"]
    bad = ["", "science", "", "0x1G", "p", "a", "b", "c", "3", "h"]
    lines = [(1, "|".join(good)), (2, "|".join(bad)), (3, "|".join(good[:9])), (4, None)]
    lines = spark.createDataFrame(lines, "ordinal long, line string")
    rows = lines.select("ordinal", F.split(F.concat("line", F.lit("")), r"\|").alias("cells"))
    accepted, rejected = B.validate_bank(rows)
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3
    assert [(r.ordinal, r.difficulty, r.answer_index) for r in accepted.collect()] == [(1, 3, 0), (4, None, None)]
    want = {2: ["id", "subject", "skill_id", "difficulty", "answer_index"], 3: ["columns"]}
    assert {r.ordinal: r.reasons for r in rejected.collect() if r.ordinal < 4} == want
    assert B.check_cells(rows).where("ordinal = 1").first().n_difficulty == 3.0
