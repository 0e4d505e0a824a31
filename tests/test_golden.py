"""Golden rows: the model's own test cases, restated as small tables."""

import pytest
from pyspark.sql import functions as F

from learnloom import constants as K
from learnloom.functions import scalars as S
from learnloom.functions.tags import infer_error_tag
from learnloom.operators import bank as B
from learnloom.operators import diagnostics as D
from learnloom.operators import missions as M
from learnloom.operators import replay as R
from learnloom.operators import sequence
from learnloom.operators import selection as SEL
from learnloom.operators import skills as SK
from learnloom.plans import mission_queries as MQ
from learnloom.sources.testdata import NOW_MS

NOW = 1_700_000_000_000
MATH_SKILLS = ["add_within10", "add_within20", "compare_numbers", "sub_within10", "sub_within20", "word_math"]


def small_bank(spark):
    rows = [
        (f"m{i}", "math", MATH_SKILLS[i % 6], 1 + i // 6 % 5, "?", ["1", "2", "3"], 1, "", i)
        for i in range(60)
    ]
    bank = spark.createDataFrame(
        rows,
        "question_id string, subject string, skill_id string, difficulty int, prompt string, "
        "choices array<string>, answer_index int, hint string, ordinal bigint",
    )
    return B.with_meta(bank, B.curated_tags(spark))


def traces(spark, latencies):
    rows = [(1, i, "math", 1, True, ms) for i, ms in enumerate(latencies)]
    return spark.createDataFrame(
        rows, "learner_id bigint, seq bigint, subject string, difficulty int, correct boolean, latency_ms bigint"
    )


def test_few_samples_keep_the_default_threshold(spark):
    assert D.guess_threshold(traces(spark, [1200, 1000])).first().guess_threshold_ms == 900


def test_enough_samples_clamp_the_threshold(spark):
    assert D.guess_threshold(traces(spark, [1000] * 20)).first().guess_threshold_ms == 700
    assert D.guess_threshold(traces(spark, [3000] * 20)).first().guess_threshold_ms == 1050
    # even count: mean of the two middle values, one of them far out
    assert D.guess_threshold(traces(spark, [1000] * 10 + [90_000] * 10)).first().guess_threshold_ms == 1400


def question(spark, tags, latency):
    return spark.createDataFrame(
        [("math", "add_within10", ["1", "2", "3"], 1, tags, 0, False, latency, 900)],
        "subject string, skill_id string, choices array<string>, answer_index int, wrong_choice_tags array<string>, "
        "selected_index int, correct boolean, latency_ms bigint, guess_threshold_ms bigint",
    )


def test_metadata_tag_wins(spark):
    row = small_bank(spark).where("skill_id = 'add_within10'").first()
    tagged = question(spark, row.wrong_choice_tags, 3000).select(infer_error_tag().alias("t")).first()
    assert tagged.t == "math_counting_slip"
    assert row.remediation_hint == {"math_counting_slip": K.TAG_HINTS["math_counting_slip"]}


def test_fast_wrong_answer_without_metadata_is_a_guess(spark):
    assert question(spark, None, 500).select(infer_error_tag().alias("t")).first().t == "unknown_guess"


def test_curated_tags_replace_the_default(spark):
    bank = spark.createDataFrame(
        [("m88", "math", "add_within10")], "question_id string, subject string, skill_id string"
    )
    row = B.with_meta(bank, B.curated_tags(spark)).first()
    assert row.wrong_choice_tags == K.CURATED_TAGS["m88"] and row.remediation_hint is None


def mission_inputs(spark, priority):
    states = spark.createDataFrame(
        [(1, "math", s, 80.0, 0, NOW + 10_000, 1) for s in MATH_SKILLS],
        "learner_id bigint, subject string, skill_id string, mastery double, streak bigint, next_review_at bigint, seen_count bigint",
    )
    due = spark.createDataFrame(
        [(1, "math", "add_within10", "math_counting_slip", 0, priority, NOW - 1)],
        "learner_id bigint, subject string, skill_id string, tag string, ordinal int, priority double, due_at bigint",
    )
    targets = spark.createDataFrame([(1, "math", 2)], "learner_id bigint, subject string, target_difficulty int")
    recents = spark.createDataFrame([], "learner_id bigint, subject string, question_id string")
    return targets, states, SK.due_misconceptions(due, NOW), recents


def test_due_misconception_is_served(spark):
    bank = small_bank(spark)
    targets, states, due, recents = mission_inputs(spark, 80.0)
    catalogue = B.skill_catalogue(bank)
    dense = SK.densify(targets.select("learner_id", "subject"), catalogue, states, NOW)
    plan = SEL.plan_missions(targets, dense, due, recents, bank, catalogue, NOW, seed=42)
    row = plan.first()
    assert row.misconception_count >= 1
    served = SEL.build_missions(plan).join(bank, ["question_id", "subject"]).collect()
    assert len(served) == 5 == len({r.question_id for r in served})
    assert "add_within10" in {r.skill_id for r in served}


def play(skills, outcomes, target, mode="learn"):
    after = dict(skills)
    for skill, difficulty, correct in outcomes:
        after[skill] = R.answer_step(skills[skill], correct, difficulty, None, target)
    average, index = R.gates(after, len(MATH_SKILLS))
    return index, R.target_step(target, 1.0, average, index, 2.0, mode)


def clean():
    return {s: {"mastery": 80.0, "tags": []} for s in MATH_SKILLS}


def test_unresolved_misconceptions_demote():
    skills = clean()
    skills["add_within10"]["tags"] = [["math_counting_slip", 100.0, 0]]
    skills["sub_within10"]["tags"] = [["math_operation_confusion", 100.0, 0]]
    index, target = play(skills, [("add_within10", 2, True), ("sub_within10", 2, True)], 2)
    assert index == 0.92 and target == 1


def test_clean_strong_result_promotes():
    index, target = play(clean(), [("add_within10", 2, True), ("sub_within10", 2, True)], 2)
    assert index == 0 and target == 3
    assert play(clean(), [("add_within10", 2, True)], 2, "review")[1] == 2


def test_promotion_held_and_gates_as_columns(spark):
    rows = [(2, 0.9, 80.0, 0.7, 2.0, "learn"), (2, 0.8, 55.0, 0.35, 1.75, "learn"), (2, 0.4, 80.0, 0.0, 2.0, "learn"), (1, 0.0, 0.0, 1.0, 1.0, "learn")]
    df = spark.createDataFrame(rows, "before int, a double, m double, u double, d double, mode string")
    after = df.select(S.next_difficulty("before", "a", "m", "u", "d", "mode").alias("x")).collect()
    assert [r.x for r in after] == [1, 3, 1, 1]


@pytest.mark.parametrize(
    "correct,total,mode,before,after,avg,xp,stars",
    [(5, 5, "challenge", 2, 3, 2.5, 50 + 12 + 10 + 15 + 5, 5 + 3 + 1), (0, 5, "learn", 2, 1, 1.0, 5 + 2, 1), (0, 0, "review", 1, 1, 1.0, 8 + 2, 3)],
)
def test_rewards(spark, correct, total, mode, before, after, avg, xp, stars):
    row = spark.createDataFrame(
        [(correct, total, mode, before, after, avg)], "c int, t int, m string, b int, a int, d double"
    ).select(S.mission_xp("c", "t", "m", "b", "a", "d").alias("xp"), S.mission_stars("c", "t", "b", "a").alias("st")).first()
    assert (row.xp, row.st) == (xp, stars)


def test_error_interval_is_capped(spark):
    got = [r[0] for r in spark.range(0, 70, 1).select(S.error_interval_ms("id")).collect()]
    assert got == [min(180_000 * 2 ** max(n - 1, 0), 86_400_000) for n in range(70)]


def test_misconception_bounds_and_order(spark):
    """Priority stays in 0..100, and the first-seen tag wins a tie."""
    events = [(False, "attention_slip")] * 9 + [(False, "unknown_guess")] * 9 + [(True, None)]
    rows = [(1, "math", "s", 0, 1, i, NOW + i, 5, c, t, 1, "learn") for i, (c, t) in enumerate(events)]
    outcomes = spark.createDataFrame(
        rows,
        "learner_id bigint, subject string, skill_id string, block bigint, n_blocks bigint, mission_no bigint, now_ms bigint, "
        "difficulty int, correct boolean, error_tag string, target_difficulty int, mode string",
    )
    got = {r.tag: r for r in SK.misconception_fold(outcomes).collect()}
    assert got["attention_slip"].priority == 92.0 and got["unknown_guess"].priority == 100.0
    assert got["attention_slip"].recent_error_count == 8 and got["attention_slip"].due_at == NOW + 18 + K.RESOLVE_INTERVAL_MS
    assert got["unknown_guess"].recent_error_count == 9
    assert got["unknown_guess"].due_at == NOW + 17 + 3 * K.MINUTE_MS * 2**8


def test_native_fold_equals_replay_fold(tables):
    """The column fold and the replay's step function agree on the unresolved index."""
    from learnloom.plans.replay_queries import folded

    last = folded(tables).groupBy("learner_id", "subject").agg(F.max_by("unresolved_index", "mission_no").alias("u"))
    index = SK.unresolved_index(tables.misconceptions, tables.log.select("learner_id").distinct())
    assert last.join(index, ["learner_id", "subject"]).where("u <> unresolved_index").count() == 0
    assert last.count() > 0


def test_invariants(tables):
    from learnloom.plans.all_queries import PLANS

    results = PLANS["replay_results"](tables)
    bad = ~F.col("after_difficulty").between(1, 5) | ~F.col("avg_mastery").between(0, 100) | (F.col("correct") > F.col("total"))
    assert results.where(bad).count() == 0
    plans = PLANS["mission_plan"](tables)
    assert plans.where("misconception_count > 2 or review_count + core_count + challenge_count > 5").count() == 0
    served = PLANS["build_missions"](tables)
    assert served.groupBy("learner_id", "subject", "question_id").count().where("count > 1").count() == 0
    assert tables.misconceptions.where("priority < 0 or priority > 100").count() == 0


def test_long_histories_fold_in_few_rounds(spark, monkeypatch):
    """Sixty blocks; a skill and a tag that stop early reach the last block at once."""
    from learnloom.operators import replay, sequence

    rows = []
    for block in range(60):
        for i in range(24):
            mission = block * 24 + i
            wrong = i < 12
            tag = ("attention_slip" if block < 3 else "unknown_guess") if wrong else None
            rows.append((1, "math", "busy", block, 60, mission, NOW + mission, 3, not wrong, tag, 0.0 if wrong else 1.0, 3.0, "learn"))
            if block == 0:
                rows.append((1, "math", "early", 0, 60, mission, NOW + mission, 3, i % 2 == 0, "unknown_guess", 1.0, 3.0, "learn"))
    columns = (
        "learner_id bigint, subject string, skill_id string, block bigint, n_blocks bigint, mission_no bigint, now_ms bigint, "
        "difficulty int, correct boolean, error_tag string, accuracy double, avg_difficulty double, mode string"
    )
    outcomes = spark.createDataFrame(rows, columns)
    whole = outcomes.withColumns({"block": F.lit(0).cast("bigint"), "n_blocks": F.lit(1).cast("bigint")})
    catalogue = spark.createDataFrame([("math", s) for s in ("busy", "early", "unseen")], "subject string, skill_id string")
    rounds = []

    def counted(rows, keys, run, *kind, **more):
        return sequence.fold_blocks(rows, keys, lambda *a: rounds.append(keys) or run(*a), *kind, **more)

    for module in (replay, SK):
        monkeypatch.setattr(module, "fold_blocks", counted)
    fold = lambda rows: sorted(map(tuple, replay.fold_missions(rows, catalogue).drop("block").collect()))
    assert fold(outcomes) == fold(whole)
    assert len(rounds) <= 4
    rounds.clear()
    tags = lambda rows: sorted(map(tuple, SK.misconception_fold(rows).collect()))
    assert tags(outcomes) == tags(whole)
    assert len(rounds) <= 4


def test_chained_folds_do_not_broadcast_by_file_size(spark, monkeypatch):
    """States of many rows make small files; building them in the driver does not scale."""
    rows = [(1, "math", "s", n // 5, 4, n, NOW + n, 3, n % 3 == 0, "unknown_guess") for n in range(20)]
    columns = (
        "learner_id bigint, subject string, skill_id string, block bigint, n_blocks bigint, mission_no bigint, now_ms bigint, "
        "difficulty int, correct boolean, error_tag string"
    )
    plans = []
    save = sequence.Scratch.save

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(sequence.Scratch, "save", noted)
    folded = SK.misconception_fold(spark.createDataFrame(rows, columns))
    plans.append(folded._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in plan for plan in plans)


def test_halo_rows_carry_only_what_is_read(spark):
    rows = spark.range(30).selectExpr(
        "1L AS learner_id", "id AS seq", "id div 10 AS block", "3L AS n_blocks", "id AS value", "array('x', 'y') AS wide"
    )
    got = sequence.with_halo(rows, 15, 10, columns=["learner_id", "value"])
    copies = got.where("is_halo")
    assert sorted((r.block, r.seq, r.value) for r in copies.collect()) == sorted(
        (b, s, s) for s in range(30) for b in range(s // 10 + 1, 3) if s >= b * 10 - 15
    )
    assert copies.where("wide is not null").isEmpty()
    assert got.where("not is_halo").where("wide is not null").count() == 30
    whole = sequence.with_halo(rows, 15, 10)
    assert whole.where("wide is null").isEmpty()


def test_mission_candidates_carry_no_hash(tables):
    """The tie hash follows from the row; recent questions come with their penalty only."""
    recent = M.recent_questions(tables.log)
    found = SEL.candidates(
        MQ.targets(tables), MQ.dense(tables), MQ.due(tables), recent, tables.bank, tables.catalogue, NOW_MS, MQ.SEED
    )
    assert "class_tie" not in found.columns
    again = found.where("kind <> 'fill'").join(recent.select(*SEL.GROUP, "question_id"), [*SEL.GROUP, "question_id"])
    assert not again.isEmpty() and again.where(F.col("score") < K.RECENT_PENALTY).isEmpty()
