"""Mission scores, tags, rewards, streaks, totals, badges and bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from learnloom import constants as K
from learnloom.functions import scalars as S
from learnloom.operators.diagnostics import wrong_tagged
from learnloom.operators.sequence import running, top_rows

MISSION = ["learner_id", "block", "mission_no"]


def dedup_answers(answers: DataFrame) -> DataFrame:
    """One answer per (learner, mission, pos): the latest wins (map-side combined)."""
    keys = ["learner_id", "mission_no", "pos"]
    rest = [c for c in answers.columns if c not in keys]
    return (
        answers.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("answered_ms", "seq")).alias("_last"))
        .select(*keys, "_last.*")
    )


def mission_summary(log: DataFrame) -> DataFrame:
    """Score and time span per mission in one aggregate; unused columns are pruned."""
    return (
        log.groupBy(*MISSION, "n_blocks", "subject")
        .agg(
            F.count("*").alias("total"),
            F.count_if("correct").alias("correct"),
            (F.count_if("correct") / F.count("*")).alias("accuracy"),
            (F.sum("difficulty") / F.count("*")).alias("avg_difficulty"),
            F.first("mode").alias("mode"),
            F.first("target_difficulty").alias("target_difficulty"),
            F.min("answered_ms").alias("started_ms"),
            F.max("answered_ms").alias("finished_ms"),
        )
        .withColumn("duration_sec", S.duration_sec("started_ms", "finished_ms"))
    )


def mission_score(log: DataFrame) -> DataFrame:
    return mission_summary(log).drop("started_ms", "finished_ms", "duration_sec")


def mission_spans(log: DataFrame) -> DataFrame:
    return mission_summary(log).select(*MISSION, "n_blocks", "started_ms", "finished_ms", "duration_sec")


def mission_error_tags(log: DataFrame) -> DataFrame:
    return (
        log.where(wrong_tagged())
        .groupBy(*MISSION, "error_tag")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    )


def top2_misconceptions(log: DataFrame) -> DataFrame:
    """Top two tags per mission, first seen first on ties; the focus tag is the first."""
    ranked = top_rows(mission_error_tags(log), MISSION, [F.desc("n"), "first_pos"], 2)
    return ranked.groupBy(*MISSION).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.col("error_tag").alias("tag"), "n"))),
            lambda s: F.struct(s.tag.alias("tag"), s.n.alias("n")),
        ).alias("top_misconceptions"),
        F.min_by("error_tag", "rank").alias("focus_tag"),
    )


def combo_streak(log: DataFrame) -> DataFrame:
    """Correct answers in a row within a mission, with milestone, next target and progress."""
    in_mission = Window.partitionBy(*MISSION).orderBy("pos")
    island = log.withColumn("_wrongs", F.sum(F.when(F.col("correct"), 0).otherwise(1)).over(in_mission))
    in_island = Window.partitionBy(*MISSION, "_wrongs").orderBy("pos")
    streak = F.sum(F.col("correct").cast("int")).over(in_island)
    return (
        island.withColumn("combo", streak)
        .drop("_wrongs")
        .withColumn("milestone", F.col("correct") & S.combo_milestone("combo"))
        .withColumn("next_target", S.combo_next_target("combo"))
        .withColumn("progress", S.combo_progress("combo"))
    )


def mission_results(log: DataFrame) -> DataFrame:
    """Scores, spans and rewards per mission on the recorded targets (no promotion)."""
    return (
        mission_summary(log)
        .withColumn("earned_xp", S.mission_xp("correct", "total", "mode", F.lit(0), F.lit(0), "avg_difficulty"))
        .withColumn("earned_stars", S.mission_stars("correct", "total", F.lit(0), F.lit(0)))
    )


def running_totals(results: DataFrame, split: bool = True) -> DataFrame:
    out = running(
        results,
        ["learner_id"],
        ["mission_no"],
        {"xp": ("sum", F.col("earned_xp")), "stars": ("sum", F.col("earned_stars"))},
        split,
    )
    return out.withColumn("level", S.level("xp"))


def subject_clears(results: DataFrame, split: bool = True) -> DataFrame:
    return running(results, ["learner_id", "subject"], ["mission_no"], {"clears": ("sum", F.lit(1))}, split)


def day_streak(play_days: DataFrame) -> DataFrame:
    """Streak length per (learner, date). One row per learner and calendar day, so the
    window is bounded by the calendar."""
    days = play_days.select("learner_id", F.to_date("date").alias("date")).distinct()
    by_day = Window.partitionBy("learner_id").orderBy("date")
    island = days.withColumn("_island", F.date_sub("date", F.row_number().over(by_day)))
    in_island = Window.partitionBy("learner_id", "_island").orderBy("date")
    return island.select(
        "learner_id",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.row_number().over(in_island).cast("bigint").alias("streak_days"),
    )


def with_day_streak(results: DataFrame) -> DataFrame:
    dated = results.withColumn("date", S.play_date(F.timestamp_millis("finished_ms")))
    return dated.join(day_streak(dated), ["learner_id", "date"])


def badge_unlocks(results: DataFrame, split: bool = True) -> DataFrame:
    """First mission at which each badge rule holds. ``results`` carries before/after
    difficulty."""
    state = with_day_streak(subject_clears(results, split))
    perfect = F.col("correct") == F.col("total")
    rules = {
        "first_clear": F.lit(True),
        "perfect_mission": perfect,
        "three_day_streak": F.col("streak_days") >= 3,
        "math_explorer": (F.col("subject") == "math") & (F.col("clears") >= 3),
        "word_adventurer": (F.col("subject") == "japanese") & (F.col("clears") >= 3),
        "difficulty_climber": F.col("after_difficulty") > F.col("before_difficulty"),
        "challenge_clear": perfect & (F.col("mode") == "challenge"),
    }
    earned = F.array_compact(F.array(*[F.when(rule, F.lit(badge)) for badge, rule in rules.items()]))
    return (
        state.select("learner_id", "mission_no", F.explode(earned).alias("badge_id"))
        .groupBy("learner_id", "badge_id")
        .agg(F.min("mission_no").alias("unlocked_at"))
    )


def badge_board(unlocks: DataFrame, learners: DataFrame) -> DataFrame:
    """Every badge per learner, names masked while locked. Seven badges are fixed."""
    spark = unlocks.sparkSession
    master = [(i, *badge) for i, badge in enumerate(K.BADGES)]
    badges = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(b).alias("badge_id"), F.lit(n).alias("name"), F.lit(d).alias("description"))
          for i, b, n, d in master]
    )
    board = learners.select("learner_id", F.inline(badges)).join(unlocks, ["learner_id", "badge_id"], "left")
    unlocked = F.col("unlocked_at").isNotNull()
    return board.select(
        "learner_id",
        "badge_id",
        "ordinal",
        unlocked.alias("unlocked"),
        F.when(unlocked, F.col("name")).otherwise(K.LOCKED_NAME).alias("title"),
        F.when(unlocked, F.col("description")).otherwise(K.LOCKED_DESCRIPTION).alias("text"),
    )


def recent_logs(log: DataFrame, n: int = K.LOG_RETENTION) -> DataFrame:
    return top_rows(log, ["learner_id"], [F.desc("seq")], n)


def recent_results(results: DataFrame, n: int = K.RESULT_RETENTION) -> DataFrame:
    return top_rows(results, ["learner_id"], [F.desc("mission_no")], n)


def accuracy_trend(results: DataFrame, n: int = 7) -> DataFrame:
    """Latest ``n`` missions in chronological order: accuracy %, minutes and day label."""
    latest = recent_results(results, n)
    return latest.select(
        "learner_id",
        "mission_no",
        F.row_number()
        .over(Window.partitionBy("learner_id").orderBy("mission_no"))
        .cast("bigint")
        .alias("position"),
        S.month_day(F.timestamp_millis("finished_ms")).alias("label"),
        F.when(F.col("total") > 0, S.js_round(F.col("correct") / F.col("total") * 100)).alias("accuracy_pct"),
        S.duration_min("duration_sec").alias("minutes"),
    )


def recent_questions(log: DataFrame, n: int = K.RECENT_QUESTIONS) -> DataFrame:
    """Latest distinct questions per (learner, subject): last mission first, then position."""
    last = log.groupBy("learner_id", "subject", "question_id").agg(
        F.max(F.struct("mission_no", (-F.col("pos")).alias("neg_pos"))).alias("_last")
    )
    return top_rows(
        last.select("learner_id", "subject", "question_id", "_last.*"),
        ["learner_id", "subject"],
        [F.desc("mission_no"), F.desc("neg_pos")],
        n,
    ).withColumn("pos", -F.col("neg_pos")).drop("neg_pos")


def evaluate_sessions(sessions: DataFrame) -> DataFrame:
    """Outcomes of nested mission sessions: arrays of questions, answers and traces are
    zipped by position (a missing answer or trace gives a null)."""
    rows = sessions.select(
        *[c for c in sessions.columns if c not in ("questions", "answers", "traces")],
        F.posexplode(F.arrays_zip("questions", "answers", "traces")).alias("pos", "_z"),
    )
    question = F.col("_z.questions")
    return (
        rows.where(question.isNotNull())
        .select(
            *[c for c in rows.columns if c != "_z"],
            question["question_id"].alias("question_id"),
            question["skill_id"].alias("skill_id"),
            question["difficulty"].alias("difficulty"),
            F.coalesce(F.col("_z.answers") == question["answer_index"], F.lit(False)).alias("correct"),
            F.col("_z.traces")["error_tag"].alias("error_tag"),
        )
    )
