"""Item and learner quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from learnloom import constants as K
from learnloom.functions import scalars as S
from learnloom.operators.bank import tagged_questions
from learnloom.operators.diagnostics import wrong_tagged
from learnloom.operators.sequence import neighbour, running


def unknown_share(log: DataFrame) -> DataFrame:
    """Share of wrong answers put down to guessing, and classified otherwise, per subject."""
    wrong = log.where("not correct")
    guess = F.col("error_tag") == "unknown_guess"
    classified = F.col("error_tag").isNotNull() & ~guess
    return wrong.groupBy("subject").agg(
        F.count("*").alias("wrong"),
        (F.count_if(guess) / F.count("*")).alias("unknown_share"),
        (F.count_if(classified) / F.count("*")).alias("classified_share"),
    )


def fallback_share(log: DataFrame, bank: DataFrame) -> DataFrame:
    """Share of answers on questions without metadata. Answers are counted per question
    before the join, so a hot question is one row."""
    counts = log.groupBy("subject", "question_id").agg(F.count("*").alias("n"))
    curated = bank.where("wrong_choice_tags is not null").select("question_id")
    bare = counts.join(curated, "question_id", "left_anti").groupBy("subject").agg(F.sum("n").alias("fallback"))
    totals = counts.groupBy("subject").agg(F.sum("n").alias("answers"))
    return totals.join(bare, "subject", "left").select(
        "subject", "answers", (F.coalesce("fallback", F.lit(0)) / F.col("answers")).alias("fallback_share")
    )


def duplicate_serve_rate(log: DataFrame) -> DataFrame:
    """Served answers minus distinct questions, over served, per learner and subject."""
    per_question = log.groupBy("learner_id", "subject", "question_id").agg(F.count("*").alias("n"))
    served = per_question.groupBy("learner_id", "subject").agg(
        F.sum("n").alias("served"), F.count("*").alias("distinct_questions")
    )
    return served.withColumn("duplicate_rate", 1 - F.col("distinct_questions") / F.col("served"))


def difficulty_alignment(missions: DataFrame) -> DataFrame:
    """Mean distance between target and served difficulty per (learner, subject), from the
    exact integer difference of target x total and summed difficulty."""
    gap = F.abs(F.col("target_difficulty") - F.col("avg_difficulty"))
    return missions.groupBy("learner_id", "subject").agg(
        F.count("*").alias("missions"), S.to_fixed(F.avg(gap), 6).alias("mean_gap")
    )


def remediation_hits(log: DataFrame, bank: DataFrame) -> DataFrame:
    """Right answers over served, on questions tied to each tag. Counted per question first."""
    counts = log.groupBy("question_id").agg(F.count("*").alias("served"), F.count_if("correct").alias("hits"))
    tags = tagged_questions(bank).select("question_id", "tag")
    return (
        counts.join(tags, "question_id")
        .groupBy("tag")
        .agg(F.sum("served").alias("served"), F.sum("hits").alias("hits"))
        .withColumn("hit_rate", F.col("hits") / F.col("served"))
    )


def recurrence_in_missions(log: DataFrame, missions: int = 3, split: bool = True) -> DataFrame:
    """Share of (mission, tag) errors whose tag returns within the next ``missions`` missions."""
    keys = ["learner_id", "subject", "error_tag"]
    errors = log.where(wrong_tagged()).select(*keys, "block", "n_blocks", "mission_no").distinct()
    linked = neighbour(errors, keys, "mission_no", {"mission_no": F.col("mission_no")}, split=split)
    again = F.coalesce(F.col("next.mission_no") - F.col("mission_no") <= missions, F.lit(False))
    return linked.groupBy("subject", "error_tag").agg(
        F.count("*").alias("errors"), F.count_if(again).alias("recurrent")
    ).withColumn("recurrence_rate", F.col("recurrent") / F.col("errors"))


def item_stats(log: DataFrame, n: int = 200) -> DataFrame:
    """Most served questions to curate first: exposure desc, error rate desc, id."""
    items = log.groupBy("subject", "question_id").agg(
        F.count("*").alias("served"), (F.count_if(~F.col("correct")) / F.count("*")).alias("error_rate")
    )
    return items.orderBy(F.desc("served"), F.desc("error_rate"), "question_id").limit(n)


def tag_serves(log: DataFrame) -> DataFrame:
    """Tags served per mission: (learner, subject, tag, mission), one row each."""
    return (
        log.withColumn("tag", F.explode(F.array_distinct(F.array_compact("wrong_choice_tags"))))
        .select("learner_id", "block", "n_blocks", "subject", "tag", "mission_no")
        .distinct()
    )


def high_priority_errors(outcomes: DataFrame, folded: DataFrame, floor: float = K.CANDIDATE_PRIORITY) -> DataFrame:
    """(learner, subject, tag, mission) whose error raised the tag to at least ``floor``."""
    keys = ["learner_id", "subject", "block", "mission_no", "skill_id"]
    raised = folded.where(F.col("error_priority") >= floor).select(*keys, "error_priority")
    return (
        outcomes.select(*keys, F.col("error_tag").alias("tag"), F.col("now_ms").alias("at_ms"))
        .join(raised, keys)
        .groupBy("learner_id", "subject", "block", "mission_no", "tag", "at_ms")
        .agg(F.max("error_priority").alias("priority"))
    )


def reserve_reach(log: DataFrame, errors: DataFrame, within: int = 2, split: bool = True) -> DataFrame:
    """Per high-priority error: was a question with that tag served within the learner's
    next ``within`` missions of the subject? The few missions ahead are probed by equi join,
    whose key includes the mission, so a busy learner spreads over tasks."""
    keys = ["learner_id", "subject"]
    numbered = _subject_mission_no(log.select(*keys, "block", "n_blocks", "mission_no").distinct(), split)
    mission = [*keys, "block", "mission_no"]
    served = tag_serves(log).join(numbered, mission).select(*keys, "tag", "subject_no").withColumn("_hit", F.lit(True))
    ahead = errors.join(numbered, mission).withColumn(
        "subject_no", F.explode(F.sequence(F.col("subject_no") + 1, F.col("subject_no") + within))
    )
    return (
        ahead.join(served, [*keys, "tag", "subject_no"], "left")
        .groupBy(*keys, "tag", "mission_no", "at_ms")
        .agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("reached"))
    )


def _subject_mission_no(missions: DataFrame, split: bool) -> DataFrame:
    numbered = running(missions, ["learner_id", "subject"], ["mission_no"], {"subject_no": ("sum", F.lit(1))}, split)
    return numbered.drop("n_blocks")


def reach_by_tag(reach: DataFrame) -> DataFrame:
    return reach.groupBy("subject", "tag").agg(
        F.count("*").alias("events"), (F.count_if("reached") / F.count("*")).alias("reach_rate")
    )


def subject_gap(reach: DataFrame, left: str = "math", right: str = "japanese", points: float = 15.0) -> DataFrame:
    """Weeks with a reach gap of at least ``points`` between two subjects, flagged when the
    week before had one too. One row per calendar week reaches the window."""
    week = F.date_format(F.date_trunc("week", F.timestamp_millis("at_ms")), "yyyy-MM-dd")
    rate = lambda s: F.count_if((F.col("subject") == s) & F.col("reached")) / F.nullif(
        F.count_if(F.col("subject") == s), F.lit(0)
    )
    weekly = (
        reach.groupBy(week.alias("week"))
        .agg(rate(left).alias("left_rate"), rate(right).alias("right_rate"))
        .withColumn("gap_points", S.to_fixed(F.abs(F.col("left_rate") - F.col("right_rate")) * 100, 6))
        .withColumn("wide", F.coalesce(F.col("gap_points") >= points, F.lit(False)))
    )
    previous = Window.partitionBy(F.lit(0)).orderBy("week")
    adjacent = F.datediff(F.col("week").cast("date"), F.lag(F.col("week").cast("date")).over(previous)) == 7
    return weekly.withColumn(
        "split_thresholds", F.col("wide") & F.coalesce(F.lag("wide").over(previous) & adjacent, F.lit(False))
    )


def blocked_promotions(missions: DataFrame) -> DataFrame:
    """Missions that would have promoted but for the unresolved index."""
    gate = lambda index: S.next_difficulty(
        F.lit(2), "accuracy", "avg_mastery", index, F.col("avg_difficulty") - F.col("target_difficulty") + 2, "mode"
    )
    free = (gate(F.lit(0.0)) == 3) & (F.col("unresolved_index") > K.PROMOTE_UNRESOLVED)
    return missions.groupBy("learner_id", "subject").agg(
        F.count("*").alias("missions"), F.count_if(free).alias("blocked")
    )


def daily_divergence(daily: DataFrame, missions: DataFrame) -> DataFrame:
    """Daily accuracy against the mean of the day's mission accuracies."""
    per_day = missions.groupBy("learner_id", "date").agg(F.avg("accuracy").alias("_mean"))
    day = F.col("correct") / F.col("total")
    return daily.join(per_day, ["learner_id", "date"]).select(
        "learner_id", "date", S.to_fixed(F.abs(day - F.col("_mean")), 6).alias("divergence")
    )

