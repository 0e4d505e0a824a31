"""Per-skill state: review schedule, mastery, misconceptions and what follows from them.

All functions take ``outcomes``: the last answer per (mission, skill), because every
answer of a mission reads the state from before the mission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from learnloom import constants as K
from learnloom.functions import scalars as S
from learnloom.operators.sequence import STATE, fold_blocks, neighbour, running, top_rows
from learnloom.session import broadcast_checked

SKILL = ["learner_id", "subject", "skill_id"]
SKILL_BLOCK = [*SKILL, "block"]


def skill_outcomes(log: DataFrame) -> DataFrame:
    """Last answer per (mission, skill), with the mission's score and finish time ``now_ms``."""
    mission = Window.partitionBy("learner_id", "block", "mission_no")
    picked = ["difficulty", "correct", "error_tag", "target_difficulty", "mode"]
    return (
        log.withColumns(
            {
                "now_ms": F.max("answered_ms").over(mission),
                "accuracy": F.avg(F.col("correct").cast("int")).over(mission),
                "avg_difficulty": F.avg("difficulty").over(mission),
            }
        )
        .groupBy(*SKILL_BLOCK, "n_blocks", "mission_no", "now_ms", "accuracy", "avg_difficulty")
        .agg(F.max_by(F.struct(*picked), "pos").alias("_last"))
        .select(*SKILL_BLOCK, "n_blocks", "mission_no", "now_ms", "accuracy", "avg_difficulty", "_last.*")
    )


# --- review schedule ---------------------------------------------------------------


def review_schedule(outcomes: DataFrame, split: bool = True) -> DataFrame:
    """Streak, seen count and next review after every outcome.

    The streak is the number of hits minus the hits at the last miss: a running sum and a
    running max, so no order-dependent fold is needed.
    """
    rows = running(
        outcomes,
        SKILL,
        ["mission_no"],
        {"_hits": ("sum", F.col("correct").cast("bigint")), "seen_count": ("sum", F.lit(1).cast("bigint"))},
        split,
    )
    rows = running(rows, SKILL, ["mission_no"], {"_base": ("max", F.when(~F.col("correct"), F.col("_hits")))}, split)
    rows = rows.withColumn("streak", F.col("_hits") - F.coalesce("_base", F.lit(0))).drop("_hits", "_base")
    wait = F.when(F.col("correct"), S.review_interval_ms("streak")).otherwise(F.lit(K.WRONG_REVIEW_MS))
    return rows.withColumn("next_review_at", F.col("now_ms") + wait)


def latest_schedule(outcomes: DataFrame, split: bool = True) -> DataFrame:
    schedule = review_schedule(outcomes, split)
    return schedule.groupBy(*SKILL).agg(
        F.max_by(F.struct("streak", "next_review_at", "seen_count"), "mission_no").alias("_s")
    ).select(*SKILL, "_s.*")


def reviewed_skills(outcomes: DataFrame, split: bool = True) -> DataFrame:
    """Per mission: how many of its skills were due before it (unseen skills are due)."""
    schedule = review_schedule(outcomes, split)
    linked = neighbour(
        schedule, SKILL, "mission_no", {"due": F.col("next_review_at")}, forward=False, split=split, name="prev"
    )
    due = F.coalesce(F.col("prev.due") <= F.col("now_ms"), F.lit(True))
    return linked.groupBy("learner_id", "block", "mission_no").agg(F.count_if(due).alias("reviewed_skills"))


# --- mastery -----------------------------------------------------------------------


def mastery_gain(correct="correct", difficulty="difficulty", target="target_difficulty") -> Column:
    up = F.greatest(F.lit(0), F.col(difficulty) - F.col(target)) * 2 + 6
    return F.when(F.col(correct), up).otherwise(-(F.col(difficulty) * 2 + 10)).cast("double")


def mastery_walk(outcomes: DataFrame) -> DataFrame:
    """Mastery after all outcomes on the recorded targets.

    A run of clamped steps is itself one step x -> clamp(x + shift, low, high). Each block
    is reduced to these three numbers and the blocks are composed in order.
    """
    steps = F.array_sort(F.collect_list(F.struct("mission_no", mastery_gain().alias("gain"))))
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(0.0).alias("low"), F.lit(100.0).alias("high"))

    def add(acc, step):
        return F.struct(
            (acc.shift + step.gain).alias("shift"),
            S.clamp(acc.low + step.gain, 0.0, 100.0).alias("low"),
            S.clamp(acc.high + step.gain, 0.0, 100.0).alias("high"),
        )

    blocks = outcomes.groupBy(*SKILL_BLOCK).agg(F.aggregate(steps, start, add).alias("b"))
    in_order = F.array_sort(F.collect_list(F.struct("block", "b")))
    return blocks.groupBy(*SKILL).agg(
        F.aggregate(
            in_order,
            F.lit(K.DEFAULT_MASTERY),
            lambda x, e: F.greatest(e.b.low, F.least(e.b.high, x + e.b.shift)),
        ).alias("mastery")
    )


def densify(learners: DataFrame, catalogue: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """Every subject skill of each (learner, subject), unseen skills with defaults.

    One row per learner and skill is the result itself; the catalogue is broadcast if its
    counted size allows.
    """
    skills = catalogue.select("subject", "skill_id", "skill_ordinal")
    every = learners.join(broadcast_checked(skills), "subject").select("learner_id", "subject", "skill_id", "skill_ordinal")
    return (
        every.join(states, SKILL, "left")
        .withColumn("mastery", F.coalesce("mastery", F.lit(K.DEFAULT_MASTERY)))
        .withColumn("streak", F.coalesce("streak", F.lit(0)))
        .withColumn("next_review_at", F.coalesce("next_review_at", F.lit(now_ms)))
        .withColumn("seen_count", F.coalesce("seen_count", F.lit(0)))
    )


def learner_subjects(learners: DataFrame) -> DataFrame:
    subjects = F.array(*[F.lit(s) for s in K.SUBJECTS])
    return learners.select("learner_id", F.explode(subjects).alias("subject"))


def subject_mastery(mastery: DataFrame, catalogue: DataFrame, learners: DataFrame) -> DataFrame:
    """Mean mastery over all skills of a subject; an unseen skill counts 45, so only the
    number of skills is needed and nothing is densified."""
    sizes = catalogue.groupBy("subject").agg(F.count("*").alias("n_skills"))
    sums = mastery.groupBy("learner_id", "subject").agg(F.sum("mastery").alias("_sum"), F.count("*").alias("_seen"))
    every = learner_subjects(learners).join(F.broadcast(sizes), "subject", "left")
    joined = every.join(sums, ["learner_id", "subject"], "left")
    n = F.coalesce("n_skills", F.lit(0))
    total = F.coalesce("_sum", F.lit(0.0)) + (n - F.coalesce("_seen", F.lit(0))) * K.DEFAULT_MASTERY
    return joined.withColumn(
        "avg_mastery", F.when(n == 0, F.lit(K.DEFAULT_MASTERY)).otherwise(total / n)
    ).select("learner_id", "subject", "avg_mastery", S.js_round("avg_mastery").alias("mastery"))


# --- misconceptions ----------------------------------------------------------------

# Per tag and block: priority and resolved streak at the end, and what the block did to the
# counters: errors added, recent errors as the step r -> max(rec_floor, r + rec_add), and how often
# it was eased since its last error (or the block's start).
_TAG_STATE = (
    "array<struct<tag:string,priority:double,resolved:bigint,errors:bigint,"
    "rec_add:bigint,rec_floor:bigint,last_ms:bigint,last_error:boolean,eased:bigint>>"
)


_TAG_VALUE = "struct<ordinal:int,priority:double,resolved:bigint>"  # what a later block needs


def _tag_row(tag, priority, resolved, errors, rec_add, rec_floor, last_ms, last_error, eased) -> Column:
    return F.struct(
        tag.alias("tag"),
        priority.alias("priority"),
        resolved.alias("resolved"),
        errors.alias("errors"),
        rec_add.alias("rec_add"),
        rec_floor.alias("rec_floor"),
        last_ms.alias("last_ms"),
        last_error.alias("last_error"),
        eased.alias("eased"),
    )


def _fold_block() -> Column:
    """Tag states after the block's ``events``, from ``state`` (one part per tag), in the order
    in which the tags were first seen."""
    zero, true, false = F.lit(0).cast("bigint"), F.lit(True), F.lit(False)
    none = F.lit(None).cast("bigint")
    seen = F.array_sort(F.transform("state", lambda s: F.struct(s.value.ordinal.alias("ordinal"), s.part.alias("tag"), s.value.alias("value"))))
    start = F.transform(
        F.coalesce(seen, F.array()),
        lambda s: _tag_row(s.tag, s.value.priority, s.value.resolved, zero, zero, zero, none, false, zero),
    ).cast(_TAG_STATE)

    def error(e, priority, errors, rec_add, rec_floor):
        raised = priority + F.lit(12.0) * (F.lit(1.0) + e.difficulty * F.lit(0.2))
        return _tag_row(
            e.error_tag, S.clamp(raised, 0.0, 100.0), zero, errors + 1, rec_add + 1, rec_floor + 1, e.now_ms, true, zero
        )

    def decay(e, s):
        resolved = s.resolved + 1
        eased = S.clamp(s.priority - (F.lit(6.0) + resolved * 2), 0.0, 100.0)
        floor = F.greatest(zero, s.rec_floor - 1)
        return _tag_row(s.tag, eased, resolved, s.errors, s.rec_add - 1, floor, e.now_ms, false, s.eased + 1)

    def step(state, e):
        priorities = F.transform(state, lambda s: s.priority)
        top = F.array_position(priorities, F.array_max(priorities)) - 1
        eased = F.transform(state, lambda s, i: F.when(i == top, decay(e, s)).otherwise(s))
        known = F.exists(state, lambda s: s.tag == e.error_tag)
        raised = F.transform(
            state,
            lambda s: F.when(
                s.tag == e.error_tag, error(e, s.priority, s.errors, s.rec_add, s.rec_floor)
            ).otherwise(s),
        )
        added = F.concat(state, F.array(error(e, F.lit(0.0), zero, zero, zero)))
        return (
            F.when(e.correct, eased)
            .when(e.error_tag.isNull(), state)
            .when(known, raised)
            .otherwise(added)
            .cast(_TAG_STATE)
        )

    return F.aggregate("events", start, step)


def _block_ends(outcomes: DataFrame, starts: DataFrame | None) -> DataFrame:
    events = F.array_sort(F.collect_list(F.struct("mission_no", "correct", "error_tag", "difficulty", "now_ms")))
    blocks = outcomes.groupBy(*SKILL_BLOCK).agg(events.alias("events"))
    if starts is None:
        blocks = blocks.withColumn("state", F.lit(None).cast(STATE.format(_TAG_VALUE)))
    else:
        blocks = blocks.join(starts.hint("merge"), SKILL_BLOCK, "left")  # small files of many rows: no broadcast
    return blocks.select(*SKILL_BLOCK, _fold_block().alias("tags"))


def misconception_fold(outcomes: DataFrame) -> DataFrame:
    """Misconception state per (learner, subject, skill, tag) after all outcomes.

    A wrong answer raises its tag; a right one eases the skill's highest-priority tag.
    Which tag is eased depends on the past, so blocks are chained by ``fold_blocks``; the
    chained state is only order, priority and resolved streak, counters are merged afterwards.
    """

    def run(rows, starts):
        touched = _block_ends(rows, starts).select(*SKILL_BLOCK, F.posexplode("tags").alias("ordinal", "t"))
        priority = F.col("t.priority")  # at 0, easing changes nothing until an error starts anew
        resolved = F.when(priority > 0, F.col("t.resolved")).otherwise(F.lit(0).cast("bigint"))
        value = F.struct("ordinal", priority.alias("priority"), resolved.alias("resolved"))
        return touched.where("t.last_ms is not null").select(*SKILL_BLOCK, F.col("t.tag").alias("part"), value.alias("value"))

    starts = fold_blocks(outcomes, SKILL, run, _TAG_VALUE)
    ends = _block_ends(outcomes, starts).select(
        *SKILL_BLOCK, F.posexplode("tags").alias("ordinal", "t")
    ).select(*SKILL_BLOCK, "ordinal", "t.*")
    walk = F.array_sort(F.collect_list(F.struct("block", "rec_add", "rec_floor", "errors", "eased")))
    merged = ends.groupBy(*SKILL, "tag").agg(
        F.max_by(F.struct("ordinal", "priority"), "block").alias("_end"),
        F.aggregate(
            walk, F.lit(0).cast("bigint"), lambda r, b: F.when(b.errors > 0, b.eased).otherwise(r + b.eased)
        ).alias("resolved_streak"),
        F.sum("errors").alias("error_count"),
        F.aggregate(walk, F.lit(0).cast("bigint"), lambda r, b: F.greatest(b.rec_floor, r + b.rec_add)).alias(
            "recent_error_count"
        ),
        F.max("last_ms").alias("last_seen_at"),
        F.max_by("last_error", F.when(F.col("last_ms").isNotNull(), F.col("block"))).alias("_last_error"),
    )
    wait = F.when(F.col("_last_error"), S.error_interval_ms("recent_error_count")).otherwise(K.RESOLVE_INTERVAL_MS)
    return merged.withColumn("due_at", F.col("last_seen_at") + wait).select(
        *SKILL, "tag", "_end.*", "resolved_streak", "error_count", "recent_error_count", "due_at", "last_seen_at"
    )


def last_error_tags(outcomes: DataFrame) -> DataFrame:
    wrong = outcomes.where(~F.col("correct") & F.col("error_tag").isNotNull())
    return wrong.groupBy(*SKILL).agg(F.max_by("error_tag", "mission_no").alias("last_error_tag"))


def unresolved_index(misconceptions: DataFrame, learners: DataFrame) -> DataFrame:
    """Mean of the two highest priorities per (learner, subject) / 100; 0 without any."""
    top = top_rows(misconceptions, ["learner_id", "subject"], [F.desc("priority")], 2)
    means = top.groupBy("learner_id", "subject").agg((F.sum("priority") / F.count("*") / 100).alias("_mean"))
    return (
        learner_subjects(learners)
        .join(means, ["learner_id", "subject"], "left")
        .select(
            "learner_id", "subject", S.to_fixed(F.coalesce("_mean", F.lit(0.0)), 3).alias("unresolved_index")
        )
    )


def due_misconceptions(misconceptions: DataFrame, now_ms: int) -> DataFrame:
    return misconceptions.where((F.col("priority") >= K.CANDIDATE_PRIORITY) & (F.col("due_at") <= now_ms))


def stale_misconceptions(misconceptions: DataFrame, now_ms: int, days: int = 60) -> DataFrame:
    return misconceptions.where(F.col("last_seen_at") <= now_ms - days * K.DAY_MS)


def due_skills(dense: DataFrame, now_ms: int) -> DataFrame:
    """Due for the mission builder: unseen skills are due as well."""
    return dense.where(F.col("next_review_at") <= now_ms)


def due_review_counts(states: DataFrame, learners: DataFrame, now_ms: int) -> DataFrame:
    """Due for display: only skills that were seen."""
    due = states.where((F.col("seen_count") > 0) & (F.col("next_review_at") <= now_ms))
    counts = due.groupBy("learner_id", "subject").agg(F.count("*").alias("due"))
    return (
        learner_subjects(learners)
        .join(counts, ["learner_id", "subject"], "left")
        .withColumn("due", F.coalesce("due", F.lit(0)))
    )


def skill_states(outcomes: DataFrame, split: bool = True) -> DataFrame:
    """Mastery (recorded targets), streak, next review and seen count per (learner, skill)."""
    return mastery_walk(outcomes).join(latest_schedule(outcomes, split), SKILL)
