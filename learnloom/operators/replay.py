"""Replay of the adaptive loop: target difficulty and mastery depend on each other.

Mastery gain reads the target, and the next target reads the mastery after the mission, so
this part is a true fold per (learner, subject). Everything else of a mission result
(streaks, review times, seen counts, rewards, tags, badges) follows from windows and joins
on the fold's output.
"""

from __future__ import annotations

import json
import math
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from learnloom import constants as K
from learnloom.functions import scalars as S
from learnloom.operators import missions as M
from learnloom.operators import skills as SK
from learnloom.operators.sequence import fold_blocks
from learnloom.session import hash_spread

KEYS = ["learner_id", "subject"]
BLOCK = [*KEYS, "block"]
FOLD_SCHEMA = (
    "learner_id long, subject string, block long, mission_no long, skill_id string, mastery double, "
    "before_difficulty int, after_difficulty int, avg_mastery double, unresolved_index double, error_priority double"
)


def answer_step(skill: dict, correct: bool, difficulty: int, tag: str | None, target: int) -> dict:
    """New state of a skill after one answer: mastery and [tag, priority, resolved] rows."""
    tags = [list(row) for row in skill["tags"]]
    if correct:
        gain = 6 + 2 * max(0, difficulty - target)
        if tags:
            top = max(range(len(tags)), key=lambda i: (tags[i][1], -i))
            tags[top][2] += 1
            tags[top][1] = min(100.0, max(0.0, tags[top][1] - (6.0 + tags[top][2] * 2)))
    else:
        gain = -(10 + 2 * difficulty)
        if tag is not None:
            row = next((r for r in tags if r[0] == tag), None)
            if row is None:
                row = [tag, 0.0, 0]
                tags.append(row)
            row[1] = min(100.0, max(0.0, row[1] + 12.0 * (1.0 + difficulty * 0.2)))
            row[2] = 0
    return {"mastery": min(100.0, max(0.0, skill["mastery"] + gain)), "tags": tags}


def half_up(value: float) -> int:
    return math.floor(value + 0.5)


def gates(skills: dict, n_skills: int) -> tuple[float, float]:
    """Average mastery over the catalogue and the unresolved index."""
    unseen = n_skills - len(skills)
    average = (sum(s["mastery"] for s in skills.values()) + unseen * K.DEFAULT_MASTERY) / n_skills
    top = sorted((row[1] for s in skills.values() for row in s["tags"]), reverse=True)[:2]
    index = half_up(sum(top) / len(top) / 100 * 1000) / 1000 if top else 0.0
    return average, index


def target_step(target: int, accuracy: float, average: float, index: float, served: float, mode: str) -> int:
    strong = (
        accuracy >= K.PROMOTE_ACCURACY
        and average >= K.PROMOTE_MASTERY
        and index <= K.PROMOTE_UNRESOLVED
        and served >= target - K.PROMOTE_DIFFICULTY_SLACK
        and mode != "review"
    )
    weak = accuracy <= K.DEMOTE_ACCURACY or index >= K.DEMOTE_UNRESOLVED
    return min(K.MAX_DIFFICULTY, max(K.MIN_DIFFICULTY, target + strong - weak))


_FOLD_COLUMNS = [
    "mission_no", "skill_id", "correct", "difficulty", "error_tag", "n_skills", "accuracy", "avg_difficulty", "mode",
]


TARGET = ""  # the part of a fold's state that holds the target
OF = "\t"  # skill and tag of a part that holds a tag; a part without it is a skill's mastery


def _load(state: str | None) -> tuple[int, dict]:
    """Target and skills from the parts of a state."""
    parts = {name: json.loads(value) for name, value in (json.loads(state) if state else {}).items()}
    target = parts.pop(TARGET, 1)
    skills = {name: {"mastery": value, "tags": []} for name, value in parts.items() if OF not in name}
    for name, (_, priority, resolved) in sorted(((n, v) for n, v in parts.items() if OF in n), key=lambda e: e[1][0]):
        skill, tag = name.split(OF)
        skills.setdefault(skill, {"mastery": K.DEFAULT_MASTERY, "tags": []})["tags"].append([tag, priority, resolved])
    return target, skills


def _fold(state: str | None, rows: str) -> tuple[dict[str, str], list[tuple]]:
    """Fold one block of outcomes (JSON, in order); returns the parts it touched and one row
    per outcome."""
    records = ([r.get(c) for c in _FOLD_COLUMNS] for r in json.loads(rows))
    target, skills = _load(state)
    touched, out = set(), []
    for mission_no, mission in groupby(records, key=itemgetter(0)):
        updated, raised = {}, {}
        for _, skill, correct, difficulty, tag, n_skills, accuracy, served, mode in mission:
            past = skills.get(skill, {"mastery": K.DEFAULT_MASTERY, "tags": []})
            tag = tag if not correct else None
            step = updated[skill] = answer_step(past, correct, difficulty, tag, target)
            raised[skill] = next((row[1] for row in step["tags"] if row[0] == tag), None)
            touched.add((skill, None))
            touched.update((skill, row[0]) for row in step["tags"] if row not in past["tags"])
        skills.update(updated)
        average, index = gates(skills, n_skills)
        after = target_step(target, accuracy, average, index, served, mode)
        out += [(mission_no, k, s["mastery"], target, after, average, index, raised[k]) for k, s in updated.items()]
        target = after
    ends = {TARGET: target}
    for skill, state_of in skills.items():
        if (skill, None) in touched:
            ends[skill] = state_of["mastery"]
        for ordinal, (tag, priority, resolved) in enumerate(state_of["tags"]):
            if (skill, tag) in touched:  # a tag at 0 has forgotten how often it was eased
                ends[skill + OF + tag] = [ordinal, priority, resolved if priority else 0]
    return {name: json.dumps(value) for name, value in ends.items()}, out


_ENDS = T.MapType(T.StringType(), T.StringType())
_ROW_NAMES = [c.split()[0] for c in FOLD_SCHEMA.split(", ") if c.split()[0] not in (*KEYS, "block")]
_ROW_TYPES = {"mission_no": T.LongType(), "skill_id": T.StringType(), "before_difficulty": T.IntegerType(), "after_difficulty": T.IntegerType()}
_ROWS = T.ArrayType(T.StructType([T.StructField(n, _ROW_TYPES.get(n, T.DoubleType())) for n in _ROW_NAMES]))


@F.pandas_udf(_ENDS)
def _ends(state: pd.Series, rows: pd.Series) -> pd.Series:
    return pd.Series([_fold(s, r)[0] for s, r in zip(state, rows)], dtype=object)


@F.pandas_udf(_ROWS)
def _rows(state: pd.Series, rows: pd.Series) -> pd.Series:
    folded = (_fold(s, r)[1] for s, r in zip(state, rows))
    return pd.Series([[dict(zip(_ROW_NAMES, row)) for row in out] for out in folded], dtype=object)


class Replay:
    """The fold of ``outcomes``, from an empty or a saved state (learner_id, subject, part, value).

    Spark gathers the outcomes of a (learner, subject, block), never of a whole learner; one
    Arrow batch then holds many of them. ``fold_blocks`` chains the blocks of learners that own
    several. Outcomes carry their mission's score, so with the bucketed table no shuffle
    precedes the fold.
    """

    def __init__(self, outcomes: DataFrame, catalogue: DataFrame, initial: DataFrame | None = None):
        sizes = catalogue.groupBy("subject").agg(F.count("*").alias("n_skills"))
        self.rows = outcomes.join(F.broadcast(sizes), "subject")  # one row per subject
        self.initial = initial
        self.starts = fold_blocks(self.rows, KEYS, self._run, initial=initial)

    def _with_starts(self, frame: DataFrame, starts: DataFrame | None) -> DataFrame:
        gathered = F.array_sort(F.collect_list(F.struct(*_FOLD_COLUMNS)))
        blocks = frame.groupBy(*BLOCK).agg(F.to_json(gathered).alias("rows"))
        if starts is None:
            return blocks.withColumn("state", F.lit(None).cast("string"))
        saved = starts.select(*BLOCK, F.to_json(F.map_from_entries("state")).alias("state"))
        # Python work is heavy per byte; the runtime would merge small partitions by size.
        # The files of the saved states are small for their rows: no broadcast.
        return hash_spread(blocks.join(saved.hint("merge"), BLOCK, "left"), BLOCK)

    def _run(self, frame: DataFrame, starts: DataFrame | None) -> DataFrame:
        return self._with_starts(frame, starts).select(*BLOCK, F.explode(_ends("state", "rows")).alias("part", "value"))

    def missions(self) -> DataFrame:
        """Mastery (and priority of the error's tag) per outcome; difficulty and gates per mission."""
        out = self._with_starts(self.rows, self.starts).select(*BLOCK, F.inline(_rows("state", "rows")))
        return out.select(*[c.split()[0] for c in FOLD_SCHEMA.split(", ")])

    def state(self) -> DataFrame:
        """(learner_id, subject, part, value) at the end: what the next run goes on from."""
        ends = self._run(self.rows, self.starts)
        if self.initial is not None:
            ends = ends.unionByName(self.initial.select(*KEYS, F.lit(-1).cast("bigint").alias("block"), "part", "value"))
        return ends.groupBy(*KEYS, "part").agg(F.max_by("value", "block").alias("value"))


def fold_missions(outcomes: DataFrame, catalogue: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``Replay.missions`` of all outcomes."""
    return Replay(outcomes, catalogue, initial).missions()


def replay_results(log: DataFrame, outcomes: DataFrame, folded: DataFrame, split: bool = True) -> DataFrame:
    """Mission results: score, difficulty change, rewards, review counts, top tags."""
    per_mission = folded.groupBy("learner_id", "block", "mission_no").agg(
        *[F.first(c).alias(c) for c in ("before_difficulty", "after_difficulty", "avg_mastery", "unresolved_index")]
    )
    change = ("before_difficulty", "after_difficulty")
    return (
        M.mission_summary(log)
        .join(per_mission, M.MISSION)
        .join(SK.reviewed_skills(outcomes, split), M.MISSION)
        .join(M.top2_misconceptions(log), M.MISSION, "left")
        .withColumn("earned_xp", S.mission_xp("correct", "total", "mode", *change, "avg_difficulty"))
        .withColumn("earned_stars", S.mission_stars("correct", "total", *change))
        .withColumn("avg_difficulty", S.to_fixed("avg_difficulty", 2))
    )


def replay_skill_state(outcomes: DataFrame, folded: DataFrame, split: bool = True) -> DataFrame:
    """Mastery, schedule and last error per (learner, skill)."""
    mastery = folded.groupBy(*SK.SKILL).agg(F.max_by("mastery", "mission_no").alias("mastery"))
    return (
        mastery.join(SK.latest_schedule(outcomes, split), SK.SKILL)
        .join(SK.last_error_tags(outcomes), SK.SKILL, "left")
    )


def replay_subject_state(folded: DataFrame) -> DataFrame:
    return folded.groupBy(*KEYS).agg(
        F.max_by("after_difficulty", "mission_no").alias("target_difficulty"),
        F.count_distinct("mission_no").alias("mission_count"),
    )


def replay_learner_state(results: DataFrame, split: bool = True) -> DataFrame:
    """Totals per learner: xp, level, stars, streak, last day and number of badges."""
    totals = results.groupBy("learner_id").agg(
        F.sum("earned_xp").alias("xp"), F.sum("earned_stars").alias("stars"), F.count("*").alias("missions")
    )
    days = M.day_streak(results.withColumn("date", S.play_date(F.timestamp_millis("finished_ms"))))
    last = days.groupBy("learner_id").agg(
        F.max("date").alias("last_played_date"), F.max_by("streak_days", "date").alias("streak_days")
    )
    badges = M.badge_unlocks(results, split).groupBy("learner_id").agg(
        F.array_sort(F.collect_list("badge_id")).alias("badges")
    )
    return (
        totals.join(last, "learner_id").join(badges, "learner_id").withColumn("level", S.level("xp"))
    )


def append_traces(committed: DataFrame, traces: DataFrame, n: int = K.LOG_RETENTION) -> DataFrame:
    """Append a finished mission's answers to the log and keep the last ``n`` per learner."""
    return M.recent_logs(committed.unionByName(traces), n).drop("rank")

