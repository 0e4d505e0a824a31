"""Skill state queries: schedule, mastery, misconceptions, difficulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnloom.functions import scalars as S
from learnloom.operators import missions as M
from learnloom.operators import skills as SK
from learnloom.plans.oracle import MISSIONS, NOW, OUTCOMES, sql_list, with_log
from learnloom.plans.registry import query
from learnloom.sources.testdata import NOW_MS
from learnloom import constants as K

SCHEDULE = f"""schedule AS MATERIALIZED (
  SELECT *, now_ms + CASE WHEN correct THEN {K.REVIEW_LADDER_MS}[least(streak, 5) + 1] ELSE {K.WRONG_REVIEW_MS} END AS next_review_at
  FROM (SELECT *, count(*) OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no) AS seen_count,
      CASE WHEN correct THEN row_number() OVER (PARTITION BY learner_id, skill_id, misses ORDER BY mission_no)
        - CASE WHEN misses > 0 THEN 1 ELSE 0 END ELSE 0 END AS streak
    FROM (SELECT *, count(*) FILTER (NOT correct) OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no) AS misses
      FROM outcomes)))"""

LATEST = """latest AS MATERIALIZED (
  SELECT * FROM schedule QUALIFY row_number() OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no DESC) = 1)"""

STEPS = """steps AS MATERIALIZED (
  SELECT learner_id, subject, skill_id, mission_no, correct, error_tag, difficulty, target_difficulty, now_ms,
    row_number() OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no) AS n FROM outcomes)"""

MASTERY = """walk AS (
  SELECT DISTINCT learner_id, skill_id, 0::BIGINT AS n, 45.0::DOUBLE AS mastery FROM steps
  UNION ALL
  SELECT w.learner_id, w.skill_id, s.n, greatest(0.0::DOUBLE, least(100.0::DOUBLE, w.mastery + CASE WHEN s.correct
    THEN 6 + 2 * greatest(0, s.difficulty - s.target_difficulty) ELSE -(10 + 2 * s.difficulty) END))
  FROM walk w JOIN steps s ON s.learner_id = w.learner_id AND s.skill_id = w.skill_id AND s.n = w.n + 1),
mastery AS MATERIALIZED (
  SELECT learner_id, subject, skill_id, mastery FROM walk
  JOIN (SELECT learner_id, subject, skill_id, max(n) AS n FROM steps GROUP BY ALL) USING (learner_id, skill_id, n))"""

# One row per (learner, skill) and step; the tag states are a list in first-seen order.
FOLD = """fold AS (
  SELECT DISTINCT learner_id, skill_id, 0::BIGINT AS n,
    []::STRUCT(tag VARCHAR, ec BIGINT, rc BIGINT, rs BIGINT, p DOUBLE, due BIGINT, seen BIGINT)[] AS st FROM steps
  UNION ALL
  SELECT f.learner_id, f.skill_id, s.n, CASE
    WHEN s.correct THEN list_transform(f.st, lambda x, i: CASE
      WHEN i = list_position(list_transform(f.st, lambda y: y.p), list_max(list_transform(f.st, lambda y: y.p)))
      THEN {'tag': x.tag, 'ec': x.ec, 'rc': greatest(0, x.rc - 1), 'rs': x.rs + 1,
            'p': greatest(0.0::DOUBLE, x.p - (6 + 2 * (x.rs + 1))), 'due': s.now_ms + 28800000, 'seen': s.now_ms}
      ELSE x END)
    WHEN s.error_tag IS NULL THEN f.st
    ELSE list_transform(
      CASE WHEN list_contains(list_transform(f.st, lambda y: y.tag), s.error_tag) THEN f.st
        ELSE list_append(f.st, {'tag': s.error_tag, 'ec': 0::BIGINT, 'rc': 0::BIGINT, 'rs': 0::BIGINT, 'p': 0.0::DOUBLE,
          'due': 0::BIGINT, 'seen': 0::BIGINT}) END,
      lambda x: CASE WHEN x.tag = s.error_tag
      THEN {'tag': x.tag, 'ec': x.ec + 1, 'rc': x.rc + 1, 'rs': 0::BIGINT,
            'p': least(100.0::DOUBLE, x.p + 12.0::DOUBLE * (1.0::DOUBLE + s.difficulty * 0.2::DOUBLE)),
            'due': s.now_ms + CAST(least(180000 * pow(2.0::DOUBLE, x.rc), 86400000) AS BIGINT), 'seen': s.now_ms}
      ELSE x END) END
  FROM fold f JOIN steps s ON s.learner_id = f.learner_id AND s.skill_id = f.skill_id AND s.n = f.n + 1),
misconceptions AS MATERIALIZED (
  SELECT learner_id, subject, skill_id, t.tag AS tag, ordinal - 1 AS ordinal, t.ec AS error_count, t.rc AS recent_error_count,
    t.rs AS resolved_streak, t.p AS priority, t.due AS due_at, t.seen AS last_seen_at
  FROM (SELECT learner_id, subject, skill_id, unnest(st) AS t, generate_subscripts(st, 1) AS ordinal FROM fold
    JOIN (SELECT learner_id, subject, skill_id, max(n) AS n FROM steps GROUP BY ALL) USING (learner_id, skill_id, n)))"""

SUBJECTS = f"""learner_subjects AS (
  SELECT learner_id, subject FROM (SELECT DISTINCT learner_id FROM log), (SELECT unnest({sql_list(K.SUBJECTS)}) AS subject)),
catalogue AS (SELECT subject, skill_id, min(ordinal) AS skill_ordinal FROM bank GROUP BY ALL)"""

DENSE = f"""dense AS MATERIALIZED (
  SELECT l.learner_id, l.subject, c.skill_id, c.skill_ordinal, coalesce(m.mastery, 45.0) AS mastery,
    coalesce(s.streak, 0) AS streak, coalesce(s.next_review_at, {NOW}) AS next_review_at, coalesce(s.seen_count, 0) AS seen_count
  FROM learner_subjects l JOIN catalogue c USING (subject)
  LEFT JOIN mastery m ON m.learner_id = l.learner_id AND m.skill_id = c.skill_id
  LEFT JOIN latest s ON s.learner_id = l.learner_id AND s.skill_id = c.skill_id)"""

INDEXES = """indexes AS MATERIALIZED (
  SELECT learner_id, subject, coalesce(floor(p / 100 * 1000 + 0.5) / 1000, 0) AS unresolved_index
  FROM learner_subjects LEFT JOIN (SELECT learner_id, subject, avg(priority) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY learner_id, subject ORDER BY priority DESC) AS rn FROM misconceptions)
    WHERE rn <= 2 GROUP BY ALL) USING (learner_id, subject)),
averages AS MATERIALIZED (
  SELECT learner_id, subject, avg(mastery) AS avg_mastery, CAST(floor(avg(mastery) + 0.5) AS BIGINT) AS mastery
  FROM dense GROUP BY ALL)"""

BASE = (MISSIONS, OUTCOMES)
STATE = (*BASE, SCHEDULE, LATEST, STEPS, MASTERY, FOLD, SUBJECTS, DENSE, INDEXES)


def state_sql(body: str, *extra: str) -> str:
    return with_log(body, *STATE, *extra, recursive=True)


def learners(t):
    return t.log.select("learner_id").distinct()


@query(
    "skill_outcomes",
    with_log("SELECT learner_id, mission_no, skill_id, correct, error_tag, now_ms FROM outcomes", *BASE),
)
def skill_outcomes(t):
    return SK.skill_outcomes(t.log).select("learner_id", "mission_no", "skill_id", "correct", "error_tag", "now_ms")


@query(
    "review_schedule",
    with_log("SELECT learner_id, mission_no, skill_id, streak, seen_count, next_review_at FROM schedule", *BASE, SCHEDULE),
)
def review_schedule(t):
    return SK.review_schedule(t.outcomes, t.split).select(
        "learner_id", "mission_no", "skill_id", "streak", "seen_count", "next_review_at"
    )


@query("mastery_walk", with_log("SELECT * FROM mastery", *BASE, STEPS, MASTERY, recursive=True))
def mastery_walk(t):
    return SK.mastery_walk(t.outcomes)


@query("misconception_fold", with_log("SELECT * FROM misconceptions", *BASE, STEPS, FOLD, recursive=True))
def misconception_fold(t):
    return SK.misconception_fold(t.outcomes)


@query(
    "last_error_tags",
    with_log(
        """SELECT learner_id, subject, skill_id, error_tag AS last_error_tag FROM outcomes
        WHERE NOT correct AND error_tag IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no DESC) = 1""",
        *BASE,
    ),
)
def last_error_tags(t):
    return SK.last_error_tags(t.outcomes)


@query("unresolved_index", state_sql("SELECT * FROM indexes"))
def unresolved_index(t):
    return SK.unresolved_index(t.misconceptions, learners(t))


@query("subject_mastery", state_sql("SELECT * FROM averages"))
def subject_mastery(t):
    return SK.subject_mastery(t.skill_states, t.catalogue, learners(t))


@query(
    "skill_dense",
    state_sql("SELECT learner_id, subject, skill_id, mastery, streak, next_review_at, seen_count FROM dense"),
)
def skill_dense(t):
    return dense(t).drop("skill_ordinal")


def dense(t):
    return SK.densify(SK.learner_subjects(learners(t)), t.catalogue, t.skill_states, NOW_MS)


@query(
    "due_skills",
    state_sql(f"SELECT learner_id, subject, skill_id FROM dense WHERE next_review_at <= {NOW}"),
)
def due_skills(t):
    return SK.due_skills(dense(t), NOW_MS).select("learner_id", "subject", "skill_id")


@query(
    "due_reviews",
    state_sql(
        f"""SELECT learner_id, subject, count(s.skill_id) AS due FROM learner_subjects l
        LEFT JOIN (SELECT * FROM latest WHERE next_review_at <= {NOW}) s USING (learner_id, subject) GROUP BY ALL"""
    ),
)
def due_reviews(t):
    return SK.due_review_counts(t.skill_states, learners(t), NOW_MS)


@query(
    "due_misconceptions",
    state_sql(f"SELECT learner_id, skill_id, tag, priority, due_at FROM misconceptions WHERE priority >= 25 AND due_at <= {NOW}"),
)
def due_misconceptions(t):
    found = SK.due_misconceptions(t.misconceptions, NOW_MS)
    return found.select("learner_id", "skill_id", "tag", "priority", "due_at")


@query(
    "stale_misconceptions",
    state_sql(f"SELECT learner_id, skill_id, tag, last_seen_at FROM misconceptions WHERE last_seen_at <= {NOW} - 10 * 86400000"),
)
def stale_misconceptions(t):
    """Ten days instead of sixty: the test log is thirty days long."""
    return SK.stale_misconceptions(t.misconceptions, NOW_MS, 10).select(
        "learner_id", "skill_id", "tag", "last_seen_at"
    )


@query(
    "stale_misconceptions_60",
    state_sql(f"SELECT learner_id, skill_id, tag, last_seen_at FROM misconceptions WHERE last_seen_at <= {NOW} - 60::BIGINT * 86400000"),
)
def stale_misconceptions_60(t):
    return SK.stale_misconceptions(t.misconceptions, NOW_MS).select("learner_id", "skill_id", "tag", "last_seen_at")


@query(
    "reviewed_skills",
    with_log(
        """SELECT learner_id, mission_no, count(*) FILTER (prev IS NULL OR prev <= now_ms) AS reviewed_skills
        FROM (SELECT *, lag(next_review_at) OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no) AS prev FROM schedule)
        GROUP BY ALL""",
        *BASE,
        SCHEDULE,
    ),
)
def reviewed_skills(t):
    return SK.reviewed_skills(t.outcomes, t.split).drop("block")


def gated_missions(t):
    """Every mission with the learner's present mastery and unresolved index."""
    gates = SK.subject_mastery(t.skill_states, t.catalogue, learners(t)).join(
        SK.unresolved_index(t.misconceptions, learners(t)), ["learner_id", "subject"]
    )
    return M.mission_score(t.log).join(gates, ["learner_id", "subject"])


NEXT = """gated AS (
  SELECT *, accuracy >= 0.8 AND avg_mastery >= 55 AND avg_difficulty >= target_difficulty - 0.25 AND mode <> 'review' AS strong,
    accuracy <= 0.4 OR unresolved_index >= 0.65 AS weak
  FROM missions JOIN averages USING (learner_id, subject) JOIN indexes USING (learner_id, subject))"""


@query(
    "next_difficulty",
    state_sql(
        """SELECT learner_id, mission_no, target_difficulty AS before, greatest(1, least(5, target_difficulty
          + CASE WHEN strong AND unresolved_index <= 0.35 THEN 1 ELSE 0 END - CASE WHEN weak THEN 1 ELSE 0 END)) AS after
        FROM gated""",
        NEXT,
    ),
)
def next_difficulty(t):
    after = S.next_difficulty(
        "target_difficulty", "accuracy", "avg_mastery", "unresolved_index", "avg_difficulty", "mode"
    )
    return gated_missions(t).select("learner_id", "mission_no", F.col("target_difficulty").alias("before"), after.alias("after"))


@query(
    "blocked_promotions",
    state_sql(
        """SELECT learner_id, subject, count(*) AS missions, count(*) FILTER (strong AND unresolved_index > 0.35) AS blocked
        FROM gated GROUP BY ALL""",
        NEXT,
    ),
)
def blocked_promotions(t):
    from learnloom.operators import quality

    return quality.blocked_promotions(gated_missions(t))
