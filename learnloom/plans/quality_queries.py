"""Quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnloom.functions import scalars as S
from learnloom.operators import diagnostics as D
from learnloom.operators import missions as M
from learnloom.operators import quality as Q
from learnloom.plans.oracle import MISSIONS, with_log
from learnloom.plans.registry import query
from learnloom.plans.replay_queries import folded
from learnloom.plans.skill_queries import BASE, FOLD, STEPS


@query(
    "quality_rates",
    with_log(
        """SELECT subject, count(*) AS wrong, count(*) FILTER (error_tag = 'unknown_guess') / count(*) AS unknown_share,
        count(*) FILTER (error_tag <> 'unknown_guess') / count(*) AS classified_share FROM log WHERE NOT correct GROUP BY ALL"""
    ),
)
def quality_rates(t):
    return Q.unknown_share(t.log)


@query(
    "fallback_share",
    with_log(
        """SELECT subject, count(*) AS answers, count(*) FILTER (wrong_choice_tags IS NULL) / count(*) AS fallback_share
        FROM log GROUP BY ALL"""
    ),
)
def fallback_share(t):
    return Q.fallback_share(t.log, t.bank)


@query(
    "duplicate_serves",
    with_log(
        """SELECT learner_id, subject, count(*) AS served, count(DISTINCT question_id) AS distinct_questions,
        1 - count(DISTINCT question_id) / count(*) AS duplicate_rate FROM log GROUP BY ALL"""
    ),
)
def duplicate_serves(t):
    return Q.duplicate_serve_rate(t.log)


@query(
    "difficulty_alignment",
    with_log(
        """SELECT learner_id, subject, count(*) AS missions, floor(avg(abs(target_difficulty - avg_difficulty)) * 1000000 + 0.5)
        / 1000000 AS mean_gap FROM missions GROUP BY ALL""",
        MISSIONS,
    ),
)
def difficulty_alignment(t):
    return Q.difficulty_alignment(M.mission_score(t.log))


@query(
    "remediation_hits",
    with_log(
        """SELECT tag, count(*) AS served, count(*) FILTER (correct) AS hits, count(*) FILTER (correct) / count(*) AS hit_rate
        FROM (SELECT correct, unnest(list_distinct(list_filter(wrong_choice_tags, lambda x: x IS NOT NULL))) AS tag FROM log)
        GROUP BY ALL"""
    ),
)
def remediation_hits(t):
    return Q.remediation_hits(t.log, t.bank)


@query(
    "recurrence_in_missions",
    with_log(
        """SELECT e.subject, e.error_tag, count(*) AS errors, count(*) FILTER (again) AS recurrent,
          count(*) FILTER (again) / count(*) AS recurrence_rate
        FROM (SELECT *, EXISTS (SELECT 1 FROM errors x WHERE x.learner_id = e.learner_id AND x.subject = e.subject
          AND x.error_tag = e.error_tag AND x.mission_no > e.mission_no AND x.mission_no <= e.mission_no + 3) AS again FROM errors e) e
        GROUP BY ALL""",
        "errors AS MATERIALIZED (SELECT DISTINCT learner_id, subject, error_tag, mission_no FROM log WHERE NOT correct AND error_tag IS NOT NULL)",
    ),
)
def recurrence_in_missions(t):
    return Q.recurrence_in_missions(t.log, 3, t.split)


@query(
    "item_stats",
    with_log(
        """SELECT subject, question_id, count(*) AS served, count(*) FILTER (NOT correct) / count(*) AS error_rate
        FROM log GROUP BY ALL ORDER BY served DESC, error_rate DESC, question_id LIMIT 200"""
    ),
)
def item_stats(t):
    return Q.item_stats(t.log)


REACH = """own AS MATERIALIZED (
  SELECT learner_id, subject, mission_no, row_number() OVER (PARTITION BY learner_id, subject ORDER BY mission_no) AS subject_no
  FROM (SELECT DISTINCT learner_id, subject, mission_no FROM log)),
tag_served AS MATERIALIZED (
  SELECT DISTINCT learner_id, subject, subject_no, mission_no, tag FROM (
    SELECT learner_id, subject, mission_no, unnest(list_filter(wrong_choice_tags, lambda x: x IS NOT NULL)) AS tag FROM log)
  JOIN own USING (learner_id, subject, mission_no)),
raised AS MATERIALIZED (
  SELECT DISTINCT s.learner_id, s.subject, s.error_tag AS tag, s.mission_no, s.now_ms AS at_ms
  FROM fold f JOIN steps s USING (learner_id, skill_id, n)
  WHERE NOT s.correct AND list_filter(f.st, lambda x: x.tag = s.error_tag)[1].p >= 25),
reach AS MATERIALIZED (
  SELECT w.learner_id, w.subject, w.tag, w.mission_no, w.at_ms, EXISTS (SELECT 1 FROM tag_served s WHERE s.learner_id = w.learner_id
    AND s.subject = w.subject AND s.tag = w.tag AND s.subject_no > w2.subject_no AND s.subject_no <= w2.subject_no + 2) AS reached
  FROM raised w JOIN own w2 USING (learner_id, subject, mission_no))"""
REACH_PARTS = (*BASE, STEPS, FOLD, REACH)


def reach(t):
    return Q.reserve_reach(t.log, Q.high_priority_errors(t.outcomes, folded(t)), split=t.split)


def reach_sql(body):
    return with_log(body, *REACH_PARTS, recursive=True)


@query("reserve_events", reach_sql("SELECT * FROM reach"))
def reserve_events(t):
    return reach(t)


@query(
    "reserve_reach",
    reach_sql(
        "SELECT subject, tag, count(*) AS events, count(*) FILTER (reached) / count(*) AS reach_rate FROM reach GROUP BY ALL"
    ),
)
def reserve_reach(t):
    return Q.reach_by_tag(reach(t))


def gap_sql(points: int) -> str:
    return reach_sql(
        f"""SELECT strftime(week, '%Y-%m-%d') AS week, left_rate, right_rate, gap_points, wide,
          wide AND coalesce(lag(wide) OVER (ORDER BY week) AND week - lag(week) OVER (ORDER BY week) = 7, false) AS split_thresholds
        FROM (SELECT *, coalesce(gap_points >= {points}, false) AS wide FROM (
          SELECT *, floor(abs(left_rate - right_rate) * 100 * 1000000 + 0.5) / 1000000 AS gap_points FROM (
            SELECT CAST(date_trunc('week', make_timestamp(at_ms * 1000)) AS DATE) AS week,
              count(*) FILTER (subject = 'math' AND reached) / nullif(count(*) FILTER (subject = 'math'), 0) AS left_rate,
              count(*) FILTER (subject = 'japanese' AND reached) / nullif(count(*) FILTER (subject = 'japanese'), 0) AS right_rate
            FROM reach GROUP BY ALL)))"""
    )


@query("subject_gap", gap_sql(2))
def subject_gap(t):
    """Two points instead of fifteen, so that the test data has wide weeks."""
    return Q.subject_gap(reach(t), points=2.0)


@query("subject_gap_15", gap_sql(15))
def subject_gap_15(t):
    return Q.subject_gap(reach(t))


@query(
    "daily_divergence",
    with_log(
        """SELECT learner_id, play_day AS date, floor(abs(CAST(sum(correct) AS BIGINT) / CAST(sum(total) AS BIGINT) - avg(accuracy))
        * 1000000 + 0.5) / 1000000 AS divergence FROM rewarded GROUP BY ALL""",
        MISSIONS,
    ),
)
def daily_divergence(t):
    dated = M.mission_summary(t.log).withColumn("date", S.play_date(F.timestamp_millis("finished_ms")))
    return Q.daily_divergence(D.daily_stats(t.log), dated)


@query(
    "session_outcomes",
    with_log("SELECT learner_id, mission_no, pos, question_id, correct, error_tag FROM log"),
)
def session_outcomes(t):
    """Missions as nested sessions (arrays of questions, answers, traces), zipped by position."""
    at_pos = lambda item: F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda e: e.x)
    question = F.struct("question_id", "skill_id", "difficulty", "answer_index")
    sessions = t.log.groupBy(*M.MISSION).agg(
        at_pos(question).alias("questions"),
        at_pos(F.col("selected_index")).alias("answers"),
        at_pos(F.struct("error_tag")).alias("traces"),
    )
    return M.evaluate_sessions(sessions).select("learner_id", "mission_no", "pos", "question_id", "correct", "error_tag")
