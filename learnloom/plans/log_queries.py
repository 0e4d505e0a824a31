"""Diagnosis, dashboard and mission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnloom import constants as K
from learnloom.functions import scalars as S
from learnloom.functions.tags import infer_error_tag
from learnloom.operators import diagnostics as D
from learnloom.operators import missions as M
from learnloom.plans.oracle import MISSIONS, error_tag, threshold, with_log
from learnloom.plans.registry import query


def snapshot_sql(min_samples):
    return with_log(
        f"""SELECT learner_id, subject, difficulty, samples, {threshold('med', 'samples', min_samples)} AS guess_threshold_ms
        FROM (SELECT learner_id, subject, difficulty, count(*) FILTER (correct AND latency_ms > 0) AS samples,
          median(latency_ms) FILTER (correct AND latency_ms > 0) AS med FROM log GROUP BY ALL)"""
    )


@query("guess_threshold", snapshot_sql(20))
def guess_threshold(t):
    return D.guess_threshold(t.log)


@query("guess_threshold_min3", snapshot_sql(3))
def guess_threshold_min3(t):
    return D.guess_threshold(t.log, 3)


@query(
    "guess_threshold_pit",
    with_log("SELECT learner_id, seq, guess_threshold_ms FROM log"),
)
def guess_threshold_pit(t):
    return t.log.select("learner_id", "seq", "guess_threshold_ms")


@query(
    "guess_threshold_pit_min3",
    with_log("SELECT learner_id, seq, guess_threshold_ms, error_tag FROM log", min_samples=3),
)
def guess_threshold_pit_min3(t):
    rows = D.threshold_at_answer(t.log.drop("guess_threshold_ms"), t.block_rows, t.split, min_samples=3)
    return D.tag_answers(rows).select("learner_id", "seq", "guess_threshold_ms", "error_tag")


@query("error_tags", with_log("SELECT learner_id, mission_no, pos, question_id, error_tag FROM log"))
def error_tags(t):
    return t.log.select("learner_id", "mission_no", "pos", "question_id", "error_tag")


@query(
    "error_tags_off_bank",
    with_log(f"""SELECT learner_id, seq, {error_tag('1500')} AS error_tag
             FROM (SELECT * REPLACE (CAST(NULL AS VARCHAR[]) AS wrong_choice_tags) FROM answers)"""),
)
def error_tags_off_bank(t):
    """Rules alone: questions without metadata and a fixed guess threshold."""
    bare = t.answers.withColumns(
        {"wrong_choice_tags": F.lit(None).cast("array<string>"), "guess_threshold_ms": F.lit(1500)}
    )
    return bare.select("learner_id", "seq", infer_error_tag().alias("error_tag"))


_GONE = "CASE WHEN CAST(question_id AS BIGINT) % 5 = 0 THEN NULL ELSE {c} END AS {c}"


@query(
    "error_tags_deleted_questions",
    with_log(
        f"""SELECT learner_id, seq, {error_tag('1500')} AS error_tag
        FROM (SELECT * REPLACE ({', '.join(_GONE.format(c=c) for c in ('choices', 'answer_index', 'wrong_choice_tags'))}) FROM answers)"""
    ),
)
def error_tags_deleted_questions(t):
    """A fifth of the questions has left the bank; their answers stay and are tagged by rule."""
    bank = t.bank.where("cast(question_id as bigint) % 5 <> 0")
    rows = D.join_bank(t.answers, bank).withColumn("guess_threshold_ms", F.lit(1500))
    return rows.select("learner_id", "seq", infer_error_tag().alias("error_tag"))


@query(
    "wrong_tagged",
    with_log("SELECT subject, error_tag, count(*) AS n FROM log WHERE NOT correct AND error_tag IS NOT NULL GROUP BY ALL"),
)
def wrong_tagged(t):
    return t.log.where(D.wrong_tagged()).groupBy("subject", "error_tag").agg(F.count("*").alias("n"))


TOP_TAG = """top_tag AS (
  SELECT learner_id, error_tag, n, first_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY n DESC, first_seq) AS rn FROM (
      SELECT learner_id, error_tag, count(*) AS n, min(seq) AS first_seq
      FROM log WHERE NOT correct AND error_tag IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"""

RECURRENCE = """recurrence AS (
  SELECT learner_id, count(*) AS errors, count(*) FILTER (again) AS recurrent FROM (
    SELECT e.learner_id, EXISTS (SELECT 1 FROM log x WHERE x.learner_id = e.learner_id AND x.subject = e.subject
      AND x.error_tag = e.error_tag AND x.seq > e.seq AND x.seq <= e.seq + 15) AS again
    FROM log e WHERE NOT correct AND error_tag IS NOT NULL) GROUP BY learner_id)"""

RETRY = """retry AS (
  SELECT learner_id, count(next_correct) AS opportunities, count(*) FILTER (next_correct) AS successes FROM (
    SELECT *, lead(correct) OVER (PARTITION BY learner_id, subject, skill_id ORDER BY seq) AS next_correct FROM log)
  WHERE NOT correct AND error_tag IS NOT NULL GROUP BY learner_id)"""


@query("top_error_tag", with_log("SELECT * FROM top_tag", TOP_TAG))
def top_error_tag(t):
    return D.top_error_tag(t.log)


@query(
    "recurrence_rate",
    with_log("SELECT *, recurrent / errors AS recurrence_rate FROM recurrence", RECURRENCE),
)
def recurrence_rate(t):
    return D.recurrence_rate(t.log, split=t.split)


@query(
    "recurrence_flags",
    with_log("""SELECT learner_id, seq, coalesce(lead(seq) OVER (PARTITION BY learner_id, subject, error_tag ORDER BY seq)
             - seq <= 15, false) AS recurrent FROM log WHERE NOT correct AND error_tag IS NOT NULL"""),
)
def recurrence_flags(t):
    return D.recurrence_flags(t.log, split=t.split).select("learner_id", "seq", "recurrent")


@query(
    "retry_success",
    with_log(
        """SELECT *, CASE WHEN opportunities = 0 THEN 0 ELSE successes / opportunities END AS retry_success_rate
        FROM retry""",
        RETRY,
    ),
)
def retry_success(t):
    return D.retry_success(t.log, t.split)


@query(
    "retry_outcomes",
    with_log("""SELECT learner_id, seq, lead(seq) OVER w AS retry_seq, lead(correct) OVER w AS retry_correct
             FROM log WINDOW w AS (PARTITION BY learner_id, subject, skill_id ORDER BY seq)"""),
)
def retry_outcomes(t):
    return D.retry_outcomes(t.log, t.split).select(
        "learner_id", "seq", F.col("retry.seq").alias("retry_seq"), F.col("retry.correct").alias("retry_correct")
    )


@query(
    "learner_dashboard",
    with_log(
        """SELECT learner_id, answers, coalesce(errors, 0) AS errors, coalesce(recurrent, 0) AS recurrent,
          coalesce(recurrent / errors, 0) AS recurrence_rate, coalesce(opportunities, 0) AS opportunities,
          coalesce(successes, 0) AS successes,
          CASE WHEN coalesce(opportunities, 0) = 0 THEN 0 ELSE successes / opportunities END AS retry_success_rate,
          error_tag AS top_error_tag
        FROM (SELECT learner_id, count(*) AS answers FROM log GROUP BY learner_id)
        LEFT JOIN recurrence USING (learner_id) LEFT JOIN retry USING (learner_id) LEFT JOIN top_tag USING (learner_id)""",
        RECURRENCE,
        RETRY,
        TOP_TAG,
    ),
)
def learner_dashboard(t):
    return D.dashboard(t.log, t.split)


@query(
    "daily_stats",
    with_log(
        """SELECT learner_id, play_day AS date, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
        CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM rewarded GROUP BY ALL""",
        MISSIONS,
    ),
)
def daily_stats(t):
    return D.daily_stats(t.log)


@query(
    "answer_latency",
    with_log(
        """SELECT learner_id, seq, greatest(0, answered_ms - coalesce(lag(answered_ms) OVER (PARTITION BY learner_id
        ORDER BY seq), answered_ms)) AS gap_ms FROM log"""
    ),
)
def answer_latency(t):
    """Latency from the previous answer where no question start is recorded."""
    from learnloom.operators.sequence import neighbour

    rows = neighbour(t.log, ["learner_id"], "seq", {"at": F.col("answered_ms")}, forward=False, split=t.split, name="prev")
    return rows.select(
        "learner_id", "seq", S.latency_ms(F.coalesce("prev.at", "answered_ms"), "answered_ms").alias("gap_ms")
    )


@query(
    "mission_score",
    with_log("SELECT learner_id, mission_no, subject, total, correct, accuracy, avg_difficulty FROM missions", MISSIONS),
)
def mission_score(t):
    return M.mission_score(t.log).select(
        "learner_id", "mission_no", "subject", "total", "correct", "accuracy", "avg_difficulty"
    )


@query(
    "mission_bands",
    with_log(
        """SELECT learner_id, mission_no, CASE WHEN accuracy >= 0.9 THEN 'excellent' WHEN accuracy >= 0.7 THEN 'good'
          ELSE 'retry' END AS band, CASE WHEN accuracy >= 0.95 THEN 'high' WHEN accuracy >= 0.8 THEN 'mid' END AS tier
        FROM missions""",
        MISSIONS,
    ),
)
def mission_bands(t):
    return M.mission_score(t.log).select(
        "learner_id",
        "mission_no",
        S.performance_band("accuracy").alias("band"),
        S.celebration_tier("accuracy").alias("tier"),
    )


@query(
    "mission_spans",
    with_log(
        """SELECT learner_id, mission_no, started_ms, finished_ms, duration_sec,
        floor(duration_sec / 60 * 10 + 0.5) / 10 AS minutes FROM missions""",
        MISSIONS,
    ),
)
def mission_spans(t):
    return M.mission_spans(t.log).select(
        "learner_id", "mission_no", "started_ms", "finished_ms", "duration_sec", S.duration_min("duration_sec").alias("minutes")
    )


@query(
    "mission_error_tags",
    with_log("""SELECT learner_id, mission_no, error_tag, count(*) AS n FROM log
             WHERE NOT correct AND error_tag IS NOT NULL GROUP BY ALL"""),
)
def mission_error_tags(t):
    return M.mission_error_tags(t.log).select("learner_id", "mission_no", "error_tag", "n")


@query(
    "mission_tags_top2",
    with_log(
        """SELECT learner_id, mission_no, string_agg(error_tag || ':' || n, ',' ORDER BY rn) AS tags,
          min(error_tag) FILTER (rn = 1) AS focus_tag
        FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, mission_no ORDER BY n DESC, first_pos) AS rn FROM (
          SELECT learner_id, mission_no, error_tag, count(*) AS n, min(pos) AS first_pos
          FROM log WHERE NOT correct AND error_tag IS NOT NULL GROUP BY ALL))
        WHERE rn <= 2 GROUP BY learner_id, mission_no"""
    ),
)
def mission_tags_top2(t):
    text = F.transform("top_misconceptions", lambda s: F.concat_ws(":", s.tag, s.n.cast("string")))
    return M.top2_misconceptions(t.log).select("learner_id", "mission_no", F.array_join(text, ",").alias("tags"), "focus_tag")


@query(
    "combo_streak",
    with_log(
        """SELECT learner_id, mission_no, pos, combo, correct AND combo >= 3 AND (combo - 3) % 2 = 0 AS milestone,
          CASE WHEN combo < 3 THEN 3 WHEN combo % 2 = 0 THEN combo + 1 ELSE combo + 2 END AS next_target,
          CASE WHEN combo < 3 THEN CAST(floor(combo / 3 * 100 + 0.5) AS BIGINT) WHEN combo % 2 = 0 THEN 50 ELSE 100 END AS progress
        FROM (SELECT *, CAST(pos - coalesce(max(CASE WHEN NOT correct THEN pos END) OVER (PARTITION BY learner_id, mission_no
          ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS BIGINT) AS combo FROM log)"""
    ),
)
def combo_streak(t):
    return M.combo_streak(t.log).select("learner_id", "mission_no", "pos", "combo", "milestone", "next_target", "progress")


@query(
    "mission_rewards",
    with_log("SELECT learner_id, mission_no, earned_xp, earned_stars FROM rewarded", MISSIONS),
)
def mission_rewards(t):
    return M.mission_results(t.log).select("learner_id", "mission_no", "earned_xp", "earned_stars")


@query(
    "running_totals",
    with_log(
        """SELECT learner_id, mission_no, CAST(xp AS BIGINT) AS xp, CAST(stars AS BIGINT) AS stars, CAST(xp AS BIGINT) // 100 + 1 AS level
        FROM (SELECT *, sum(earned_xp) OVER w AS xp, sum(earned_stars) OVER w AS stars FROM rewarded
          WINDOW w AS (PARTITION BY learner_id ORDER BY mission_no))""",
        MISSIONS,
    ),
)
def running_totals(t):
    return M.running_totals(M.mission_results(t.log), t.split).select("learner_id", "mission_no", "xp", "stars", "level")


@query(
    "subject_clears",
    with_log(
        "SELECT learner_id, mission_no, subject, row_number() OVER (PARTITION BY learner_id, subject ORDER BY mission_no) AS clears FROM missions",
        MISSIONS,
    ),
)
def subject_clears(t):
    return M.subject_clears(M.mission_score(t.log), t.split).select("learner_id", "mission_no", "subject", "clears")


STREAK = """streak AS (
  SELECT learner_id, play_day, row_number() OVER (PARTITION BY learner_id, island ORDER BY play_day) AS streak_days
  FROM (SELECT *, CAST(play_day AS DATE) - CAST(row_number() OVER (PARTITION BY learner_id ORDER BY play_day) AS INT) AS island
    FROM (SELECT DISTINCT learner_id, play_day FROM rewarded)))"""


@query("day_streak", with_log("SELECT learner_id, play_day AS date, streak_days FROM streak", MISSIONS, STREAK))
def day_streak(t):
    return M.day_streak(D.daily_stats(t.log))


BADGES = """states AS (
  SELECT *, row_number() OVER (PARTITION BY learner_id, subject ORDER BY mission_no) AS clears,
    target_difficulty AS before_difficulty, lead(target_difficulty, 1, target_difficulty) OVER (PARTITION BY learner_id
      ORDER BY mission_no) AS after_difficulty
  FROM rewarded JOIN streak USING (learner_id, play_day)),
unlocks AS (
  SELECT learner_id, badge_id, min(mission_no) AS unlocked_at FROM (
    SELECT learner_id, mission_no, unnest(['first_clear',
      CASE WHEN correct = total THEN 'perfect_mission' END,
      CASE WHEN streak_days >= 3 THEN 'three_day_streak' END,
      CASE WHEN subject = 'math' AND clears >= 3 THEN 'math_explorer' END,
      CASE WHEN subject = 'japanese' AND clears >= 3 THEN 'word_adventurer' END,
      CASE WHEN after_difficulty > before_difficulty THEN 'difficulty_climber' END,
      CASE WHEN mode = 'challenge' AND correct = total THEN 'challenge_clear' END]) AS badge_id FROM states)
  WHERE badge_id IS NOT NULL GROUP BY ALL)"""


def _unlocks(t):
    """Badges on recorded targets: the next mission's target is the difficulty after."""
    from learnloom.operators.sequence import neighbour

    results = M.mission_results(t.log)
    linked = neighbour(results, ["learner_id"], "mission_no", {"target": F.col("target_difficulty")}, split=t.split)
    return M.badge_unlocks(
        linked.withColumn("before_difficulty", F.col("target_difficulty"))
        .withColumn("after_difficulty", F.coalesce("next.target", "target_difficulty"))
        .drop("next"),
        t.split,
    )


@query("badge_unlocks", with_log("SELECT * FROM unlocks", MISSIONS, STREAK, BADGES))
def badge_unlocks(t):
    return _unlocks(t)


_BADGE_ROWS = ", ".join(f"('{i}', '{n}', '{d}')" for i, n, d in K.BADGES)


@query(
    "badge_board",
    with_log(
        f"""SELECT learner_id, b.badge_id, unlocked_at IS NOT NULL AS unlocked,
          CASE WHEN unlocked_at IS NULL THEN '{K.LOCKED_NAME}' ELSE name END AS title,
          CASE WHEN unlocked_at IS NULL THEN '{K.LOCKED_DESCRIPTION}' ELSE description END AS text
        FROM (SELECT DISTINCT learner_id FROM log) CROSS JOIN (VALUES {_BADGE_ROWS}) b(badge_id, name, description)
        LEFT JOIN unlocks u USING (learner_id, badge_id)""",
        MISSIONS,
        STREAK,
        BADGES,
    ),
)
def badge_board(t):
    return M.badge_board(_unlocks(t), t.log.select("learner_id").distinct()).drop("ordinal")


def recent_sql(n):
    return with_log(
        f"""SELECT learner_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY seq DESC) AS rn FROM log)
        WHERE rn <= {n}"""
    )


@query("recent_logs", recent_sql(200))
def recent_logs(t):
    return M.recent_logs(t.log).select("learner_id", "seq")


@query("recent_logs_20", recent_sql(20))
def recent_logs_20(t):
    return M.recent_logs(t.log, 20).select("learner_id", "seq")


def recent_results_sql(n: int) -> str:
    return with_log(
        f"""SELECT learner_id, mission_no, rank, correct FROM (SELECT *, row_number() OVER (PARTITION BY learner_id
        ORDER BY mission_no DESC) AS rank FROM missions) WHERE rank <= {n}""",
        MISSIONS,
    )


def last_results(t, n: int):
    return M.recent_results(M.mission_score(t.log), n).select(
        "learner_id", "mission_no", F.col("rank").cast("bigint").alias("rank"), "correct"
    )


@query("recent_results", recent_results_sql(10))
def recent_results(t):
    return last_results(t, 10)


@query("recent_results_30", recent_results_sql(30))
def recent_results_30(t):
    return last_results(t, 30)


@query(
    "accuracy_trend",
    with_log(
        """SELECT learner_id, mission_no, row_number() OVER (PARTITION BY learner_id ORDER BY mission_no) AS position,
          substr(play_day, 6) AS label, CAST(floor(correct / total * 100 + 0.5) AS BIGINT) AS accuracy_pct,
          floor(duration_sec / 60 * 10 + 0.5) / 10 AS minutes
        FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY mission_no DESC) AS rn FROM rewarded) WHERE rn <= 7""",
        MISSIONS,
    ),
)
def accuracy_trend(t):
    return M.accuracy_trend(M.mission_results(t.log))


RECENT_QUESTIONS = """recent_questions AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY learner_id, subject ORDER BY mission_no DESC, pos) AS rank FROM (
      SELECT learner_id, subject, question_id, mission_no, min(pos) AS pos FROM (
        SELECT *, max(mission_no) OVER (PARTITION BY learner_id, subject, question_id) AS last_mission FROM log)
      WHERE mission_no = last_mission GROUP BY ALL)) WHERE rank <= 30)"""


@query("recent_questions", with_log("SELECT learner_id, subject, question_id, rank FROM recent_questions", RECENT_QUESTIONS))
def recent_questions(t):
    return M.recent_questions(t.log).select(
        "learner_id", "subject", "question_id", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "answers_deduped",
    with_log(
        """SELECT learner_id, mission_no, pos, event_id FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, mission_no,
        pos ORDER BY answered_ms DESC) AS rn FROM (SELECT learner_id, mission_no, 0 AS pos, event_id, answered_ms FROM log
          WHERE pos < 2 UNION ALL SELECT learner_id, mission_no, pos, event_id, answered_ms FROM log WHERE pos >= 2))
        WHERE rn = 1"""
    ),
)
def answers_deduped(t):
    """The second answer of each mission is a resubmission of the first."""
    log = t.log.select("learner_id", "mission_no", "pos", "event_id", "answered_ms", "seq")
    first = log.where("pos < 2").withColumn("pos", F.lit(0).cast("bigint"))
    resubmitted = first.unionByName(log.where("pos >= 2"))
    return M.dedup_answers(resubmitted).select("learner_id", "mission_no", "pos", "event_id")
