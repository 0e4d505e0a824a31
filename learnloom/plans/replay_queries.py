"""Replay, cooldown and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnloom import constants as K
from learnloom.operators import cooldown as C
from learnloom.operators import replay as R
from learnloom.plans.log_queries import BADGES, STREAK
from learnloom.plans.oracle import with_log
from learnloom.plans.registry import query
from learnloom.plans.skill_queries import BASE, SCHEDULE, STATE, SUBJECTS

# The whole adaptive loop as a recursive query: one step per (learner, subject) mission.
# State: target and a list of skills, each with mastery and tag rows in first-seen order.
LOOP = """played AS MATERIALIZED (
  SELECT m.*, row_number() OVER (PARTITION BY m.learner_id, m.subject ORDER BY mission_no) AS n, o.answers AS outs, n_skills
  FROM missions m JOIN (SELECT learner_id, mission_no, list({'skill': skill_id, 'ok': correct, 'tag': error_tag, 'd': difficulty}) AS answers
    FROM outcomes GROUP BY ALL) o USING (learner_id, mission_no)
  JOIN (SELECT subject, count(*) AS n_skills FROM catalogue GROUP BY ALL) USING (subject)),
loop AS (
  SELECT DISTINCT learner_id, subject, 0::BIGINT AS n, NULL::BIGINT AS mission_no, 1 AS before_difficulty, 1 AS after_difficulty,
    0.0::DOUBLE AS avg_mastery, 0.0::DOUBLE AS unresolved,
    []::STRUCT(skill VARCHAR, mastery DOUBLE, tags STRUCT(tag VARCHAR, p DOUBLE, rs BIGINT)[])[] AS st FROM played
  UNION ALL
  SELECT learner_id, subject, n, mission_no, target, greatest(1, least(5, target
      + CASE WHEN accuracy >= 0.8 AND avg_mastery >= 55 AND unresolved <= 0.35 AND avg_difficulty >= target - 0.25 AND mode <> 'review' THEN 1 ELSE 0 END
      - CASE WHEN accuracy <= 0.4 OR unresolved >= 0.65 THEN 1 ELSE 0 END)), avg_mastery, unresolved, st
  FROM (
    SELECT *, (list_sum(list_transform(st, lambda s: s.mastery)) + (n_skills - len(st)) * 45) / n_skills AS avg_mastery,
      CASE WHEN len(ps) = 0 THEN 0 ELSE floor(list_avg(ps[:2]) / 100 * 1000 + 0.5) / 1000 END AS unresolved
    FROM (SELECT *, list_reverse_sort(flatten(list_transform(st, lambda s: list_transform(s.tags, lambda t: t.p)))) AS ps FROM (
      SELECT learner_id, subject, n, mission_no, target, accuracy, avg_difficulty, mode, n_skills,
        list_concat(
          list_filter(old, lambda s: NOT list_contains(list_transform(outs, lambda o: o.skill), s.skill)),
          list_transform(joined, lambda x: {'skill': x.o.skill,
            'mastery': greatest(0.0::DOUBLE, least(100.0::DOUBLE, x.mastery + CASE WHEN x.o.ok
              THEN 6 + 2 * greatest(0, x.o.d - target) ELSE -(10 + 2 * x.o.d) END)),
            'tags': CASE
              WHEN x.o.ok THEN list_transform(x.tags, lambda t, i: CASE
                WHEN i = list_position(list_transform(x.tags, lambda y: y.p), list_max(list_transform(x.tags, lambda y: y.p)))
                THEN {'tag': t.tag, 'p': greatest(0.0::DOUBLE, t.p - (6 + 2 * (t.rs + 1))), 'rs': t.rs + 1} ELSE t END)
              WHEN x.o.tag IS NULL THEN x.tags
              ELSE list_transform(CASE WHEN list_contains(list_transform(x.tags, lambda y: y.tag), x.o.tag) THEN x.tags
                  ELSE list_append(x.tags, {'tag': x.o.tag, 'p': 0.0::DOUBLE, 'rs': 0::BIGINT}) END,
                lambda t: CASE WHEN t.tag = x.o.tag THEN {'tag': t.tag,
                  'p': least(100.0::DOUBLE, t.p + 12.0::DOUBLE * (1.0::DOUBLE + x.o.d * 0.2::DOUBLE)), 'rs': 0::BIGINT} ELSE t END) END})) AS st
      FROM (
        SELECT p.learner_id, p.subject, p.n, p.mission_no, l.after_difficulty AS target, p.accuracy, p.avg_difficulty, p.mode,
          p.n_skills, p.outs, l.st AS old,
          list_transform(p.outs, lambda o: {'o': o,
            'mastery': coalesce(list_filter(l.st, lambda s: s.skill = o.skill)[1].mastery, 45.0::DOUBLE),
            'tags': coalesce(list_filter(l.st, lambda s: s.skill = o.skill)[1].tags, [])}) AS joined
        FROM loop l JOIN played p ON p.learner_id = l.learner_id AND p.subject = l.subject AND p.n = l.n + 1))))),
replayed AS MATERIALIZED (
  SELECT m.* EXCLUDE (earned_xp, earned_stars), l.before_difficulty, l.after_difficulty, l.avg_mastery, l.unresolved AS unresolved_index,
    earned_xp + CASE WHEN l.after_difficulty > l.before_difficulty THEN 15 ELSE 0 END AS earned_xp,
    earned_stars + CASE WHEN l.after_difficulty > l.before_difficulty THEN 1 ELSE 0 END AS earned_stars
  FROM rewarded m JOIN loop l USING (learner_id, mission_no))"""

_PARTS = (*BASE, SUBJECTS, LOOP)


def loop_sql(body: str, *extra: str) -> str:
    return with_log(body, *_PARTS, *extra, recursive=True)


def folded(t):
    return t.once("folded", lambda: R.fold_missions(t.outcomes, t.catalogue))


def results(t):
    return R.replay_results(t.log, t.outcomes, folded(t), t.split)


@query(
    "replay_results",
    loop_sql(
        """SELECT learner_id, mission_no, subject, mode, total, correct, accuracy,
          floor(avg_difficulty * 100 + 0.5) / 100 AS avg_difficulty, before_difficulty, after_difficulty, avg_mastery, unresolved_index,
          duration_sec, earned_xp, earned_stars, reviewed_skills, focus_tag
        FROM replayed JOIN (
          SELECT learner_id, mission_no, count(*) FILTER (prev IS NULL OR prev <= now_ms) AS reviewed_skills
          FROM (SELECT *, lag(next_review_at) OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no) AS prev FROM schedule)
          GROUP BY ALL) USING (learner_id, mission_no)
        LEFT JOIN (SELECT learner_id, mission_no, error_tag AS focus_tag FROM (
          SELECT learner_id, mission_no, error_tag, count(*) AS n, min(pos) AS first_pos
          FROM log WHERE NOT correct AND error_tag IS NOT NULL GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY learner_id, mission_no ORDER BY n DESC, first_pos) = 1) USING (learner_id, mission_no)""",
        SCHEDULE,
    ),
)
def replay_results(t):
    return results(t).select(
        "learner_id", "mission_no", "subject", "mode", "total", "correct", "accuracy", "avg_difficulty",
        "before_difficulty", "after_difficulty", "avg_mastery", "unresolved_index", "duration_sec", "earned_xp",
        "earned_stars", "reviewed_skills", "focus_tag",
    )


@query(
    "replay_resumed",
    loop_sql(
        """SELECT learner_id, subject, mission_no, before_difficulty, after_difficulty, avg_mastery, unresolved AS unresolved_index
        FROM loop WHERE n > 0"""
    ),
)
def replay_resumed(t):
    """The first missions are folded and their state saved; the rest goes on from what is read back."""
    early, late = t.outcomes.where("mission_no < 7"), t.outcomes.where("mission_no >= 7")
    first = R.Replay(early, t.catalogue)
    saved = t.once("saved_state", first.state)
    columns = ["learner_id", "subject", "mission_no", "before_difficulty", "after_difficulty", "avg_mastery", "unresolved_index"]
    parts = [first.missions(), R.fold_missions(late, t.catalogue, saved)]
    return parts[0].unionByName(parts[1]).select(columns).distinct()


@query(
    "replay_skill_state",
    loop_sql(
        """SELECT l.learner_id, l.subject, l.skill_id, l.mastery, s.streak, s.next_review_at, s.seen_count FROM (
          SELECT learner_id, subject, x.skill AS skill_id, x.mastery AS mastery FROM (
            SELECT learner_id, subject, unnest(st) AS x FROM loop
            JOIN (SELECT learner_id, subject, max(n) AS n FROM loop GROUP BY ALL) USING (learner_id, subject, n))) l
        JOIN (SELECT * FROM schedule QUALIFY row_number() OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no DESC) = 1) s
          USING (learner_id, skill_id)""",
        SCHEDULE,
    ),
)
def replay_skill_state(t):
    return R.replay_skill_state(t.outcomes, folded(t), t.split).drop("last_error_tag")


@query(
    "replay_subject_state",
    loop_sql(
        """SELECT learner_id, subject, arg_max(after_difficulty, n) AS target_difficulty, max(n) AS mission_count
        FROM loop WHERE n > 0 GROUP BY ALL"""
    ),
)
def replay_subject_state(t):
    return R.replay_subject_state(folded(t))


REPLAY_BADGES = BADGES.replace("rewarded JOIN", "replayed JOIN").replace(
    """target_difficulty AS before_difficulty, lead(target_difficulty, 1, target_difficulty) OVER (PARTITION BY learner_id
      ORDER BY mission_no) AS after_difficulty""",
    "1 AS one",
)


@query(
    "replay_learner_state",
    loop_sql(
        """SELECT learner_id, xp, xp // 100 + 1 AS level, stars, missions, last_played_date, streak_days, badges FROM (
          SELECT learner_id, CAST(sum(earned_xp) AS BIGINT) AS xp, CAST(sum(earned_stars) AS BIGINT) AS stars, count(*) AS missions,
            max(play_day) AS last_played_date FROM replayed GROUP BY learner_id)
        JOIN (SELECT learner_id, play_day AS last_played_date, streak_days FROM streak) USING (learner_id, last_played_date)
        JOIN (SELECT learner_id, string_agg(badge_id, ',' ORDER BY badge_id) AS badges FROM unlocks GROUP BY learner_id) USING (learner_id)""",
        STREAK,
        REPLAY_BADGES,
    ),
)
def replay_learner_state(t):
    state = R.replay_learner_state(results(t), t.split)
    return state.withColumn("badges", F.array_join("badges", ","))


def append_sql(n: int) -> str:
    return with_log(f"SELECT learner_id, seq FROM log QUALIFY row_number() OVER (PARTITION BY learner_id ORDER BY seq DESC) <= {n}")


def appended(t, n: int):
    """The log up to each learner's mission 9, then the later missions appended."""
    log = t.log.select("learner_id", "seq", "mission_no")
    return R.append_traces(log.where("mission_no < 10"), log.where("mission_no >= 10"), n).drop("mission_no")


@query("append_traces", append_sql(40))
def append_traces(t):
    return appended(t, 40)


@query("append_traces_200", append_sql(K.LOG_RETENTION))
def append_traces_200(t):
    return appended(t, K.LOG_RETENTION)


# The test events are minutes apart, so effects get cooldowns of hours here.
HOURS = {"tap": 9, "combo": 40, "clear": 20}
EFFECT = {"click": "tap", "purchase": "combo", "view": "clear"}

_EFFECT_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in EFFECT.items()) + " ELSE 'wrong' END"
WAITS = {effect: hours * K.HOUR_MS for effect, hours in HOURS.items()}


def cooldown_sql(waits: dict[str, int]) -> str:
    wait = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {waits[x]}" for e, x in EFFECT.items()) + " ELSE 0 END"
    return with_log(
        """SELECT learner_id, event_id, accepted FROM gate WHERE n > 0""",
        f"""ticks AS MATERIALIZED (SELECT learner_id, event_id, {_EFFECT_SQL} AS effect, {wait} AS wait, answered_ms,
          row_number() OVER (PARTITION BY learner_id, {_EFFECT_SQL} ORDER BY seq) AS n FROM answers),
        gate AS (
          SELECT DISTINCT learner_id, effect, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS last, false AS accepted FROM ticks
          UNION ALL
          SELECT t.learner_id, t.effect, t.n, t.event_id,
            CASE WHEN g.last IS NULL OR t.answered_ms - g.last >= t.wait THEN t.answered_ms ELSE g.last END,
            g.last IS NULL OR t.answered_ms - g.last >= t.wait
          FROM gate g JOIN ticks t ON t.learner_id = g.learner_id AND t.effect = g.effect AND t.n = g.n + 1)""",
        recursive=True,
    )


def filtered(t, waits: dict[str, int]):
    pairs = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    ticks = t.answers.withColumn("effect", F.coalesce(pairs(EFFECT)[F.col("event_type")], F.lit("wrong"))).select(
        "learner_id", "effect", "block", "n_blocks", "seq", "event_id", "answered_ms",
        F.coalesce(pairs(waits)[F.col("effect")], F.lit(0)).cast("bigint").alias("wait_ms"),
    )
    flagged = C.cooldown_filter(ticks, ["learner_id", "effect"], "answered_ms", "wait_ms")
    return flagged.select("learner_id", "event_id", "accepted")


@query("cooldown_filter", cooldown_sql(WAITS))
def cooldown_filter(t):
    return filtered(t, WAITS)


@query("cooldown_filter_ms", cooldown_sql(K.COOLDOWN_MS))
def cooldown_filter_ms(t):
    return filtered(t, K.COOLDOWN_MS)
