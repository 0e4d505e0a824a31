"""Mission assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnloom.operators import bank as B
from learnloom.operators import missions as M
from learnloom.operators import replay as R
from learnloom.operators import selection as SEL
from learnloom.operators import skills as SK
from learnloom.plans.log_queries import RECENT_QUESTIONS
from learnloom.plans.oracle import NOW
from learnloom.plans.registry import query
from learnloom.plans.replay_queries import LOOP, folded
from learnloom.plans.skill_queries import dense, learners, state_sql
from learnloom.sources.testdata import NOW_MS

SEED = 7

TARGETS = """targets AS MATERIALIZED (
  SELECT learner_id, subject, coalesce(t, 1) AS target FROM learner_subjects LEFT JOIN (
    SELECT learner_id, subject, arg_max(target_difficulty, mission_no) AS t FROM missions GROUP BY ALL) USING (learner_id, subject))"""

RANKS = f"""weak AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY learner_id, subject ORDER BY mastery, seen_count, skill_ordinal) AS weak_rank FROM dense),
due_ranks AS MATERIALIZED (
  SELECT learner_id, subject, skill_id, row_number() OVER (PARTITION BY learner_id, subject
    ORDER BY mastery, seen_count, skill_ordinal) AS due_rank FROM dense WHERE next_review_at <= {NOW}),
tag_ranks AS MATERIALIZED (
  SELECT m.*, row_number() OVER (PARTITION BY learner_id, subject ORDER BY priority DESC, due_at, skill_ordinal, ordinal) AS tag_rank
  FROM misconceptions m JOIN catalogue USING (subject, skill_id) WHERE priority >= 25 AND due_at <= {NOW})"""


def _start(kind: str, skill: str, tag: str, difficulty: str) -> str:
    text = f"concat_ws('|', '{SEED}', learner_id, '{kind}', subject, {skill}, {tag}, {difficulty})"
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _pairs(name, kind, source, skill, tag, difficulty, bucket, score, rank) -> str:
    """Every (learner, question) pair of a kind with its score and tie order."""
    return f"""{name} AS MATERIALIZED (
  SELECT learner_id, subject, rank, tag_, question_id, difficulty, {score} AS score, class_tie,
    CASE WHEN idx >= start THEN idx - start ELSE idx - start + n END AS probe
  FROM (SELECT *, {_start(kind, skill, tag, difficulty)} % n AS start,
      md5(concat_ws('|', '{SEED}', learner_id, {skill}, {difficulty})) AS class_tie, {rank} AS rank, {tag} AS tag_
    FROM ({source}) x JOIN (
      SELECT *, row_number() OVER (PARTITION BY {bucket} ORDER BY md5('{SEED}|' || question_id), question_id) - 1 AS idx,
        count(*) OVER (PARTITION BY {bucket}) AS n FROM {'tagged' if kind == 'tag' else 'bank'}) b USING ({'subject, skill_id, tag' if kind == 'tag' else 'subject, skill_id' if kind == 'skill' else 'subject'}))
  LEFT JOIN (SELECT learner_id, subject, question_id, true AS recent FROM recent_questions) USING (learner_id, subject, question_id))"""


_BAND = """QUALIFY (abs(difficulty - target) <= {w}) = max(abs(difficulty - target) <= {w}) OVER (PARTITION BY {k})"""
_RECENT = "CASE WHEN recent THEN 2 ELSE 0 END"

PAIRS = ",".join(
    [
        "tagged AS MATERIALIZED (SELECT DISTINCT * EXCLUDE (wrong_choice_tags), unnest(list_filter(wrong_choice_tags, lambda t: t IS NOT NULL)) AS tag FROM bank)",
        _pairs("skill_all", "skill", "SELECT * FROM weak JOIN targets USING (learner_id, subject) LEFT JOIN due_ranks USING (learner_id, subject, skill_id)",
               "skill_id", "''", "difficulty", "subject, skill_id, difficulty", f"abs(difficulty - target) + {_RECENT}", "struct_pack(w := weak_rank, d := due_rank, s := skill_id, t := target)"),
        "skill_pairs AS MATERIALIZED (SELECT * FROM skill_all "
        + "QUALIFY (abs(difficulty - rank.t) <= 1) = max(abs(difficulty - rank.t) <= 1) OVER (PARTITION BY learner_id, subject, rank.s))",
        _pairs("tag_all", "tag", "SELECT * FROM tag_ranks JOIN targets USING (learner_id, subject)",
               "skill_id", "tag", "difficulty", "subject, skill_id, tag, difficulty", f"abs(difficulty - target) + {_RECENT}", "struct_pack(r := tag_rank, s := skill_id, t := target)"),
        "tag_pairs AS MATERIALIZED (SELECT * FROM tag_all "
        + "QUALIFY (abs(difficulty - rank.t) <= 2) = max(abs(difficulty - rank.t) <= 2) OVER (PARTITION BY learner_id, subject, rank.s, tag_))",
        _pairs("challenge_pairs", "challenge", "SELECT *, least(5, target + 1) AS wanted FROM targets",
               "''", "''", "difficulty", "subject, difficulty",
               f"abs(difficulty - wanted) + CASE WHEN difficulty < wanted THEN 3 ELSE 0 END + {_RECENT}", "0"),
        _pairs("fill_pairs", "fill", "SELECT * FROM targets", "''", "''", "0", "subject", "0", "0"),
    ]
)

_KEY = "learner_id, subject"
_ORDER = "score, class_tie, probe"

PICKS = f"""m1 AS MATERIALIZED (
  SELECT {_KEY}, question_id, tag_ FROM tag_pairs
  QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY rank.r, {_ORDER}) = 1),
m2 AS MATERIALIZED (
  SELECT {_KEY}, p.question_id FROM tag_pairs p JOIN m1 USING ({_KEY})
  JOIN (SELECT {_KEY}, count(*) AS n FROM tag_ranks GROUP BY ALL) USING ({_KEY})
  WHERE n >= 2 AND p.question_id <> m1.question_id
  QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY p.tag_ = m1.tag_, rank.r, {_ORDER}) = 1),
mis AS MATERIALIZED (SELECT {_KEY}, question_id, 0 AS k FROM m1 UNION ALL SELECT {_KEY}, question_id, 1 FROM m2),
rev AS MATERIALIZED (
  SELECT {_KEY}, question_id, k FROM (
    SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY rank.d) AS k FROM (
      SELECT * FROM skill_pairs ANTI JOIN mis USING ({_KEY}, question_id) WHERE rank.d IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY {_KEY}, rank.s ORDER BY {_ORDER}) = 1)) WHERE k <= 2),
used2 AS MATERIALIZED (SELECT {_KEY}, question_id FROM mis UNION ALL SELECT {_KEY}, question_id FROM rev),
rooms AS MATERIALIZED (
  SELECT {_KEY}, target, 5 - count(question_id) AS room,
    CASE WHEN 5 - count(question_id) > 0 AND any_value(hardest) >= least(5, target + 1) THEN 1 ELSE 0 END AS chal
  FROM targets JOIN (SELECT subject, max(difficulty) AS hardest FROM bank GROUP BY subject) USING (subject)
  LEFT JOIN used2 USING ({_KEY}) GROUP BY {_KEY}, target),
core AS MATERIALIZED (
  SELECT {_KEY}, question_id, k FROM (
    SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY rank.w) AS k FROM (
      SELECT * FROM skill_pairs ANTI JOIN used2 USING ({_KEY}, question_id)
      QUALIFY row_number() OVER (PARTITION BY {_KEY}, rank.s ORDER BY {_ORDER}) = 1)) JOIN rooms USING ({_KEY})
  WHERE k <= room - chal),
used3 AS MATERIALIZED (SELECT * FROM used2 UNION ALL SELECT {_KEY}, question_id FROM core),
chal AS MATERIALIZED (
  SELECT {_KEY}, question_id FROM challenge_pairs ANTI JOIN used3 USING ({_KEY}, question_id) JOIN rooms USING ({_KEY})
  WHERE chal = 1 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}) = 1),
used4 AS MATERIALIZED (SELECT * FROM used3 UNION ALL SELECT * FROM chal),
fill AS MATERIALIZED (
  SELECT {_KEY}, question_id, k FROM (
    SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}) AS k FROM fill_pairs ANTI JOIN used4 USING ({_KEY}, question_id))
  JOIN (SELECT {_KEY}, count(question_id) AS used_n FROM targets LEFT JOIN used4 USING ({_KEY}) GROUP BY ALL) USING ({_KEY})
  WHERE k <= 5 - used_n),
served AS MATERIALIZED (
  SELECT {_KEY}, row_number() OVER (PARTITION BY {_KEY} ORDER BY s, k) - 1 AS slot_no, slot, question_id FROM (
    SELECT {_KEY}, 0 AS s, k, 'misconception' AS slot, question_id FROM mis
    UNION ALL SELECT {_KEY}, 1, k, 'review', question_id FROM rev
    UNION ALL SELECT {_KEY}, 2, k, 'core', question_id FROM core
    UNION ALL SELECT {_KEY}, 3, 0, 'challenge', question_id FROM chal
    UNION ALL SELECT {_KEY}, 4, k, 'fill', question_id FROM fill))"""


def rank_sql(body: str) -> str:
    return state_sql(body, TARGETS, RANKS)


def served_sql(body: str) -> str:
    return state_sql(body, TARGETS, RANKS, RECENT_QUESTIONS, PAIRS, PICKS)


def targets(t):
    """Recorded target of the latest mission per (learner, subject); 1 before the first."""
    last = M.mission_score(t.log).groupBy("learner_id", "subject").agg(
        F.max_by("target_difficulty", "mission_no").alias("_t")
    )
    every = SK.learner_subjects(learners(t)).join(last, ["learner_id", "subject"], "left")
    return every.select("learner_id", "subject", F.coalesce("_t", F.lit(1)).alias("target_difficulty"))


def due(t):
    return SK.due_misconceptions(t.misconceptions, NOW_MS)


def plans(t):
    """The plan table, written once and read by every slot query."""
    catalogue = t.catalogue
    return t.once(
        "plans",
        lambda: SEL.plan_missions(
            targets(t), dense(t), due(t), M.recent_questions(t.log), t.bank, catalogue, NOW_MS, SEED
        ),
    )


@query("weakness_rank", rank_sql("SELECT learner_id, subject, skill_id, weak_rank FROM weak"))
def weakness_rank(t):
    return SEL.weakness_rank(dense(t)).select("learner_id", "subject", "skill_id", F.col("weak_rank").cast("bigint").alias("weak_rank"))


@query("due_rank", rank_sql("SELECT * FROM due_ranks"))
def due_rank(t):
    return SEL.due_rank(dense(t), NOW_MS).where("due_rank is not null").select("learner_id", "subject", "skill_id", F.col("due_rank").cast("bigint").alias("due_rank"))


@query("misconception_rank", rank_sql("SELECT learner_id, subject, skill_id, tag, tag_rank FROM tag_ranks"))
def misconception_rank(t):
    return SEL.misconception_rank(due(t), t.catalogue).select(
        "learner_id", "subject", "skill_id", "tag", F.col("tag_rank").cast("bigint").alias("tag_rank")
    )


@query(
    "misconception_candidates",
    rank_sql(
        """SELECT learner_id, subject, skill_id, tag, count(*) AS n FROM (
          SELECT * FROM tag_ranks JOIN targets USING (learner_id, subject) JOIN (SELECT DISTINCT subject, skill_id, question_id, difficulty,
            unnest(list_filter(wrong_choice_tags, lambda x: x IS NOT NULL)) AS tag FROM bank) USING (subject, skill_id, tag)
          QUALIFY (abs(difficulty - target) <= 2) = max(abs(difficulty - target) <= 2) OVER (PARTITION BY learner_id, subject, skill_id, tag))
        GROUP BY ALL"""
    ),
)
def misconception_candidates(t):
    """Questions open to each due (skill, tag): band of two steps, or all when it is empty.
    Questions are counted per bucket first, so no learner x question pair is made."""
    buckets = B.tagged_questions(t.bank).groupBy("subject", "skill_id", "tag", "difficulty").agg(F.count("*").alias("n"))
    rows = due(t).join(targets(t), ["learner_id", "subject"]).join(buckets, ["subject", "skill_id", "tag"])
    keys = ["learner_id", "subject", "skill_id", "tag"]
    return SEL.in_band_or_all(rows, keys, 2).groupBy(*keys).agg(F.sum("n").alias("n"))


@query(
    "seeded_shuffle",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS question_id, md5('{SEED}|' || p_partkey) AS shuffle_key FROM part""",
)
def seeded_shuffle(t):
    return SEL.seeded_shuffle(t.bank, SEED).select("question_id", "shuffle_key")


@query(
    "challenge_available",
    rank_sql(
        """SELECT learner_id, subject, hardest >= least(5, target + 1) AS has_challenge FROM targets
        JOIN (SELECT subject, max(difficulty) AS hardest FROM bank GROUP BY subject) USING (subject)"""
    ),
)
def challenge_available(t):
    return SEL.challenge_available(targets(t), t.bank).drop("target_difficulty")


def slots(t, slot):
    return SEL.build_missions(plans(t)).where(F.col("slot") == slot).select("learner_id", "subject", "question_id")


def slot_sql(slot):
    return served_sql(f"SELECT learner_id, subject, question_id FROM served WHERE slot = '{slot}'")


@query("mission_misconception_slots", slot_sql("misconception"))
def mission_misconception_slots(t):
    return slots(t, "misconception")


@query("mission_review_slots", slot_sql("review"))
def mission_review_slots(t):
    return slots(t, "review")


@query("mission_core_slots", slot_sql("core"))
def mission_core_slots(t):
    return slots(t, "core")


@query("mission_challenge_slot", slot_sql("challenge"))
def mission_challenge_slot(t):
    return slots(t, "challenge")


@query("build_missions", served_sql("SELECT * FROM served"))
def build_missions(t):
    return SEL.build_missions(plans(t))


ADAPTIVE = [
    LOOP[: LOOP.index("replayed AS")].rstrip().rstrip(","),
    """adaptive AS MATERIALIZED (
  SELECT learner_id, subject, x.skill AS skill_id, x.mastery AS mastery, target FROM (
    SELECT learner_id, subject, unnest(st) AS x, after_difficulty AS target FROM loop
    JOIN (SELECT learner_id, subject, max(n) AS n FROM loop GROUP BY ALL) USING (learner_id, subject, n)))""",
    """targets AS MATERIALIZED (
  SELECT learner_id, subject, coalesce(t, 1) AS target FROM learner_subjects LEFT JOIN (
    SELECT learner_id, subject, any_value(target) AS t FROM adaptive GROUP BY ALL) USING (learner_id, subject))""",
    """adapted AS MATERIALIZED (
  SELECT d.* REPLACE (coalesce(a.mastery, 45.0) AS mastery) FROM dense d LEFT JOIN adaptive a USING (learner_id, subject, skill_id))""",
    RANKS.replace("FROM dense", "FROM adapted"),
]


@query("build_missions_adaptive", state_sql("SELECT * FROM served", *ADAPTIVE, RECENT_QUESTIONS, PAIRS, PICKS))
def build_missions_adaptive(t):
    """The next missions from the replayed state: its targets and mastery instead of recorded ones."""
    folds = folded(t)
    every = SK.learner_subjects(learners(t))
    goals = every.join(R.replay_subject_state(folds), ["learner_id", "subject"], "left").select(
        "learner_id", "subject", F.coalesce("target_difficulty", F.lit(1)).alias("target_difficulty")
    )
    skills = R.replay_skill_state(t.outcomes, folds, t.split).drop("last_error_tag")
    every_skill = SK.densify(every, t.catalogue, skills, NOW_MS)
    plan = SEL.plan_missions(goals, every_skill, due(t), M.recent_questions(t.log), t.bank, t.catalogue, NOW_MS, SEED)
    return SEL.build_missions(plan)


@query(
    "mission_plan",
    served_sql(
        """SELECT learner_id, subject, target AS target_difficulty, mis_n AS misconception_count, review_count,
          total - review_count - challenge_count AS core_count, challenge_count,
          CASE WHEN review_count >= 2 THEN 'review' WHEN challenge_count = 1 AND target >= 2 THEN 'challenge' ELSE 'learn' END AS mode
        FROM (SELECT learner_id, subject, count(*) FILTER (slot = 'misconception') AS mis_n,
            count(*) FILTER (slot IN ('misconception', 'review')) AS review_count,
            count(*) FILTER (slot = 'challenge') AS challenge_count, count(*) AS total FROM served GROUP BY ALL)
        JOIN targets USING (learner_id, subject)"""
    ),
)
def mission_plan(t):
    return plans(t).select(
        "learner_id", "subject", "target_difficulty", "mode", "misconception_count", "review_count", "core_count", "challenge_count"
    )
