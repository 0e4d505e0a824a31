"""Facts in question text, denominations and exported learner state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from learnloom.functions import facts
from learnloom.operators import bank as B
from learnloom.plans.oracle import NOW, sql_list
from learnloom.plans.registry import ORACLE, query
from learnloom.session import checkpoint_root, note_folder
from learnloom.sources import state_json as SJ
from learnloom.sources.testdata import NOW_MS
from learnloom import constants as K

# Eight kinds of question per part, built from its key and size; the SQL states the facts.
QUESTION_SUBJECTS = ["life", "life", "life", "life", "math", "insight", "insight", "japanese"]
QUESTION_SKILLS = [
    "clock_mixed", "money_sum", "money_value", "money_change", "fractions_basic", "route_optimization", "odd_one_out", "word_context",
]


def questions(t):
    key, n = F.col("p_partkey"), F.col("p_size")
    kind = (key % 8).cast("int")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    hour = n % 12 + 1
    variant = (F.floor(key / 8) % 4).cast("int")
    prompts = F.array(
        F.lit("なんじ？"),
        text("100えんだま ", n % 4, "まいと 1000えんさつ", n, "まい"),
        text("500えんだま", n, "まいは いくら？"),
        text(n * 3, "えんの えんぴつを ", n * 4, "えんで かいました。おつりは？"),
        text("ケーキを ", n, "とうぶん した ひとつは？"),
        text("みちA 5ほ+", n, "、 みちB ", n + 1, "ほ、 C 0+3、 D いろ。どれ？"),
        F.lit("なかまはずれは？"),
        F.lit("ことば"),
    )
    clock = F.get(
        F.array(text(hour, "じ"), text(hour, "じはん"), text(hour, "じ15ふん"), text("  ", hour, "じ45ふん　")), variant
    )
    answers = F.array(
        clock,
        F.lit("いくつか"),
        text(n * 500, "えん"),
        F.lit("わからない"),
        F.lit("ひとつぶん"),
        F.when(variant % 2 == 0, "Aみち").otherwise("Z"),
        F.when(n % 5 == 0, " ").otherwise(" いぬ"),
        F.lit("x"),
    )
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), kind)
    return t.table("part").select(
        "p_partkey",
        pick(QUESTION_SUBJECTS).alias("subject"),
        pick(QUESTION_SKILLS).alias("skill_id"),
        F.get(prompts, kind).alias("prompt"),
        F.array(F.get(answers, kind), F.lit("b"), F.lit("c ")).alias("choices"),
        F.lit(0).alias("answer_index"),
    )


FACTS = """
facts AS (
  SELECT p_partkey, p_partkey % 8 AS k, p_size AS n, p_size % 12 + 1 AS h, (p_partkey // 8) % 4 AS v FROM part),
told AS (
  SELECT p_partkey, k,
    CASE k WHEN 0 THEN 'clock' WHEN 1 THEN 'money' WHEN 2 THEN 'money' WHEN 3 THEN 'money'
      WHEN 4 THEN CASE WHEN n >= 2 THEN 'fraction' END WHEN 5 THEN 'route'
      WHEN 6 THEN CASE WHEN n % 5 <> 0 THEN 'odd_one_out' END END AS kind,
    CASE k WHEN 0 THEN h WHEN 1 THEN 100 * (n % 4) + 1000 * n WHEN 2 THEN 500 * n WHEN 3 THEN n
      WHEN 4 THEN CASE WHEN n >= 2 THEN 1 END WHEN 5 THEN 2 WHEN 6 THEN CASE WHEN n % 5 <> 0 THEN 3 END END AS a,
    CASE k WHEN 0 THEN [0, 30, 15, 45][v + 1] WHEN 1 THEN CASE WHEN n % 4 > 0 THEN 2 ELSE 1 END WHEN 2 THEN 1 WHEN 3 THEN 4 * n
      WHEN 4 THEN CASE WHEN n >= 2 THEN n END WHEN 5 THEN n + 1 END AS b,
    CASE k WHEN 0 THEN h || ['じ', 'じはん', 'じ15ふん', 'じ45ふん'][v + 1] WHEN 1 THEN 'sum' WHEN 2 THEN 'value' WHEN 3 THEN 'change'
      WHEN 4 THEN CASE WHEN n >= 2 THEN '1/' || n END WHEN 5 THEN CASE WHEN v % 2 = 0 THEN 'みちA' ELSE 'みちB' END
      WHEN 6 THEN CASE WHEN n % 5 <> 0 THEN 'いぬ|b|c' END END AS text
  FROM facts)"""


@query("bank_facts", f"WITH {FACTS} SELECT p_partkey, kind, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, text FROM told")
def bank_facts(t):
    f = facts.with_facts(questions(t))
    money_b = F.when(F.col("money.mode") == "change", F.col("money.paid")).otherwise(F.size("money.items").cast("double"))
    shortest = F.array_min(F.transform("route.options", lambda o: o.distance))
    return f.select(
        "p_partkey",
        "kind",
        F.coalesce(
            F.col("clock.hour").cast("double"), "money.total", "fraction.numerator",
            F.when(F.col("kind") == "route", F.size("route.options").cast("double")),
            F.when(F.col("kind") == "odd_one_out", F.size("odd_one_out.items").cast("double")),
        ).alias("a"),
        F.coalesce(
            F.col("clock.minute").cast("double"), F.when(F.col("kind") == "money", money_b), "fraction.denominator", shortest
        ).alias("b"),
        F.coalesce(
            "clock.label", "money.mode", "fraction.label", "route.best_route", F.array_join("odd_one_out.items", "|")
        ).alias("text"),
    )


@query(
    "visual_coverage",
    f"""WITH {FACTS} SELECT {sql_list(QUESTION_SUBJECTS)}[k + 1] AS subject, count(*) AS questions, count(kind) AS with_visual
    FROM told GROUP BY ALL""",
)
def visual_coverage(t):
    return B.visual_coverage(facts.with_facts(questions(t)))


@query(
    "denominations",
    """SELECT o_orderkey, o_totalprice, value, n, CASE WHEN value >= 1000 THEN 'bill' ELSE 'coin' END AS kind FROM (
      SELECT o_orderkey, o_totalprice, value, CASE WHEN value = 1000 THEN amount // 1000 ELSE (amount % prev) // value END AS n
      FROM (SELECT o_orderkey, o_totalprice, CAST(floor(greatest(0, o_totalprice)) AS BIGINT) AS amount FROM orders)
      CROSS JOIN (VALUES (1000, 1), (500, 1000), (100, 500), (50, 100), (10, 50), (5, 10), (1, 5)) d(value, prev)) WHERE n > 0""",
)
def denominations(t):
    rows = t.table("orders").select("o_orderkey", "o_totalprice", F.inline(facts.decompose(F.col("o_totalprice"))))
    return rows.withColumnRenamed("count", "n")


def traces(t):
    """Trace JSON per event, with defects that follow from its id."""
    key = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    subject = F.get(F.array(*[F.lit(s) for s in [*K.SUBJECTS, "science"]]), (key % 5).cast("int"))
    question = F.when(key % 11 == 3, text(key)).otherwise(text('"q', key, '"'))
    difficulty = F.when(key % 7 == 0, '"3"').otherwise(text(key % 5 + 1))
    correct = F.get(F.array(*[F.lit(v) for v in ["true", "false", "1", "0", '"yes"', '""', "null"]]), (key % 7).cast("int"))
    tag = F.get(F.array(*[F.lit(v) for v in [*K.TAGS, "mystery"]]), (key % 13).cast("int"))
    latency = F.when(key % 9 == 4, F.lit("")).otherwise(text(',"latencyMs":', F.col("value")))
    trace = F.when(key % 17 == 6, "5").otherwise(
        text(
            '{"subject":"', subject, '","questionId":', question, ',"skillId":"s", "difficulty":', difficulty,
            ',"correct":', correct, ',"errorTag":"', tag, '"', latency, "}",
        )
    )
    return t.table("events").select(F.col("user_id").alias("learner_id"), key.alias("seq"), trace.alias("trace"))


def load_sql(n):
    return f"""SELECT user_id AS learner_id, event_id AS seq, {NOW} AS answered_ms, {sql_list(K.SUBJECTS)}[event_id % 5 + 1] AS subject,
      CASE WHEN event_id % 7 = 0 THEN 1 ELSE event_id % 5 + 1 END AS difficulty, event_id % 7 IN (0, 2, 4) AS correct,
      CASE WHEN event_id % 13 < 12 THEN {sql_list(K.TAGS)}[event_id % 13 + 1] END AS error_tag,
      CASE WHEN event_id % 9 = 4 THEN 0 ELSE value END AS latency_ms
    FROM events WHERE event_id % 17 <> 6 AND event_id % 5 <> 4 AND event_id % 11 <> 3
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= {n}"""


def loaded(t, n):
    rows = SJ.load_answers(traces(t), NOW_MS, "learner_id", n)
    return rows.select("learner_id", "seq", "answered_ms", "subject", "difficulty", "correct", "error_tag", "latency_ms")


@query("load_answers", load_sql(200))
def load_answers(t):
    return loaded(t, 200)


@query("load_answers_20", load_sql(20))
def load_answers_20(t):
    return loaded(t, 20)


def states(t):
    """State JSON per customer with missing, mistyped, out-of-range and unknown parts."""
    key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    mastery = F.when(key % 3 == 1, '"high"').otherwise(text(balance))
    tag = F.when(key % 4 == 1, "mystery").otherwise("attention_slip")
    state = text(
        '{"subjectClears":{"math":', nation, ',"life":"3"},"adaptiveBySubject":{"math":{"targetDifficulty":', balance / 1000,
        ',"missionCount":', nation - 5, '},"japanese":"broken"},"skillProgress":{"s1":{"mastery":', mastery, ',"streak":', nation,
        ',"lastErrorTag":"', tag, '","misconceptions":{"mystery":{"priority":1},"unknown_guess":{"priority":', balance,
        ',"dueAt":"soon"},"attention_slip":{"errorCount":', nation, ',"lastSeenAt":', key, '},"jp_sound_confusion":7}},"s2":5},',
        '"recentQuestionIdsBySubject":{"math":["a",', nation, ',"b', key, '"],"life":"none"}}',
    )
    return t.table("customer").select("c_custkey", F.when(key % 10 == 9, "{}").otherwise(state).alias("state"))


FULL = "FROM customer WHERE c_custkey % 10 <> 9"


@query(
    "normalize_adaptive",
    f"""SELECT c_custkey, subject, CASE WHEN c_custkey % 10 = 9 OR subject <> 'math' THEN 1
        ELSE CAST(greatest(1, least(5, floor(c_acctbal / 1000 + 0.5))) AS INT) END AS target_difficulty,
      CASE WHEN c_custkey % 10 = 9 OR subject <> 'math' THEN 0 ELSE greatest(0, c_nationkey - 5) END AS mission_count,
      CASE WHEN c_custkey % 10 = 9 OR subject <> 'math' THEN 0 ELSE c_nationkey END AS clears
    FROM customer CROSS JOIN (SELECT unnest({sql_list(K.SUBJECTS)}) AS subject)""",
)
def normalize_adaptive(t):
    rows = SJ.adaptive_states(states(t), "c_custkey")
    return rows.join(SJ.subject_clears(states(t), "c_custkey"), ["c_custkey", "subject"])


@query(
    "normalize_skills",
    f"""SELECT c_custkey, 's1' AS skill_id, CASE WHEN c_custkey % 3 = 1 THEN 45 ELSE c_acctbal END AS mastery, c_nationkey AS streak,
      {NOW} AS next_review_at, 0 AS seen_count, CASE WHEN c_custkey % 4 <> 1 THEN 'attention_slip' END AS last_error_tag {FULL}""",
)
def normalize_skills(t):
    return SJ.skill_table(states(t), NOW_MS, "c_custkey").drop("misconceptions")


@query(
    "normalize_misconceptions",
    f"""SELECT c_custkey, 's1' AS skill_id, 1 AS ordinal, 'unknown_guess' AS tag, 0 AS error_count, c_acctbal AS priority,
      {NOW} AS due_at, {NOW} AS last_seen_at {FULL}
    UNION ALL SELECT c_custkey, 's1', 2, 'attention_slip', c_nationkey, 0, {NOW}, c_custkey {FULL}""",
)
def normalize_misconceptions(t):
    skills = SJ.skill_table(states(t), NOW_MS, "c_custkey")
    return SJ.misconception_table(skills, NOW_MS, "c_custkey").drop("recent_error_count", "resolved_streak")


@query(
    "normalize_recent_questions",
    f"""SELECT c_custkey, 'math' AS subject, 0 AS position, 'a' AS question_id {FULL}
    UNION ALL SELECT c_custkey, 'math', 1, 'b' || c_custkey {FULL}""",
)
def normalize_recent_questions(t):
    return SJ.recent_question_table(states(t), "c_custkey")


@query("state_saved", ORACLE["normalize_skills"])
def state_saved(t):
    """Skills of the exported states, saved with the other tables and read back."""
    root = note_folder(t.spark, f"{checkpoint_root(t.spark).rstrip('/')}/learnloom/state_{uuid.uuid4().hex}")
    skills = SJ.skill_table(states(t), NOW_MS, "c_custkey").drop("misconceptions")
    SJ.save_state({"skills": skills, "subject_clears": SJ.subject_clears(states(t), "c_custkey")}, root)
    return SJ.read_state(t.spark, root, "skills")
