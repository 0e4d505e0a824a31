"""Bank, scalar and dictionary queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from learnloom import constants as K
from learnloom import dictionary as D
from learnloom.functions import scalars as S
from learnloom.functions.tags import skill_tag, with_tag_texts
from learnloom.operators import bank as B
from learnloom.plans.oracle import BANK, SKILL_TAG, sql_list, sql_map, with_bank, with_log
from learnloom.plans.registry import query
from learnloom.session import checkpoint_root, note_folder
from learnloom.sources import bank_text

RAW_CELLS = """
raw AS (
  SELECT p_partkey AS ordinal,
    CASE WHEN p_partkey % 13 = 5 THEN '' ELSE 'q' || p_partkey END AS id,
    ['math', 'japanese', 'life', 'insight', 'science'][p_partkey % 5 + 1] AS subject,
    CASE WHEN p_partkey % 19 = 7 THEN '' ELSE p_type END AS skill_id,
    CASE WHEN p_partkey % 23 = 3 THEN '2.5' WHEN p_partkey % 23 = 4 THEN 'hard' WHEN p_partkey % 23 = 5 THEN ''
         WHEN p_partkey % 23 = 6 THEN '3.0' ELSE CAST(p_size % 7 AS VARCHAR) END AS difficulty,
    CASE WHEN p_partkey % 29 = 1 THEN '' ELSE CAST(p_size % 4 AS VARCHAR) END AS answer_index,
    p_partkey % 17 = 2 AS short_row, p_name AS prompt, p_brand AS hint
  FROM part)"""


def raw_cells(part):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    pick = F.when(key % 23 == 3, "2.5").when(key % 23 == 4, "hard").when(key % 23 == 5, "").when(key % 23 == 6, "3.0")
    cells = [
        F.when(key % 13 == 5, "").otherwise(F.concat(F.lit("q"), text(key))),
        F.get(F.array(*[F.lit(s) for s in [*K.SUBJECTS, "science"]]), (key % 5).cast("int")),
        F.when(key % 19 == 7, "").otherwise(F.col("p_type")),
        pick.otherwise(text(size % 7)),
        F.col("p_name"),
        F.lit("a"),
        F.lit("b"),
        F.lit("c"),
        F.when(key % 29 == 1, "").otherwise(text(size % 4)),
    ]
    return part.select(
        key.alias("ordinal"),
        F.when(key % 17 == 2, F.array(*cells)).otherwise(F.array(*cells, F.col("p_brand"))).alias("cells"),
    )


GOOD_CELLS = """NOT short_row AND id <> '' AND subject <> 'science' AND skill_id <> ''
  AND difficulty IN ('1', '2', '3', '4', '5', '3.0') AND answer_index IN ('0', '1', '2', '')"""


@query(
    "bank_validate",
    f"""WITH {RAW_CELLS}
    SELECT ordinal, CASE WHEN short_row THEN 'columns' ELSE concat_ws(',',
      CASE WHEN id = '' THEN 'id' END, CASE WHEN subject = 'science' THEN 'subject' END,
      CASE WHEN skill_id = '' THEN 'skill_id' END,
      CASE WHEN difficulty NOT IN ('1', '2', '3', '4', '5', '3.0') THEN 'difficulty' END,
      CASE WHEN answer_index = '3' THEN 'answer_index' END) END AS reasons
    FROM raw""",
)
def bank_validate(t):
    return B.check_cells(raw_cells(t.table("part"))).select("ordinal", F.array_join("reasons", ",").alias("reasons"))


@query(
    "bank_accepted",
    f"""WITH {RAW_CELLS}
    SELECT ordinal, id AS question_id, subject, skill_id, CAST(CAST(difficulty AS DOUBLE) AS INT) AS difficulty,
      CASE answer_index WHEN '' THEN 0 ELSE CAST(answer_index AS INT) END AS answer_index, prompt, hint,
      'a|b|c' AS choices
    FROM raw WHERE {GOOD_CELLS}""",
)
def bank_accepted(t):
    accepted, _ = B.validate_bank(raw_cells(t.table("part")))
    return accepted.withColumn("choices", F.array_join("choices", "|"))


@query(
    "bank_text_rows",
    f"""WITH {RAW_CELLS}
    SELECT subject AS file, row_number() OVER (PARTITION BY subject ORDER BY ordinal) - 1 AS ordinal,
      CASE WHEN short_row THEN 9 ELSE 10 END AS n_cells, id, difficulty, prompt
    FROM raw""",
)
def bank_text_rows(t):
    """Bank files assembled from ``part`` (one per subject), then parsed back line by line."""
    rows = raw_cells(t.table("part"))
    files = rows.select(F.get("cells", F.lit(1)).alias("file")).distinct()
    text = rows.select(
        F.get("cells", F.lit(1)).alias("file"),
        F.col("ordinal").alias("line_no"),
        F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")).alias("value"),
    )
    framing = [
        (-9, "| before | the markers |"),
        (-4, bank_text.START),
        (-3, "| id | subject |"),
        (-2, "|---|---|"),
        (-1, "a remark without a bar"),
        (2**60, bank_text.END),
        (2**60 + 1, "| after | the markers |"),
    ]
    frame = files.select(
        "file", F.inline(F.array(*[F.struct(F.lit(n).cast("bigint").alias("line_no"), F.lit(v).alias("value")) for n, v in framing]))
    )
    parsed = bank_text.parse_lines(text.unionByName(frame))
    return parsed.select(
        "file",
        "ordinal",
        F.size("cells").cast("bigint").alias("n_cells"),
        F.get("cells", F.lit(0)).alias("id"),
        F.get("cells", F.lit(3)).alias("difficulty"),
        F.get("cells", F.lit(4)).alias("prompt"),
    )


@query(
    "bank_meta",
    with_bank(
        f"""SELECT question_id, CASE WHEN curated THEN array_to_string(list_transform(wrong_choice_tags,
          lambda x: coalesce(x, '-')), ',') ELSE tag || ',' || tag || ',' || tag END AS tags,
          CASE WHEN NOT curated THEN {sql_map('TAG_HINTS', 'tag')} END AS hint
        FROM (SELECT question_id, wrong_choice_tags, wrong_choice_tags IS NOT NULL AS curated,
          {SKILL_TAG} AS tag FROM bank)"""
    ),
)
def bank_meta(t):
    bank = t.bank
    curated = bank.where("wrong_choice_tags is not null").select(
        "question_id", F.col("wrong_choice_tags").alias("curated")
    )
    return B.with_meta(bank, curated).select(
        "question_id",
        F.array_join("wrong_choice_tags", ",", "-").alias("tags"),
        F.get(F.map_values("remediation_hint"), F.lit(0)).alias("hint"),
    )


@query("subject_bank", with_bank("SELECT question_id, skill_id, difficulty FROM bank WHERE subject = 'life'"))
def subject_bank(t):
    return t.bank.where(F.col("subject") == "life").select("question_id", "skill_id", "difficulty")


@query("bank_written", with_bank("SELECT question_id, skill_id, difficulty, hint FROM bank WHERE subject = 'math'"))
def bank_written(t):
    """The bank written by subject and one subject read back."""
    root = note_folder(t.spark, f"{checkpoint_root(t.spark).rstrip('/')}/learnloom/bank_{uuid.uuid4().hex}")
    bank_text.write_bank(t.bank, root)
    return t.spark.read.parquet(root).where("subject = 'math'").select("question_id", "skill_id", "difficulty", "hint")


@query(
    "bank_counts",
    with_bank(
        f"""SELECT s.subject, count(b.question_id) AS n
        FROM (SELECT unnest({sql_list(K.SUBJECTS)}) AS subject) s LEFT JOIN bank b USING (subject) GROUP BY s.subject"""
    ),
)
def bank_counts(t):
    return B.bank_counts(t.bank).select("subject", "n")


@query(
    "skill_catalogue",
    with_bank(
        """SELECT subject, skill_id, count(*) AS n_questions,
        row_number() OVER (PARTITION BY subject ORDER BY min(ordinal)) AS skill_no
        FROM bank GROUP BY subject, skill_id"""
    ),
)
def skill_catalogue(t):
    from pyspark.sql import Window

    order = Window.partitionBy("subject").orderBy("skill_ordinal")
    return B.skill_catalogue(t.bank).select(
        "subject", "skill_id", "n_questions", F.row_number().over(order).cast("bigint").alias("skill_no")
    )


@query(
    "skill_difficulty_counts",
    with_bank("SELECT subject, skill_id, difficulty, count(*) AS n FROM bank GROUP BY ALL"),
)
def skill_difficulty_counts(t):
    return t.bank.groupBy("subject", "skill_id", "difficulty").agg(F.count("*").alias("n"))


@query("skill_tags", with_bank(f"SELECT question_id, {SKILL_TAG} AS tag FROM bank"))
def skill_tags(t):
    return t.bank.select("question_id", skill_tag().alias("tag"))


@query(
    "tagged_questions",
    with_bank(
        """SELECT tag, subject, count(*) AS n FROM (
        SELECT DISTINCT question_id, subject, unnest(wrong_choice_tags) AS tag FROM bank) WHERE tag IS NOT NULL
        GROUP BY tag, subject"""
    ),
)
def tagged_questions(t):
    return B.tagged_questions(t.bank).groupBy("tag", "subject").agg(F.count("*").alias("n"))


@query(
    "choice_numbers",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (2, 3) THEN NULL WHEN p_partkey % 5 = 4 THEN -CAST(p_size AS DOUBLE)
      ELSE CAST(p_size AS DOUBLE) END AS number FROM part""",
)
def choice_numbers(t):
    size = F.col("p_size").cast("string")
    forms = F.array(
        F.concat(size, F.lit("えん")),
        F.concat(F.lit("約 "), size, F.lit(".")),
        F.concat(size, F.lit("-"), size),
        F.lit("いぬ"),
        F.concat(F.lit("- "), size, F.lit("こ")),
    )
    return t.table("part").select("p_partkey", S.choice_number(F.get(forms, (F.col("p_partkey") % 5).cast("int"))).alias("number"))


@query(
    "answer_scalars",
    with_log(
        """SELECT event_id,
      CAST(greatest(0, least(100, latency_ms // 100)) AS BIGINT) AS clamped,
      CAST(floor(latency_ms / 7 + 0.5) AS BIGINT) AS rounded,
      floor(latency_ms / 7 * 100 + 0.5) / 100 AS fixed2,
      CASE WHEN hour(t) BETWEEN 5 AND 10 THEN 'morning' WHEN hour(t) BETWEEN 11 AND 17 THEN 'daytime' ELSE 'night' END AS part,
      CAST(year(t) AS BIGINT) * 1000000 + month(t) * 10000 + day(t) * 100 + hour(t) * 4 + minute(t) // 15 AS slot,
      latency_ms // 100 + 1 AS lvl, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%m-%d') AS label,
      choices[selected_index + 1] AS chosen, choices[answer_index + 1] AS expected,
      wrong_choice_tags[selected_index + 1] AS chosen_tag
    FROM (SELECT *, make_timestamp(answered_ms * 1000) AS t FROM answers)"""
    ),
)
def answer_scalars(t):
    ts, ms = F.timestamp_millis("answered_ms"), F.col("latency_ms")
    return t.answers.select(
        "event_id",
        S.clamp(F.floor(ms / 100), 0, 100).alias("clamped"),
        S.js_round(ms / 7).alias("rounded"),
        S.to_fixed(ms / 7, 2).alias("fixed2"),
        S.day_part(ts).alias("part"),
        S.slot_key(ts).alias("slot"),
        S.level(ms).alias("lvl"),
        S.play_date(ts).alias("day"),
        S.month_day(ts).alias("label"),
        S.at("choices", "selected_index").alias("chosen"),
        S.at("choices", "answer_index").alias("expected"),
        S.at("wrong_choice_tags", "selected_index").alias("chosen_tag"),
    )


@query(
    "tag_texts",
    with_log(
        f"""SELECT event_id, error_tag, {sql_map('TAG_LABELS', 'error_tag')} AS label,
        {sql_map('TAG_FEEDBACK', 'error_tag')} AS feedback, {sql_map('TAG_HINTS', 'error_tag')} AS hint
        FROM log WHERE NOT correct"""
    ),
)
def tag_texts(t):
    return with_tag_texts(t.log.where("not correct").select("event_id", "error_tag")).drop("tag_ordinal")


TOKENS = [t for tokens in D.ICONS.values() for t in tokens] + list(D.ALIASES) + ["なぞ"]
_ICON_CASES = " ".join(f"WHEN '{t}' THEN '{i}'" for g in D.ICONS.values() for t, i in g.items())
_CATEGORY_CASES = " ".join(f"WHEN '{t}' THEN '{c}'" for c, g in D.ICONS.items() for t in g)
_ALIAS_CASES = " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in D.ALIASES.items())


@query(
    "token_lookup",
    f"""SELECT p_partkey, canonical, CASE canonical {_ICON_CASES} END AS icon, CASE canonical {_CATEGORY_CASES} END AS category
    FROM (SELECT p_partkey, CASE token {_ALIAS_CASES} ELSE token END AS canonical
      FROM (SELECT p_partkey, {sql_list(TOKENS)}[p_partkey % {len(TOKENS)} + 1] AS token FROM part))""",
)
def token_lookup(t):
    tokens = F.array(*[F.lit(v) for v in TOKENS])
    padded = F.concat(F.lit("  "), F.get(tokens, (F.col("p_partkey") % len(TOKENS)).cast("int")), F.lit(" "))
    return B.lookup_tokens(t.table("part").select("p_partkey", padded.alias("token"))).drop("token")


_SCENES = ", ".join(f"('{s}', '{ti}', '{bg}', '{','.join(tags)}', '{','.join(toks)}')" for s, ti, bg, tags, toks in D.SCENES)


@query(
    "scene_lookup",
    with_bank(
        f"""SELECT question_id, title, background, tags, tokens FROM bank
        LEFT JOIN (VALUES {_SCENES}) v(skill_id, title, background, tags, tokens) USING (skill_id)"""
    ),
)
def scene_lookup(t):
    return B.with_scene(t.bank.select("question_id", "skill_id")).select(
        "question_id",
        "title",
        "background",
        F.array_join("tags", ",").alias("tags"),
        F.array_join("default_tokens", ",").alias("tokens"),
    )
