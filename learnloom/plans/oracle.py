"""SQL form of the test-data adapter, shared by the oracle queries."""

from __future__ import annotations

from learnloom import constants as K
from learnloom.sources.testdata import NOW_MS, SKILLS


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_map(name: str, column: str) -> str:
    """CASE expression of a constant text table."""
    table = getattr(K, name)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


SKILL_LISTS = "[" + ", ".join(sql_list(s) for s in SKILLS) + "]"

SKILL_TAG = """
CASE WHEN subject = 'math' THEN CASE
  WHEN skill_id = 'compare_numbers' THEN 'math_place_value_confusion'
  WHEN skill_id = 'word_math' OR skill_id LIKE 'sub\\_%' ESCAPE '\\' THEN 'math_operation_confusion'
  WHEN skill_id LIKE 'add\\_%' ESCAPE '\\' THEN 'math_counting_slip'
  ELSE 'attention_slip' END
ELSE CASE
  WHEN skill_id = 'opposite_words' THEN 'jp_antonym_confusion'
  WHEN skill_id IN ('character_recognition', 'hiragana_order') THEN 'jp_sound_confusion'
  WHEN skill_id = 'sentence_context' THEN 'jp_particle_confusion'
  ELSE 'jp_vocab_meaning_confusion' END END
"""


def error_tag(threshold: str) -> str:
    return f"""
CASE WHEN correct THEN NULL
  WHEN wrong_choice_tags[selected_index + 1] IS NOT NULL THEN wrong_choice_tags[selected_index + 1]
  WHEN latency_ms < {threshold} THEN 'unknown_guess'
  WHEN subject = 'math' AND abs(TRY_CAST(choices[selected_index + 1] AS DOUBLE)
       - TRY_CAST(choices[answer_index + 1] AS DOUBLE)) = 1 THEN 'math_counting_slip'
  WHEN subject <> 'math' AND skill_id NOT IN ('opposite_words', 'character_recognition', 'hiragana_order',
       'sentence_context', 'vocabulary_picture', 'word_context') THEN 'attention_slip'
  ELSE {SKILL_TAG} END"""


def threshold(median: str, samples: str, min_samples: int) -> str:
    return f"""CASE WHEN {samples} < {min_samples} THEN 900 ELSE
  CAST(floor(greatest(700.0, least(1400.0, {median} * 0.35::DOUBLE)) + 0.5) AS BIGINT) END"""


BANK = f"""
bank AS MATERIALIZED (
  SELECT *, [base[(3 - answer_index) % 3 + 1], base[(4 - answer_index) % 3 + 1],
             base[(5 - answer_index) % 3 + 1]] AS choices
  FROM (
    SELECT CAST(p_partkey AS VARCHAR) AS question_id,
      {sql_list(K.SUBJECTS)}[p_partkey % 4 + 1] AS subject,
      {SKILL_LISTS}[p_partkey % 4 + 1][CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 6 + 1] AS skill_id,
      p_size % 5 + 1 AS difficulty, p_name AS prompt, p_type AS hint,
      CAST((p_partkey // 4) % 3 AS INT) AS answer_index, p_partkey AS ordinal,
      [CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR), CAST(p_size + 3 AS VARCHAR)] AS base,
      CASE WHEN p_partkey % 3 <> 0 THEN [
        {sql_list(K.TAGS)}[p_size % 12 + 1], {sql_list(K.TAGS)}[(p_size + 5) % 12 + 1],
        CASE WHEN p_partkey % 7 <> 1 THEN {sql_list(K.TAGS)}[(p_size + 10) % 12 + 1] END] END AS wrong_choice_tags
    FROM part))"""


def answers(min_samples: int = K.GUESS_MIN_SAMPLES) -> str:
    return f"""{BANK},
numbered AS (
  SELECT user_id AS learner_id, epoch_us(ts) // 1000 AS answered_ms, event_id, event_type,
    event_type IN ('click', 'view', 'purchase') AS correct,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS latency_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    count(*) OVER (PARTITION BY user_id) AS n_rows
  FROM events),
placed AS (
  SELECT *, seq // 5 AS mission_no, seq % 5 AS pos,
    CAST((event_id % (SELECT count(*) // 4 FROM part)) * 4 + (seq // 5) % 4 AS VARCHAR) AS question_id,
    seq // 5 < n_rows // 5 AS finished,
    {sql_list(K.MODES)}[(seq // 5) % 3 + 1] AS mode,
    CAST((seq // 5) % 5 + 1 AS INT) AS target_difficulty
  FROM numbered),
answers AS MATERIALIZED (
  SELECT p.*, b.* EXCLUDE (question_id, ordinal, prompt, hint, base),
    CASE WHEN correct THEN b.answer_index ELSE (b.answer_index + 1 + k % 2) % 3 END AS selected_index
  FROM placed p JOIN bank b USING (question_id)),
pit AS MATERIALIZED (
  SELECT *, {threshold('median_latency', 'samples', min_samples)} AS guess_threshold_ms
  FROM (
    SELECT *,
      count(*) FILTER (correct AND latency_ms > 0) OVER w AS samples,
      median(latency_ms) FILTER (correct AND latency_ms > 0) OVER w AS median_latency
    FROM answers WHERE finished
    WINDOW w AS (PARTITION BY learner_id, subject, difficulty ORDER BY seq
                 RANGE BETWEEN 200 + pos PRECEDING AND 1 PRECEDING))),
log AS MATERIALIZED (SELECT *, {error_tag('guess_threshold_ms')} AS error_tag FROM pit)"""


MISSIONS = """
missions AS MATERIALIZED (
  SELECT learner_id, mission_no, any_value(subject) AS subject, any_value(mode) AS mode,
    any_value(target_difficulty) AS target_difficulty,
    count(*) AS total, count(*) FILTER (correct) AS correct,
    count(*) FILTER (correct) / count(*) AS accuracy,
    CAST(sum(difficulty) AS BIGINT) / count(*) AS avg_difficulty,
    min(answered_ms) AS started_ms, max(answered_ms) AS finished_ms,
    greatest(10, CAST(floor((max(answered_ms) - min(answered_ms)) / 1000 + 0.5) AS BIGINT)) AS duration_sec
  FROM log GROUP BY learner_id, mission_no),
rewarded AS MATERIALIZED (
  SELECT *, strftime(make_timestamp(finished_ms * 1000), '%Y-%m-%d') AS play_day,
    10 * correct + CASE mode WHEN 'challenge' THEN 12 WHEN 'review' THEN 8 ELSE 5 END
      + CAST(floor(correct / total * 10 + 0.5) AS BIGINT) + CAST(floor(avg_difficulty * 2 + 0.5) AS BIGINT) AS earned_xp,
    correct + CASE WHEN correct = total THEN 3 ELSE 1 END AS earned_stars
  FROM missions)"""

# Last outcome per (mission, skill): the one that updates the skill.
OUTCOMES = """
outcomes AS MATERIALIZED (
  SELECT * EXCLUDE (rn, finished_ms_), finished_ms_ AS now_ms FROM (
    SELECT l.*, m.finished_ms AS finished_ms_,
      row_number() OVER (PARTITION BY l.learner_id, l.mission_no, skill_id ORDER BY pos DESC) AS rn
    FROM log l JOIN missions m USING (learner_id, mission_no)) WHERE rn = 1)"""


def with_log(body: str, *extra: str, min_samples: int = K.GUESS_MIN_SAMPLES, recursive: bool = False) -> str:
    ctes = ",".join([answers(min_samples), *extra])
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def with_bank(body: str, *extra: str) -> str:
    return f"WITH {','.join([BANK, *extra])}\n{body}"


NOW = str(NOW_MS)
