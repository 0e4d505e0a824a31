"""Error-cause rules and tag texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnloom import constants as K
from learnloom.functions.scalars import at, choice_number

# Skills whose wrong answers have one usual cause.
MATH_SKILL_TAGS = {"compare_numbers": "math_place_value_confusion", "word_math": "math_operation_confusion"}
MATH_PREFIX_TAGS = {"sub_": "math_operation_confusion", "add_": "math_counting_slip"}
WORD_SKILL_TAGS = {
    "opposite_words": "jp_antonym_confusion",
    "character_recognition": "jp_sound_confusion",
    "hiragana_order": "jp_sound_confusion",
    "sentence_context": "jp_particle_confusion",
}
VOCABULARY_SKILLS = ["vocabulary_picture", "word_context"]


def _first_match(cases: list, default: Column) -> Column:
    rule = default
    for condition, tag in reversed(cases):
        rule = F.when(condition, tag).otherwise(rule)
    return rule


def _math_rule(skill: Column) -> Column:
    cases = [(skill == name, tag) for name, tag in MATH_SKILL_TAGS.items()]
    cases += [(skill.startswith(prefix), tag) for prefix, tag in MATH_PREFIX_TAGS.items()]
    return _first_match(cases, F.lit("attention_slip"))


def _word_rule(skill: Column, default: Column) -> Column:
    return _first_match([(skill == name, tag) for name, tag in WORD_SKILL_TAGS.items()], default)


def skill_tag(subject="subject", skill="skill_id") -> Column:
    """Default tag of a question, from its skill."""
    return F.when(F.col(subject) == "math", _math_rule(F.col(skill))).otherwise(
        _word_rule(F.col(skill), F.lit("jp_vocab_meaning_confusion"))
    )


def infer_error_tag(
    subject="subject",
    skill="skill_id",
    choices="choices",
    answer_index="answer_index",
    tags="wrong_choice_tags",
    selected="selected_index",
    correct="correct",
    latency="latency_ms",
    threshold="guess_threshold_ms",
) -> Column:
    """Likely cause of a wrong answer: curated tag, fast guess, then subject rules."""
    picked = choice_number(at(choices, selected))
    right = choice_number(at(choices, answer_index))
    vocabulary = F.when(F.col(skill).isin(VOCABULARY_SKILLS), "jp_vocab_meaning_confusion").otherwise(
        "attention_slip"
    )
    rules = F.when(
        F.col(subject) == "math",
        F.when(F.abs(picked - right) == 1, "math_counting_slip").otherwise(_math_rule(F.col(skill))),
    ).otherwise(_word_rule(F.col(skill), vocabulary))
    return F.when(
        ~F.col(correct),
        F.coalesce(
            at(tags, selected),
            F.when(F.col(latency) < F.col(threshold), "unknown_guess"),
            rules,
        ),
    )


def tag_texts(spark: SparkSession) -> DataFrame:
    """12-row dimension: tag, ordinal, label, feedback, hint."""
    rows = [
        (tag, i, K.TAG_LABELS[tag], K.TAG_FEEDBACK[tag], K.TAG_HINTS[tag]) for i, tag in enumerate(K.TAGS)
    ]
    return spark.createDataFrame(rows, "tag string, tag_ordinal int, label string, feedback string, hint string")


def with_tag_texts(df: DataFrame, tag: str = "error_tag") -> DataFrame:
    """Left join to the tag texts (12 fixed rows, so broadcasting is bounded)."""
    texts = tag_texts(df.sparkSession).withColumnRenamed("tag", tag)
    return df.join(F.broadcast(texts), tag, "left")
