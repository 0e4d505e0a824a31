"""Question bank: validation, metadata, catalogue, counts and token lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnloom import constants as K
from learnloom import dictionary as D
from learnloom.functions.tags import skill_tag

CELLS = ["id", "subject", "skill_id", "difficulty", "prompt", "choice1", "choice2", "choice3", "answer_index", "hint"]
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def cell_number(cell: Column) -> Column:
    """Number written in a cell; an empty cell counts as 0, other text as null."""
    return (
        F.when(cell == "", F.lit(0.0))
        .when(cell.rlike(_DECIMAL), cell.try_cast("double"))
        .when(cell.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(cell, 3, 64), 16, 10).try_cast("double"))
    )


def once(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _integer_in(number: Column, lo: int, hi: int) -> Column:
    return F.coalesce((number == F.floor(number)) & number.between(lo, hi), F.lit(False))


def check_cells(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Add the parsed columns and ``reasons``, the list of broken rules of each row."""
    number = lambda cell: once(cell, cell_number)

    def parsed(row: Column) -> Column:
        cell = {name: F.get(row, F.lit(i)) for i, name in enumerate(CELLS)}
        numbers = [number(cell[name]).alias(f"n_{name}") for name in ("difficulty", "answer_index")]
        return F.struct(*[c.alias(f"c_{name}") for name, c in cell.items()], *numbers, F.size(row).alias("n_cells"))

    def broken(row: Column) -> Column:
        ten = row.n_cells == len(CELLS)
        checks = {
            "columns": ~ten,
            "id": ten & (row.c_id == ""),
            "subject": ten & ~row.c_subject.isin(K.SUBJECTS),
            "skill_id": ten & (row.c_skill_id == ""),
            "difficulty": ten & ~_integer_in(row.n_difficulty, K.MIN_DIFFICULTY, K.MAX_DIFFICULTY),
            "answer_index": ten & ~_integer_in(row.n_answer_index, 0, 2),
        }
        return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for reason, bad in checks.items()]))

    names = [*[f"c_{name}" for name in CELLS], "reasons", "n_difficulty", "n_answer_index"]
    read = once(F.col(cells), parsed)
    row = once(read, lambda r: F.struct(*[r[n].alias(n) if n != "reasons" else broken(r).alias(n) for n in names]))
    return rows.withColumn("_row", row).withColumns({n: F.col("_row")[n] for n in names}).drop("_row")


def validate_bank(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) bank rows from rows with a ``cells`` array (and ``ordinal``)."""
    checked = check_cells(rows)
    good = F.size("reasons") == 0
    if strict:
        checked = checked.withColumn(
            "reasons",
            F.when(good, F.col("reasons")).otherwise(
                F.raise_error(F.concat(F.lit("bad bank row: "), F.array_join("reasons", ", ")))
            ),
        )
    keep = [c for c in rows.columns if c != "cells"]
    accepted = checked.where(good).select(
        *keep,
        F.col("c_id").alias("question_id"),
        F.col("c_subject").alias("subject"),
        F.col("c_skill_id").alias("skill_id"),
        F.col("n_difficulty").cast("int").alias("difficulty"),
        F.col("c_prompt").alias("prompt"),
        F.array("c_choice1", "c_choice2", "c_choice3").alias("choices"),
        F.col("n_answer_index").cast("int").alias("answer_index"),
        F.col("c_hint").alias("hint"),
    )
    return accepted, checked.where(~good).select(*keep, "cells", "reasons")


def curated_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.CURATED_TAGS.items()), "question_id string, curated array<string>")


def with_meta(bank: DataFrame, curated: DataFrame) -> DataFrame:
    """Wrong-choice tags of every question: a curated row replaces the default, which is the
    skill's tag three times with its remediation hint."""
    tag = skill_tag()
    hints = F.create_map(*[F.lit(v) for pair in K.TAG_HINTS.items() for v in pair])
    base = bank.drop("wrong_choice_tags").join(curated, "question_id", "left")
    return (
        base.withColumn("_tag", tag)
        .withColumn("wrong_choice_tags", F.coalesce("curated", F.array_repeat("_tag", 3)))
        .withColumn(
            "remediation_hint", F.when(F.col("curated").isNull(), F.create_map("_tag", hints[F.col("_tag")]))
        )
        .drop("_tag", "curated")
    )


def tagged_questions(bank: DataFrame) -> DataFrame:
    """One row per question and distinct wrong-choice tag."""
    return bank.withColumn("tag", F.explode(F.array_distinct(F.array_compact("wrong_choice_tags"))))


def subjects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(K.SUBJECTS)], "subject string, subject_ordinal int")


def bank_counts(bank: DataFrame) -> DataFrame:
    """Questions per subject; a subject without questions shows 0. Four fixed subjects."""
    counts = bank.groupBy("subject").agg(F.count("*").alias("n"))
    return (
        subjects(bank.sparkSession).join(counts, "subject", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    )


def skill_catalogue(bank: DataFrame) -> DataFrame:
    """Distinct skills per subject in bank order."""
    return bank.groupBy("subject", "skill_id").agg(
        F.min("ordinal").alias("skill_ordinal"), F.count("*").alias("n_questions")
    )


def token_table(spark: SparkSession) -> DataFrame:
    rows = [(t, icon, c) for c, tokens in D.ICONS.items() for t, icon in tokens.items()]
    return spark.createDataFrame(rows, "canonical string, icon string, category string")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(D.ALIASES.items()), "token string, alias_of string")


def scene_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        D.SCENES, "skill_id string, title string, background string, tags array<string>, default_tokens array<string>"
    )


def lookup_tokens(df: DataFrame, token: str = "token") -> DataFrame:
    """Trim, resolve the alias, then icon and category; unknown tokens give null. The
    dictionaries are fixed text tables, so broadcasting them is bounded."""
    spark = df.sparkSession
    aliases = alias_table(spark).withColumnRenamed("token", "_trimmed")
    return (
        df.withColumn("_trimmed", F.trim(token))
        .join(F.broadcast(aliases), "_trimmed", "left")
        .withColumn("canonical", F.coalesce("alias_of", "_trimmed"))
        .join(F.broadcast(token_table(spark)), "canonical", "left")
        .drop("_trimmed", "alias_of")
    )


def with_scene(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(scene_table(df.sparkSession)), "skill_id", "left")


def visual_coverage(facts: DataFrame) -> DataFrame:
    return facts.groupBy("subject").agg(
        F.count("*").alias("questions"), F.count("kind").alias("with_visual")
    )

