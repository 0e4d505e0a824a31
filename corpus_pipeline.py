"""Documents -> packed training sequences.

Each stage reads what the one before kept, written as Parquet:

1. ``language_id``: documents without a letter or without a clear language go.
2. ``near_duplicates``: of every group of linked documents the smallest doc_id stays.
3. ``repeated_passages``: strings that occur earlier are cut out of the texts; a document of
   which nothing but white space is left goes.
4. ``mix_sources``: documents are repeated or left out so that sources reach their targets.
5. ``pack``: token sequences, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnloom.llm import jaccard_join, language, mixing, packing, suffix_dedup
from learnloom.llm.common import WHITE, read
from learnloom.session import Scratch

LEAST_SCORE = 0.3  # of the predicted language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    guess = language.identify(docs, language.fit(docs))
    clear = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return guess.where(clear).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(f"[^{WHITE}]"))
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumns(changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None  # a trained network, byte-level cuts and token ids; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        following = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
