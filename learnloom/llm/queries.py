"""Registered queries ``opN_<name>``: each operator with its production parameters over its
whole table, and the SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnloom.llm import backoff, conversations, fingerprints, html_text, jaccard_join, language, line_dedup, mixing, packing, quality_rules, spelling, suffix_dedup, warc
from learnloom.llm.common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    network = language.fit(documents)
    guess = language.identify(documents.select("doc_id", "text"), network)
    return guess.select("doc_id", (language.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(read(spark, sf_dir, "documents"), order=backoff.ORDER)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(read(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), spelling.DAMAGE))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_rules": op2_quality_rules,
    "op3_language": op3_language,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_text": op5_html_text,
    "op6_backoff": op6_backoff,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_warc": op9_warc,
    "op10_pack": op10_pack,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE: dict[str, str] = {
    "op1_fingerprints": fingerprints.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op9_warc": warc.SQL,
    "op12_line_dedup": line_dedup.SQL,
}
