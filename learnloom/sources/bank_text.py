"""Question bank text files: a pipe-delimited table between two marker lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnloom.operators.bank import validate_bank
from learnloom.operators.sequence import number_rows, top_rows

# Marker lines around the table.
START = "<!-- QUESTION_TABLE_START -->"
END = "<!-- QUESTION_TABLE_END -->"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value). Files are read in splits; ``line_no`` grows within a file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value"
    )
    return lines.withColumn("line_no", F.struct("_start", F.monotonically_increasing_id().alias("id"))).drop("_start")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(file, ordinal, cells): table rows between the markers, header and separator skipped.

    The markers are found by an aggregate per file and the rows numbered by a range
    partitioned pass, so a file is never gathered into one row or task.
    """
    marks = lines.groupBy("file").agg(
        F.min(F.when(F.contains("value", F.lit(START)), F.col("line_no"))).alias("_from"),
        F.min(F.when(F.contains("value", F.lit(END)), F.col("line_no"))).alias("_to"),
    )
    table = (
        lines.join(marks, "file")
        .where((F.col("line_no") > F.col("_from")) & (F.col("line_no") < F.col("_to")))
        .withColumn("value", F.trim("value"))
        .where(F.col("value").startswith("|"))
        .drop("_from", "_to")
    )
    heading = top_rows(table, ["file"], ["line_no"], 2).groupBy("file").agg(F.max("line_no").alias("_heading"))
    body = table.join(heading, "file").where(F.col("line_no") > F.col("_heading")).drop("_heading")
    split = F.split("value", r"\|")
    cells = F.transform(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))), lambda c: F.trim(c))
    return number_rows(body, ["file"], ["line_no"], "ordinal").select("file", "ordinal", cells.alias("cells"))


def read_bank_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(read_lines(spark, path))


def load_bank(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Parsed and validated bank; ``strict`` fails on the first bad row."""
    return validate_bank(read_bank_text(spark, path), strict)[0]


def write_bank(bank: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per subject, so subject filters prune files."""
    bank.write.mode("overwrite").partitionBy("subject").format(fmt).save(path)
