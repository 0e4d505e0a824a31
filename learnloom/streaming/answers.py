"""Structured Streaming versions of the per-answer operators.

Every function takes and returns a streaming DataFrame; ``run_available`` drives one to
the end of the available input and returns the written result as a batch table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from learnloom import constants as K
from learnloom.functions.tags import infer_error_tag
from learnloom.operators.diagnostics import join_bank
from learnloom.session import checkpoint_root, note_folder


def read_answers(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream of answers with an event-time column; bounds the size of a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("answered_at", F.timestamp_millis("answered_ms"))


def run_available(
    stream: DataFrame,
    keys: list[str] | None = None,
    then: Sequence[Callable[[], None]] = (),
    sink: Callable[[DataFrame, int], None] | None = None,
    progress: Callable[[object], None] | None = None,
) -> DataFrame:
    """Process all available input. With ``keys`` the stream is an aggregate in update mode:
    each batch appends the changed rows and the newest row per key is the result.

    ``then``: after each of these actions (a tick of a clock, more input) the query goes on from its
    checkpoint. ``sink`` also gets every batch with its number; it may see a batch twice.
    ``progress`` gets the progress of every batch.
    """
    spark = stream.sparkSession
    root = note_folder(spark, f"{checkpoint_root(spark).rstrip('/')}/learnloom/stream_{uuid.uuid4().hex}")
    out = f"{root}/out"

    def append(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)  # a retried batch replaces itself
        if sink:
            sink(spark.read.schema(stream.schema).parquet(path), batch_id)

    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch_id=-1")  # no input, no rows
    for action in (None, *then):
        if action:
            action()
        query = (
            stream.writeStream.foreachBatch(append)
            .outputMode("update" if keys else "append")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        for report in query.recentProgress if progress else []:
            progress(report)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(out)
    if not keys:
        return rows.drop("batch_id")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last")).select(*keys, "_last.*")


def tag_answers(stream: DataFrame, bank: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stream-static joins to the bank and a threshold snapshot, then the tag rules."""
    keys = ["learner_id", "subject", "difficulty"]
    joined = join_bank(stream, bank).join(thresholds.select(*keys, "guess_threshold_ms"), keys, "left")
    default = F.lit(K.GUESS_DEFAULT_MS).cast("bigint")
    return joined.withColumn("guess_threshold_ms", F.coalesce("guess_threshold_ms", default)).withColumn(
        "error_tag", infer_error_tag()
    )


def daily_stats(stream: DataFrame, width: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Answers and correct answers per learner and tumbling window; later rows are dropped."""
    return (
        stream.withWatermark("answered_at", lateness)
        .groupBy("learner_id", F.window("answered_at", width))
        .agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
        .select("learner_id", F.col("window.start").alias("window_start"), "total", "correct")
    )


def dedup_answers(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """First answer per (learner, mission, position) within the watermark."""
    return stream.withWatermark("answered_at", lateness).dropDuplicatesWithinWatermark(
        ["learner_id", "mission_no", "pos"]
    )
