"""Error tagging, guess thresholds and dashboard rates over the answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from learnloom import constants as K
from learnloom.functions.scalars import clamp, js_round
from learnloom.functions.tags import infer_error_tag
from learnloom.operators.sequence import neighbour, top_rows, with_halo

LEARNER_BLOCK = ["learner_id", "block"]


PLACE = ["subject", "skill_id", "difficulty"]  # what an answer trace says about its question
ITEM = ["choices", "answer_index", "wrong_choice_tags"]


def join_bank(answers: DataFrame, bank: DataFrame) -> DataFrame:
    """Question columns by id. No broadcast hint: the optimizer checks the bank's size,
    and beyond the threshold AQE splits a hot question's partition.

    Traces that name subject, skill and difficulty keep them, and an answer whose question has
    left the bank stays (its tag then comes from the rules). Bare answers take all from the bank.
    """
    if set(PLACE) <= set(answers.columns):
        return answers.drop(*ITEM).join(bank.select("question_id", *ITEM), "question_id", "left")
    return answers.join(bank.select("question_id", *PLACE, *ITEM), "question_id")


def wrong_tagged() -> Column:
    """Wrong answers whose cause is known."""
    return ~F.col("correct") & F.col("error_tag").isNotNull()


def _threshold(median: Column, samples: Column, min_samples: int) -> Column:
    dynamic = js_round(clamp(median * K.GUESS_FACTOR, float(K.GUESS_MIN_MS), float(K.GUESS_MAX_MS)))
    return F.when(samples < min_samples, F.lit(K.GUESS_DEFAULT_MS).cast("bigint")).otherwise(dynamic)


def guess_threshold(log: DataFrame, min_samples: int = K.GUESS_MIN_SAMPLES) -> DataFrame:
    """Snapshot threshold per (learner, subject, difficulty).

    Equal latencies are counted before the shuffle. Once the upper middle value reaches
    twice max/factor the clamp returns its maximum whatever the value is, so larger
    latencies are merged there: the exact median needs at most that many counters,
    however many answers a group holds.
    """
    ceiling = int(2 * K.GUESS_MAX_MS / K.GUESS_FACTOR)
    keys = ["learner_id", "subject", "difficulty"]
    sample = F.col("correct") & (F.col("latency_ms") > 0)
    counts = (
        log.withColumn("_latency", F.when(sample, F.least("latency_ms", F.lit(ceiling).cast("bigint"))))
        .groupBy(*keys, "_latency")
        .agg(F.count("_latency").alias("_n"))
    )
    return (
        counts.groupBy(*keys)
        .agg(
            F.sum("_n").alias("samples"),
            F.percentile("_latency", 0.5, F.greatest("_n", F.lit(1))).alias("_median"),
        )
        .withColumn("guess_threshold_ms", _threshold(F.col("_median"), F.col("samples"), min_samples))
        .drop("_median")
    )


def threshold_at_answer(
    log: DataFrame,
    block_rows: int,
    split: bool = True,
    min_samples: int = K.GUESS_MIN_SAMPLES,
    retention: int = K.LOG_RETENTION,
) -> DataFrame:
    """Threshold visible when each answer was given: the last ``retention`` answers of
    earlier finished missions plus the answers already given in this mission."""
    reach = retention + K.MISSION_SIZE - 1
    rows = with_halo(log, reach, block_rows, split, columns=["learner_id", "subject", "difficulty", "correct", "latency_ms"])
    window = (
        Window.partitionBy("learner_id", "block", "subject", "difficulty")
        .orderBy("seq")
        .rangeBetween(-reach, -1)
    )
    sample = F.when(F.col("correct") & (F.col("latency_ms") > 0), F.struct("seq", "latency_ms"))
    oldest = F.col("seq") - F.col("pos") - retention
    rows = rows.withColumn("_seen", F.collect_list(sample).over(window)).where(~F.col("is_halo"))
    rows = rows.withColumn("_oldest", oldest).withColumn(
        "_sorted", F.array_sort(F.transform(F.filter("_seen", lambda s: s.seq >= F.col("_oldest")), lambda s: s.latency_ms))
    )
    n = F.size("_sorted")
    low, high = F.get("_sorted", F.floor((n - 1) / 2).cast("int")), F.get("_sorted", F.floor(n / 2).cast("int"))
    return rows.withColumn(
        "guess_threshold_ms", _threshold((low + high) / 2, n, min_samples)
    ).drop("_seen", "_sorted", "_oldest", "is_halo")


def tag_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("error_tag", infer_error_tag())


def recurrence_flags(log: DataFrame, lookahead: int = K.RECURRENCE_LOOKAHEAD, split: bool = True) -> DataFrame:
    """Wrong tagged answers with ``recurrent``: same subject and tag wrong again within the
    next ``lookahead`` answers, counted over all subjects."""
    errors = log.where(wrong_tagged())
    linked = neighbour(errors, ["learner_id", "subject", "error_tag"], "seq", {"seq": F.col("seq")}, split=split)
    return linked.withColumn(
        "recurrent", F.coalesce(F.col("next.seq") - F.col("seq") <= lookahead, F.lit(False))
    ).drop("next")


def recurrence_rate(log: DataFrame, lookahead: int = K.RECURRENCE_LOOKAHEAD, split: bool = True) -> DataFrame:
    flags = recurrence_flags(log, lookahead, split)
    hits = flags.groupBy("learner_id").agg(
        F.count("*").alias("errors"), F.count_if("recurrent").alias("recurrent")
    )
    return hits.withColumn("recurrence_rate", F.col("recurrent") / F.col("errors"))


def retry_outcomes(log: DataFrame, split: bool = True) -> DataFrame:
    """Next attempt on the same subject and skill after each answer (forward as-of)."""
    return neighbour(
        log,
        ["learner_id", "subject", "skill_id"],
        "seq",
        {"seq": F.col("seq"), "correct": F.col("correct")},
        split=split,
        name="retry",
    )


def retry_success(log: DataFrame, split: bool = True) -> DataFrame:
    errors = retry_outcomes(log, split).where(wrong_tagged())
    counts = errors.groupBy("learner_id").agg(
        F.count("retry.seq").alias("opportunities"), F.count_if(F.col("retry.correct")).alias("successes")
    )
    rate = F.when(F.col("opportunities") == 0, 0.0).otherwise(F.col("successes") / F.col("opportunities"))
    return counts.withColumn("retry_success_rate", rate)


def top_error_tag(log: DataFrame) -> DataFrame:
    """Most frequent wrong tag per learner; ties go to the tag seen first."""
    counts = log.where(wrong_tagged()).groupBy("learner_id", "error_tag").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )
    return top_rows(counts, ["learner_id"], [F.desc("n"), "first_seq"], 1).drop("rank")


def dashboard(log: DataFrame, split: bool = True) -> DataFrame:
    """Per learner: error count, recurrence, retry success and top error; 0 when no errors."""
    learners = log.groupBy("learner_id").agg(F.count("*").alias("answers"))
    return (
        learners.join(recurrence_rate(log, split=split), "learner_id", "left")
        .join(retry_success(log, split), "learner_id", "left")
        .join(top_error_tag(log).select("learner_id", F.col("error_tag").alias("top_error_tag")), "learner_id", "left")
        .na.fill(0, ["errors", "recurrent", "opportunities", "successes"])
        .na.fill(0.0, ["recurrence_rate", "retry_success_rate"])
    )


def daily_stats(log: DataFrame) -> DataFrame:
    """Answers, correct answers and mission seconds per learner and UTC day of finish."""
    from learnloom.operators.missions import mission_summary

    return (
        mission_summary(log)
        .withColumn("date", F.date_format(F.timestamp_millis("finished_ms"), "yyyy-MM-dd"))
        .groupBy("learner_id", "date")
        .agg(
            F.sum("total").alias("total"),
            F.sum("correct").alias("correct"),
            F.sum("duration_sec").alias("duration_sec"),
        )
    )
