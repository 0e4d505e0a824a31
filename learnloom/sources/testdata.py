"""Adapter: star-schema test tables -> bank, answers and missions.

``part`` becomes the question bank (every part is a question) and ``events`` the answer
log (every event is an answer). The same mapping exists as SQL in ``plans.oracle``.
"""

from __future__ import annotations

import time as clock
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnloom import constants as K
from learnloom.functions.scalars import epoch_ms, js_round
from learnloom.operators import diagnostics, sequence, skills
from learnloom.operators.bank import skill_catalogue
from learnloom.session import bucket_count, checkpoint_root, delete_path, hash_spread, materialise, note_folder, use_utc

# Six skills per subject, including every skill that a tag rule or fact parser names.
SKILLS = [
    ["add_within10", "add_within20", "compare_numbers", "sub_within10", "word_math", "fractions_basic"],
    ["opposite_words", "character_recognition", "hiragana_order", "sentence_context", "vocabulary_picture", "word_context"],
    ["clock_hour", "clock_half", "money_value", "money_sum", "money_change", "safety_road"],
    ["route_optimization", "odd_one_out", "pattern_next", "logic_order", "maze_path", "matching"],
]
SLICE_FILES = 2  # files of one slice of a file stream
NOW_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    subject = (key % 4).cast("int")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    skills = F.array(*[strings(s) for s in SKILLS])
    base = F.array(size.cast("string"), (size + 1).cast("string"), (size + 3).cast("string"))
    tags = strings(K.TAGS)
    part = part.withColumn("answer_index", (F.floor(key / 4) % 3).cast("int"))
    turn = lambda i: F.get(base, (F.lit(i + 3) - F.col("answer_index")) % 3)
    return part.select(
        key.cast("string").alias("question_id"),
        F.get(strings(K.SUBJECTS), subject).alias("subject"),
        F.get(F.get(skills, subject), brand % 6).alias("skill_id"),
        (size % 5 + 1).alias("difficulty"),
        F.col("p_name").alias("prompt"),
        F.array(turn(0), turn(1), turn(2)).alias("choices"),
        "answer_index",
        F.col("p_type").alias("hint"),
        key.alias("ordinal"),
        F.when(
            key % 3 != 0,
            F.array(
                F.get(tags, size % 12),
                F.get(tags, (size + 5) % 12),
                F.when(key % 7 != 1, F.get(tags, (size + 10) % 12)),
            ),
        ).alias("wrong_choice_tags"),
    )


def raw_answers(events: DataFrame) -> DataFrame:
    correct = F.col("event_type").isin("click", "view", "purchase")
    return events.select(
        F.col("user_id").alias("learner_id"),
        epoch_ms(F.col("ts").cast("timestamp")).alias("answered_ms"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("answered_us"),
        "event_id",
        "event_type",
        correct.alias("correct"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        js_round(F.col("value") * 100).alias("latency_ms"),
    )


def build_answers(
    spark: SparkSession,
    sf_dir: str,
    block_rows: int = sequence.BLOCK_ROWS,
    events: DataFrame | None = None,
) -> DataFrame:
    """All answers with seq, mission, block and question columns (not yet diagnosed)."""
    raw = raw_answers(read(spark, sf_dir, "events") if events is None else events)
    per_subject = read(spark, sf_dir, "part").agg(F.floor(F.count("*") / 4).alias("per_subject"))
    numbered = sequence.number_rows(raw, ["learner_id"], ["answered_us", "event_id"])
    numbered = sequence.with_blocks(numbered, block_rows=block_rows)
    mission = F.floor(F.col("seq") / K.MISSION_SIZE)
    numbered = (
        numbered.crossJoin(F.broadcast(per_subject))  # one row
        .withColumn("mission_no", mission)
        .withColumn("pos", F.col("seq") % K.MISSION_SIZE)
        .withColumn(
            "question_id", (F.col("event_id") % F.col("per_subject") * 4 + F.col("mission_no") % 4).cast("string")
        )
        .withColumn("finished", F.col("mission_no") < F.floor(F.col("n_rows") / K.MISSION_SIZE))
        .withColumn("mode", F.get(strings(K.MODES), (F.col("mission_no") % 3).cast("int")))
        .withColumn("target_difficulty", (F.col("mission_no") % 5 + 1).cast("int"))
        .drop("per_subject", "n_rows")
    )
    joined = diagnostics.join_bank(numbered, bank(spark, sf_dir))
    return joined.withColumn(
        "selected_index",
        F.when(F.col("correct"), F.col("answer_index")).otherwise(
            (F.col("answer_index") + 1 + F.col("k") % 2) % 3
        ),
    ).drop("k")


@dataclass
class Tables:
    """Inputs of one data set; the diagnosed answers are written on first use.

    ``log`` holds finished missions only: an abandoned mission leaves no trace.
    """

    spark: SparkSession
    sf_dir: str
    block_rows: int = sequence.BLOCK_ROWS
    events: DataFrame | None = None
    _derived: dict = field(default_factory=dict)

    def with_block_rows(self, block_rows: int) -> "Tables":
        """The same data in blocks of another size."""
        if block_rows not in self._derived:
            self._derived[block_rows] = Tables(self.spark, self.sf_dir, block_rows, self.events)
        return self._derived[block_rows]

    @cached_property
    def buckets(self) -> int:
        files = listing(self.spark, f"{self.sf_dir}/events.parquet")
        return bucket_count(self.spark, sum(size for _, size, _ in files))

    @cached_property
    def split(self) -> bool:
        """Does any learner own more than one block?"""
        counts = self.table("events").groupBy("user_id").count()
        return not counts.where(F.col("count") > self.block_rows).isEmpty()

    @cached_property
    def answers(self) -> DataFrame:
        """All answers with threshold and tag, bucketed by (learner, block).

        Spread by the bucket keys first: the threshold windows and the bucketed write then
        need no further shuffle. With several blocks per learner the rows are written before
        they are tagged, since each block also reads the end of the one before.
        """
        by = ["learner_id", "block"]
        answers = build_answers(self.spark, self.sf_dir, self.block_rows, self.events)
        answers = materialise(answers, by, buckets=self.buckets) if self.split else hash_spread(answers, by, self.buckets)
        tagged = diagnostics.tag_answers(diagnostics.threshold_at_answer(answers, self.block_rows, self.split))
        unfinished = {c: F.when(F.col("finished"), F.col(c)) for c in ("guess_threshold_ms", "error_tag")}
        return materialise(tagged.withColumns(unfinished), by, partitioned=not self.split, buckets=self.buckets)

    @cached_property
    def outcomes(self) -> DataFrame:
        """Last answer per (mission, skill), bucketed like the answers."""
        return materialise(skills.skill_outcomes(self.log), ["learner_id", "block"], partitioned=True, buckets=self.buckets)

    @cached_property
    def skill_states(self) -> DataFrame:
        return materialise(skills.skill_states(self.outcomes, self.split))

    @cached_property
    def misconceptions(self) -> DataFrame:
        return materialise(skills.misconception_fold(self.outcomes))

    def once(self, name: str, build) -> DataFrame:
        """A derived table, written on first use."""
        if name not in self._derived:
            self._derived[name] = materialise(build())
        return self._derived[name]

    def sliced(self, name: str, rows: DataFrame, time: str, order: list[int], slices: int) -> tuple[str, DataFrame]:
        """Folder with ``rows`` cut into ``slices`` by time, put there in the given order, so that
        a file stream reads one slice after the other. Returned with the rows (their schema).
        The rows are read and written once, however many slices there are and however often each comes."""
        if name not in self._derived:
            path = note_folder(self.spark, f"{checkpoint_root(self.spark).rstrip('/')}/learnloom/{name}_{uuid.uuid4().hex}")
            cuts = rows.approxQuantile(time, [i / slices for i in range(1, slices)], 0.001)
            part = sum(((F.col(time) >= c).cast("int") for c in cuts), F.lit(0))
            file = F.col("_slice") * SLICE_FILES + F.pmod(F.xxhash64(time), F.lit(SLICE_FILES))
            cut = rows.withColumn("_slice", part).where("_slice is not null").repartitionById(slices * SLICE_FILES, file.cast("int"))
            cut.write.partitionBy("_slice").parquet(f"{path}_cut")
            copy_in_order(self.spark, [f"{path}_cut/_slice={i}" for i in order], path)
            delete_path(self.spark, f"{path}_cut")
            self._derived[name] = path
        return self._derived[name], rows

    @property
    def bank(self) -> DataFrame:
        return bank(self.spark, self.sf_dir)

    @property
    def catalogue(self) -> DataFrame:
        return self.once("catalogue", lambda: skill_catalogue(self.bank))

    @property
    def log(self) -> DataFrame:
        return self.answers.where("finished")

    def table(self, name: str) -> DataFrame:
        if name == "events" and self.events is not None:
            return self.events
        return read(self.spark, self.sf_dir, name)


def copy_in_order(spark: SparkSession, folders: list[str], path: str) -> None:
    """Copy the Parquet files of each folder to ``path``, each folder later than the one before by the files' times."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    system.mkdirs(target)
    for turn, folder in enumerate(folders):
        source, latest = jvm.org.apache.hadoop.fs.Path(folder), 0
        for file in system.listStatus(source) if system.exists(source) else []:
            to = jvm.org.apache.hadoop.fs.Path(f"{path}/{turn:04d}-{file.getPath().getName()}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(system, file.getPath(), system, to, False, conf)
            latest = max(latest, system.getFileStatus(to).getModificationTime())
        wait_past(latest)


def wait_past(ms: int) -> None:
    while clock.time_ns() // 1_000_000 <= ms:
        clock.sleep(0.001)


_PREPARED: dict[tuple, Tables] = {}


def listing(spark: SparkSession, path: str) -> tuple:
    """Files of a table: path, size and time of change."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """One ``Tables`` per session and state of the files it is derived from."""
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir, *(listing(spark, f"{sf_dir}/{t}.parquet") for t in ("events", "part")))
    if key not in _PREPARED:
        _PREPARED[key] = Tables(spark, sf_dir)
    return _PREPARED[key]
