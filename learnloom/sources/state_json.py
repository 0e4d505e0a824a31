"""Exported learner state: JSON in, typed tables out, tables back to storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from learnloom import constants as K
from learnloom.functions.scalars import clamp, js_round
from learnloom.operators.sequence import top_rows

STATE_VERSION = 3
_RAW_MAP = T.MapType(T.StringType(), T.StringType())


def parse(json) -> Column:
    """Variant of a JSON text: typed, so a quoted number stays a string. Parsed once per row."""
    return F.try_parse_json(F.col(json) if isinstance(json, str) else json)


def _part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def number_or(value: Column, name: str, fallback) -> Column:
    """JSON numbers only; anything else is the fallback."""
    part = _part(value, name)
    numeric = _kind(part).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(F.when(numeric, F.try_variant_get(part, "$", "double")), F.lit(fallback))


def _text(value: Column, name: str) -> Column:
    """String fields only."""
    part = _part(value, name)
    return F.when(_kind(part) == "STRING", F.try_variant_get(part, "$", "string"))


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


def _per_subject(states: DataFrame, key: str, json: str, part: str, item) -> DataFrame:
    parsed = states.where(F.col(json).isNotNull()).select(key, _part(parse(json), part).alias("_v"))
    return parsed.select(key, F.inline(F.array(*[item(F.col("_v"), s) for s in K.SUBJECTS])))


def subject_clears(states: DataFrame, key: str, json: str = "state") -> DataFrame:
    def item(value, subject):
        return F.struct(F.lit(subject).alias("subject"), number_or(value, subject, 0.0).alias("clears"))

    return _per_subject(states, key, json, "subjectClears", item)


def adaptive_states(states: DataFrame, key: str, json: str = "state") -> DataFrame:
    """Target difficulty rounded and clamped to 1..5, mission count at least 0."""

    def item(value, subject):
        raw = _part(value, subject)
        return F.struct(
            F.lit(subject).alias("subject"),
            clamp(js_round(number_or(raw, "targetDifficulty", 1.0)), 1, 5).cast("int").alias("target_difficulty"),
            F.greatest(F.lit(0).cast("bigint"), js_round(number_or(raw, "missionCount", 0.0))).alias("mission_count"),
        )

    return _per_subject(states, key, json, "adaptiveBySubject", item)


def skill_table(states: DataFrame, now_ms: int, key: str, json: str = "state") -> DataFrame:
    """One row per skill entry that is an object, with defaults for broken numbers."""
    text = F.from_json(F.get_json_object(F.col(json), "$.skillProgress"), _RAW_MAP)
    rows = states.select(key, F.explode(text).alias("skill_id", "_text"))
    rows = rows.select(key, "skill_id", "_text", parse("_text").alias("_v")).where(_is_object(F.col("_v")))
    value, tag = F.col("_v"), _text(F.col("_v"), "lastErrorTag")
    return rows.select(
        key,
        "skill_id",
        number_or(value, "mastery", K.DEFAULT_MASTERY).alias("mastery"),
        number_or(value, "streak", 0.0).alias("streak"),
        number_or(value, "nextReviewAt", float(now_ms)).alias("next_review_at"),
        number_or(value, "seenCount", 0.0).alias("seen_count"),
        F.when(tag.isin(K.TAGS), tag).alias("last_error_tag"),
        F.get_json_object("_text", "$.misconceptions").alias("misconceptions"),
    )


def misconception_table(skills: DataFrame, now_ms: int, key: str) -> DataFrame:
    """Tag states of ``skill_table`` rows; unknown tags and non-objects are dropped. The
    ordinal keeps the order of the text, which decides ties (a variant would sort its keys)."""
    text = F.from_json("misconceptions", _RAW_MAP)
    rows = skills.select(key, "skill_id", F.posexplode(F.map_entries(text)).alias("ordinal", "_e"))
    rows = rows.select(key, "skill_id", "ordinal", F.col("_e.key").alias("tag"), parse(F.col("_e.value")).alias("_v"))
    rows = rows.where(F.col("tag").isin(K.TAGS) & _is_object(F.col("_v")))
    names = {
        "error_count": ("errorCount", 0.0),
        "recent_error_count": ("recentErrorCount", 0.0),
        "resolved_streak": ("resolvedStreak", 0.0),
        "priority": ("priority", 0.0),
        "due_at": ("dueAt", float(now_ms)),
        "last_seen_at": ("lastSeenAt", float(now_ms)),
    }
    return rows.select(
        key, "skill_id", "ordinal", "tag", *[number_or(F.col("_v"), n, d).alias(c) for c, (n, d) in names.items()]
    )


def recent_question_table(states: DataFrame, key: str, json: str = "state") -> DataFrame:
    """(subject, position, question id); entries that are not strings are dropped."""

    def item(value, subject):
        texts = F.filter(F.try_variant_get(value, f"$.{subject}", "array<variant>"), lambda v: _kind(v) == "STRING")
        ids = F.transform(texts, lambda v: F.variant_get(v, "$", "string"))
        return F.struct(F.lit(subject).alias("subject"), ids.alias("ids"))

    rows = _per_subject(states, key, json, "recentQuestionIdsBySubject", item)
    return rows.select(key, "subject", F.posexplode("ids").alias("position", "question_id"))


def trace_table(states: DataFrame, key: str, json: str = "state") -> DataFrame:
    """Raw answer traces, one row per element with its position."""
    traces = F.try_variant_get(_part(parse(json), "diagnosticLogs"), "$", "array<variant>")
    return states.select(key, F.posexplode(traces).alias("seq", "v")).select(key, "seq", F.to_json("v").alias("trace"))


def _truthy(value: Column, name: str) -> Column:
    """False for false, 0, empty text, null and a missing field; true otherwise."""
    part = _part(value, name)
    kind, text = _kind(part), F.try_variant_get(part, "$", "string")
    falsy = (
        (kind == "VOID")
        | ((kind == "BOOLEAN") & (text == "false"))
        | ((kind == "STRING") & (text == ""))
        | (kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & (text.try_cast("double") == 0))
    )
    return F.coalesce(kind.isNotNull() & ~falsy, F.lit(False))


def load_answers(traces: DataFrame, now_ms: int, key: str, n: int = K.LOG_RETENTION, trace: str = "trace") -> DataFrame:
    """Typed answers from trace JSON: invalid subjects or ids drop the row, broken numbers
    take defaults, unknown tags become null, and the last ``n`` per key stay."""
    value = F.col("_v")
    numbers = "answeredAt double, difficulty double, selectedIndex double, latencyMs double"
    strict = {"allowNonNumericNumbers": "false"}
    parsed = traces.select(
        key, "seq", parse(trace).alias("_v"), F.from_json(trace, numbers, strict).alias("_n")
    )
    tag = _text(value, "errorTag")
    fields = F.struct(
        F.coalesce("_n.answeredAt", F.lit(float(now_ms))).cast("bigint").alias("answered_ms"),
        _text(value, "subject").alias("subject"),
        _text(value, "questionId").alias("question_id"),
        _text(value, "skillId").alias("skill_id"),
        F.coalesce("_n.difficulty", F.lit(1.0)).alias("difficulty"),
        F.coalesce("_n.selectedIndex", F.lit(0.0)).alias("selected_index"),
        _truthy(value, "correct").alias("correct"),
        F.coalesce("_n.latencyMs", F.lit(0.0)).alias("latency_ms"),
        F.when(tag.isin(K.TAGS), tag).alias("error_tag"),
    )
    # As a generator, so that the filter below is not pushed down and parsed again per use.
    typed = parsed.select(key, "seq", F.inline(F.array(fields)))
    rows = typed.where(F.col("subject").isin(K.SUBJECTS) & F.col("question_id").isNotNull() & F.col("skill_id").isNotNull())
    return top_rows(rows, [key], [F.desc("seq")], n).drop("rank")


def normalize_state(states: DataFrame, now_ms: int, key: str, json: str = "state") -> dict[str, DataFrame]:
    """All typed tables of an exported state."""
    skills = skill_table(states, now_ms, key, json)
    return {
        "subject_clears": subject_clears(states, key, json),
        "adaptive": adaptive_states(states, key, json),
        "skills": skills.drop("misconceptions"),
        "misconceptions": misconception_table(skills, now_ms, key),
        "recent_questions": recent_question_table(states, key, json),
        "answers": load_answers(trace_table(states, key, json), now_ms, key),
    }


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """One versioned Parquet table per part; every table is replaced as a whole."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/version={STATE_VERSION}/{name}")


def read_state(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={STATE_VERSION}/{name}")
