"""Streaming queries, run to the end of the available input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from learnloom import constants as K
from learnloom.operators import diagnostics as D
from learnloom.operators import replay as R
from learnloom.operators import skills as SK
from learnloom.plans.oracle import error_tag, threshold, with_log
from learnloom.plans.registry import ORACLE, query
from learnloom.plans.replay_queries import EFFECT, WAITS, loop_sql
from learnloom.plans.skill_queries import BASE, SCHEDULE
from learnloom.session import checkpoint_root, note_folder
from learnloom.sources.state_store import StateStore
from learnloom.sources.testdata import NOW_MS, SLICE_FILES
from learnloom.streaming import answers as ST
from learnloom.streaming import learner as LS


SLICES = 4  # micro-batches of the registered streams, in time order
MIXED = [x for k in range(0, 12, 2) for x in (k + 1, k, k, k + 1)]  # out of order and delivered twice


def answer_stream(t, order: list[int] | None = None, slices: int = SLICES):
    """Answers as a file stream, one slice of time per micro-batch."""
    name = "stream_answers" + ("_mixed" if order else "")
    path, rows = t.sliced(name, t.answers, "answered_ms", order or list(range(slices)), slices)
    return ST.read_answers(t.spark, path, rows.schema, files_per_batch=SLICE_FILES)


def finished(t, *order):
    return answer_stream(t, *order).where("finished")


@query(
    "stream_tagged",
    with_log(
        f"""SELECT learner_id, seq, guess_threshold_ms, {error_tag('guess_threshold_ms')} AS error_tag FROM (
          SELECT * EXCLUDE (guess_threshold_ms, error_tag), {threshold('med', 'n', 3)} AS guess_threshold_ms FROM (
          SELECT *, count(*) FILTER (correct AND latency_ms > 0) OVER w AS n,
            median(latency_ms) FILTER (correct AND latency_ms > 0) OVER w AS med FROM log
          WINDOW w AS (PARTITION BY learner_id, subject, difficulty)))"""
    ),
)
def stream_tagged(t):
    rows = finished(t).drop("guess_threshold_ms", "error_tag")
    tagged = ST.tag_answers(rows, t.bank, D.guess_threshold(t.log, 3))
    return ST.run_available(tagged.select("learner_id", "seq", "guess_threshold_ms", "error_tag"))


WINDOW_SQL = """SELECT learner_id, {start} AS start_ms, count(*) AS total, count(*) FILTER (correct) AS correct
  FROM log GROUP BY ALL"""


def windowed(t, width):
    stats = ST.run_available(ST.daily_stats(finished(t), width), ["learner_id", "window_start"])
    return stats.select("learner_id", F.unix_millis("window_start").alias("start_ms"), "total", "correct")


@query("stream_daily", with_log(WINDOW_SQL.format(start="answered_ms // 86400000 * 86400000")))
def stream_daily(t):
    return windowed(t, "1 day")


@query("stream_quarter_hours", with_log(WINDOW_SQL.format(start="answered_ms // 900000 * 900000")))
def stream_quarter_hours(t):
    return windowed(t, "15 minutes")


@query("stream_dedup", with_log("SELECT learner_id, mission_no, pos FROM log"))
def stream_dedup(t):
    """The answer file is read twice (as if sent twice); one answer per place stays."""
    place = ["learner_id", "mission_no", "pos"]
    # The de-duplication shuffles whole rows, so only what is read goes in.
    sent = finished(t).unionByName(finished(t)).select(*place, "answered_at")
    return ST.run_available(ST.dedup_answers(sent).select(*place))


LEARNER_SQL = loop_sql(
    """SELECT l.learner_id, l.subject, l.mission_no, x.skill AS skill_id, x.mastery AS mastery, s.streak, s.next_review_at,
      l.before_difficulty, l.after_difficulty, l.avg_mastery, l.unresolved AS unresolved_index, r.earned_xp, r.earned_stars
    FROM (SELECT *, unnest(st) AS x FROM loop WHERE n > 0) l
    JOIN schedule s ON s.learner_id = l.learner_id AND s.skill_id = x.skill AND s.mission_no = l.mission_no
    JOIN replayed r ON r.learner_id = l.learner_id AND r.mission_no = l.mission_no""",
    SCHEDULE,
)


def skill_counts(t) -> dict[str, int]:
    return {r.subject: r.n for r in t.catalogue.groupBy("subject").agg(F.count("*").alias("n")).collect()}


def until_now(t, build, lateness_ms: int = K.HOUR_MS, **options):
    """Run ``build(clock)`` over all input; then the clock says that it is NOW."""
    clock = LS.Clock(t.spark)
    return ST.run_available(build(clock), then=[lambda: clock.advance(NOW_MS + lateness_ms)], **options)


@query("stream_learner_state", LEARNER_SQL)
def stream_learner_state(t):
    return LS.mission_rows(until_now(t, lambda clock: LS.learner_events(clock.ticking(finished(t)), skill_counts(t))))


@query("stream_learner_state_redelivered", LEARNER_SQL)
def stream_learner_state_redelivered(t):
    """Every slice twice and out of order, within the lateness."""
    build = lambda clock: LS.learner_events(clock.ticking(finished(t, MIXED, 12)), skill_counts(t), "8 days")
    return LS.mission_rows(until_now(t, build, 8 * K.DAY_MS))


@query(
    "stream_due_reviews",
    with_log(
        f"""SELECT learner_id, skill_id, next_review_at, streak FROM (
          SELECT *, lead(now_ms) OVER (PARTITION BY learner_id, skill_id ORDER BY mission_no) AS next_ms FROM schedule)
        WHERE next_review_at < {NOW_MS} AND (next_ms IS NULL OR next_review_at <= next_ms)""",
        *BASE,
        SCHEDULE,
    ),
)
def stream_due_reviews(t):
    """One query from bare answers: thresholds and tags, adaptive state, reviews."""

    def build(clock):
        answers = clock.ticking(finished(t).drop("guess_threshold_ms", "error_tag"))
        return LS.learner_events(LS.tagged(answers, t.bank), skill_counts(t), None)

    return LS.due_reviews(until_now(t, build))


@query("stream_thresholds", ORACLE["guess_threshold_pit_min3"])
def stream_thresholds(t):
    """The threshold at each answer, from the answers before it, and the tag that follows."""
    bare = finished(t).drop("guess_threshold_ms", "error_tag")
    rows = until_now(t, lambda clock: LS.tagged(clock.ticking(bare), t.bank, min_samples=3))
    return rows.select("learner_id", "seq", "guess_threshold_ms", "error_tag")


def state_store(t, name: str, tables) -> StateStore:
    """A new store in the session's folder."""
    path = note_folder(t.spark, f"{checkpoint_root(t.spark).rstrip('/')}/learnloom/{name}_{uuid.uuid4().hex}")
    return StateStore(t.spark, path, {k: LS.STATE_KEYS[k] for k in tables}, merge_after=3)


@query("state_streamed", ORACLE["replay_skill_state"].replace(", s.seen_count", ""))
def state_streamed(t):
    """Skill state that a stream has stored batch by batch, every batch sent twice."""
    store = state_store(t, "state", LS.STATE_KEYS)

    def sink(events, batch_id: int) -> None:
        for _ in range(2):
            store.commit(batch_id, LS.state_tables(events))

    until_now(t, lambda clock: LS.learner_events(clock.ticking(finished(t)), skill_counts(t)), sink=sink)
    return store.read("skills").drop("tags")


@query("stream_resumed", ORACLE["replay_resumed"])
def stream_resumed(t):
    """The first missions are folded in batch and their state stored; a stream goes on from it."""
    early = t.outcomes.where("mission_no < 7")
    first = R.Replay(early, t.catalogue)
    store = state_store(t, "resumed", ("skills", "subjects"))
    store.commit(0, LS.batch_state(first.state(), early, SK.latest_schedule(early, t.split)))
    saved = LS.initial_state(store.read("skills"), store.read("subjects"))

    def build(clock):
        later = clock.ticking(finished(t).where("mission_no >= 7"))
        return LS.learner_events(later, skill_counts(t), initial=saved)

    columns = ["learner_id", "subject", "mission_no", "before_difficulty", "after_difficulty", "avg_mastery", "unresolved_index"]
    rows = LS.mission_rows(until_now(t, build))
    return first.missions().select(columns).unionByName(rows.select(columns)).distinct()


@query("stream_revised", ORACLE["answers_deduped"])
def stream_revised(t):
    """The second answer of each mission revises the first; slices come twice and out of order."""
    sent = finished(t, MIXED, 12).withColumn("pos", F.when(F.col("pos") < 2, 0).otherwise(F.col("pos")).cast("long"))
    changes = ST.run_available(LS.revised_answers(sent, "8 days", 8 * K.DAY_MS))
    return LS.apply_changes(changes).select("learner_id", "mission_no", "pos", "event_id")


@query("stream_cooldown", ORACLE["cooldown_filter"].replace(
    "SELECT learner_id, event_id, accepted FROM gate WHERE n > 0", "SELECT learner_id, event_id FROM gate WHERE accepted"
))
def stream_cooldown(t):
    """Slices come twice and out of order."""
    pairs = F.create_map(*[F.lit(v) for kv in EFFECT.items() for v in kv])

    def build(clock):
        events = answer_stream(t, MIXED, 12).withColumn("effect", F.coalesce(pairs[F.col("event_type")], F.lit("wrong")))
        return LS.cooldown_filter(clock.ticking(events), WAITS, "8 days")

    return until_now(t, build, 8 * K.DAY_MS).select("learner_id", "event_id")
