"""Streams in several small batches give the batch results."""

import pytest
from pyspark.sql import Row, functions as F

import compare
from learnloom import constants as K
from learnloom.operators import bank as B
from learnloom.operators import diagnostics as D
from learnloom.operators.cooldown import cooldown_filter
from learnloom.plans import stream_queries
from learnloom.plans.replay_queries import folded
from learnloom.sources.state_store import StateStore
from learnloom.sources.testdata import NOW_MS
from learnloom.streaming import answers as ST
from learnloom.streaming import learner as LS


@pytest.fixture(scope="module")
def parts(tables, tmp_path_factory):
    """Finished answers as three files in time order, read one per batch."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    log = tables.log.select(
        "learner_id", "mission_no", "pos", "seq", "question_id", "subject", "skill_id", "difficulty", "correct",
        "selected_index", "latency_ms", "answered_ms", "event_id", "event_type", "mode", "error_tag",
    )
    low, high = log.approxQuantile("answered_ms", [1 / 3, 2 / 3], 0)
    at = F.col("answered_ms")
    for part in (at < low, (at >= low) & (at < high), at >= high):
        log.where(part).coalesce(1).write.mode("append").parquet(path)
    return path, log


def stream(spark, parts):
    return ST.read_answers(spark, parts[0], parts[1].schema, files_per_batch=1)


def same(left, right):
    return compare.spark_rows(left) == compare.spark_rows(right)


def test_tagged_stream_equals_batch(spark, tables, parts):
    thresholds = D.guess_threshold(tables.log, 3)
    got = ST.run_available(ST.tag_answers(stream(spark, parts).drop("error_tag"), tables.bank, thresholds))
    batch = D.tag_answers(
        tables.log.drop("guess_threshold_ms", "error_tag").join(thresholds, ["learner_id", "subject", "difficulty"])
    )
    assert same(got.select("seq", "learner_id", "error_tag"), batch.select("seq", "learner_id", "error_tag"))


STATE = ["learner_id", "subject", "mission_no", "skill_id", "mastery", "before_difficulty", "after_difficulty", "avg_mastery"]


def sizes(tables):
    return {r.subject: r.n for r in B.skill_catalogue(tables.bank).groupBy("subject").agg(F.count("*").alias("n")).collect()}


def test_learner_state_over_batches_equals_replay(spark, tables, parts):
    clock = LS.Clock(spark)
    events = LS.learner_events(clock.ticking(stream(spark, parts)), sizes(tables), "60 days")
    seen = []
    got = ST.run_available(events, sink=lambda rows, batch: seen.append(rows.count()), then=[lambda: clock.advance(NOW_MS + 60 * K.DAY_MS)])
    assert sum(seen[:3]) == 0  # nothing is certain before the clock says so
    assert same(LS.mission_rows(got).select(STATE), folded(tables).select(STATE))


ANSWERS = (
    "learner_id bigint, subject string, mission_no bigint, pos bigint, skill_id string, correct boolean, difficulty int, "
    "error_tag string, mode string, answered_ms bigint"
)


def mission(number, n=5, learner=1, minute=None, skills=2):
    """Answers of a mission, a minute each: the first is wrong."""
    start = K.DAY_MS + (10 * number if minute is None else minute) * K.MINUTE_MS
    return [(learner, "math", number, p, f"s{p % skills}", p > 0, 1, None, "learn", start + p * K.MINUTE_MS) for p in range(n)]


def sent(spark, path, batches, schema=ANSWERS):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return ST.read_answers(spark, path, spark.read.parquet(path).schema, 1)


def test_abandoned_and_repeated_missions(spark, tmp_path):
    """Mission 1 stays incomplete, mission 0 is delivered again after it was folded, mission 5 is
    taken up again hours later."""
    batches = [
        mission(0, 3), mission(0) + mission(1, 4), mission(2), mission(0)[4:] + mission(3), mission(5, 2),
        mission(5, 5, minute=2000)[2:], mission(9, 1, minute=9000),
    ]
    answers = sent(spark, str(tmp_path / "in"), batches)
    got = ST.run_available(LS.mission_rows(LS.learner_events(answers, {"math": 2}, "30 minutes"))).collect()
    assert sorted((r.mission_no, r.skill_id) for r in got) == [(m, s) for m in (0, 2, 3, 5) for s in ("s0", "s1")]


def test_state_of_each_trigger_is_small(spark, tmp_path):
    """A trigger rewrites the entries of the learners it hears of, not all state."""
    first = [row for learner in range(40) for row in mission(0, 5, learner)]
    batches = [first, mission(0, 5, 99, 100), mission(1, 5, 7, 200), mission(0, 5, 98, 400), mission(0, 5, 97, 600)]
    answers = sent(spark, str(tmp_path / "in"), batches)
    progress = []
    events = LS.learner_events(answers, {"math": 2}, "1 minute")
    ST.run_available(events, progress=lambda p: progress.append((p.batchId, p.stateOperators[0].numRowsUpdated, p.stateOperators[0].numRowsTotal)))
    updated = {batch: n for batch, n, _ in progress}
    # batch 2 announces the reviews of all; later ones touch one learner each
    assert updated[0] > 40 and max(n for batch, n, _ in progress if batch >= 3) < 40
    assert progress[-1][2] >= 2 * 40


def test_chained_stream_equals_parts(spark, tables, parts):
    """Thresholds, tags, state and reviews in one query; the ring of answers is cut at 12."""
    clock = LS.Clock(spark)
    bare = stream(spark, parts).drop("error_tag")
    rows = ST.run_available(LS.tagged(clock.ticking(bare), tables.bank, "1 hour", 2, 12), then=[lambda: clock.advance(NOW_MS + K.HOUR_MS)])
    want = D.tag_answers(D.threshold_at_answer(tables.log.drop("guess_threshold_ms"), tables.block_rows, tables.split, 2, 12))
    columns = ["learner_id", "seq", "guess_threshold_ms", "error_tag"]
    assert same(rows.select(columns), want.select(columns))


def test_stored_state_goes_on_in_a_new_stream(spark, tmp_path):
    """The state of one stream is stored; another goes on from it and repeats no review."""
    store = StateStore(spark, str(tmp_path / "state"), LS.STATE_KEYS, merge_after=2)
    early, late = [mission(0), mission(1)], [mission(2), mission(3, minute=3000), mission(9, 1, minute=9000)]
    sink = lambda rows, batch: store.commit(batch, LS.state_tables(rows))
    clock = LS.Clock(spark)
    first = LS.learner_events(clock.ticking(sent(spark, str(tmp_path / "a"), early)), {"math": 2}, "1 minute")
    ended = K.DAY_MS + 18 * K.MINUTE_MS  # the review of the wrong answer is due, that of the right one is not
    head = ST.run_available(first, sink=sink, then=[lambda: clock.advance(ended + K.MINUTE_MS)]).collect()
    saved = LS.initial_state(*(store.read(t) for t in ("skills", "subjects", "reviews")))
    again = LS.learner_events(sent(spark, str(tmp_path / "b"), [early[1], *late]), {"math": 2}, "1 minute", saved)
    tail = ST.run_available(again).collect()
    whole = ST.run_available(LS.learner_events(sent(spark, str(tmp_path / "c"), [*early, *late]), {"math": 2}, "1 minute")).collect()
    key = lambda r: (r.kind, r.mission_no or 0, r.skill_id, r.next_review_at)
    assert sorted(head + tail, key=key) == sorted(whole, key=key)


def test_revisions_take_back_rows(spark, tmp_path):
    columns = "learner_id bigint, mission_no bigint, pos bigint, event_id bigint, seq bigint, answered_ms bigint"
    at = lambda minute: K.DAY_MS + minute * K.MINUTE_MS
    batches = [[(1, 0, 0, 10, 0, at(0)), (1, 0, 1, 11, 1, at(1))], [(1, 0, 0, 12, 2, at(2))], [(1, 0, 0, 10, 0, at(0))], [(1, 0, 1, 9, 3, at(3))]]
    changes = ST.run_available(LS.revised_answers(sent(spark, str(tmp_path / "in"), batches, columns)))
    assert sorted((r.pos, r.event_id, r.change) for r in changes.collect()) == [(0, 10, -1), (0, 10, 1), (0, 12, 1), (1, 9, 1), (1, 11, -1), (1, 11, 1)]
    assert sorted((r.pos, r.event_id) for r in LS.apply_changes(changes).collect()) == [(0, 12), (1, 9)]


def test_no_input_gives_no_rows(spark, tables, tmp_path):
    schema = tables.log.schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stats = ST.run_available(ST.daily_stats(ST.read_answers(spark, str(tmp_path / "in"), schema)), ["learner_id", "window_start"])
    assert stats.count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    day = K.DAY_MS
    # Rows are judged by the watermark of the batch before, so the late row comes a batch later.
    for rows in [[(1, 1, 0), (1, 2, 1)], [(1, 20, 2)], [(1, 20, 3)], [(1, 1, 4), (1, 20, 5)]]:
        df = spark.createDataFrame([(l, True, d * day + s) for l, d, s in rows], "learner_id bigint, correct boolean, answered_ms bigint")
        df.coalesce(1).write.mode("append").parquet(path)
    schema = "learner_id bigint, correct boolean, answered_ms bigint"
    stats = ST.run_available(ST.daily_stats(ST.read_answers(spark, path, schema, 1)), ["learner_id", "window_start"])
    got = {r.d: r.total for r in stats.select((F.unix_millis("window_start") / day).cast("int").alias("d"), "total").collect()}
    assert got == {1: 1, 2: 1, 20: 3}


def test_dedup_keeps_one_answer(spark, tables, parts):
    doubled = stream(spark, parts).unionByName(stream(spark, parts))
    got = ST.run_available(ST.dedup_answers(doubled, "60 days").select("learner_id", "mission_no", "pos"))
    assert same(got, parts[1].select("learner_id", "mission_no", "pos"))


def test_cooldown_stream_equals_batch(spark, tables, parts):
    waits = {"click": 20 * K.HOUR_MS, "view": 5 * K.HOUR_MS}
    clock, left = LS.Clock(spark), []
    events = stream(spark, parts).withColumn("effect", F.col("event_type"))
    got = ST.run_available(
        LS.cooldown_filter(clock.ticking(events), waits), then=[lambda: clock.advance(NOW_MS + K.DAY_MS)],
        progress=lambda p: left.append(p.stateOperators[0].numRowsTotal),
    )
    assert left[-1] == 0 < max(left)  # idle keys hold no state
    pairs = F.create_map(*[F.lit(v) for kv in waits.items() for v in kv])
    batch = tables.log.select(
        "learner_id", F.col("event_type").alias("effect"), "block", "n_blocks", "seq", "event_id", "answered_ms",
        F.coalesce(pairs[F.col("event_type")], F.lit(0)).cast("bigint").alias("wait"),
    )
    kept = cooldown_filter(batch, ["learner_id", "effect"], "answered_ms", "wait").where("accepted")
    assert same(got, kept.select("learner_id", "effect", "event_id", "answered_ms"))


def test_due_reviews_fire_by_watermark(spark, tmp_path):
    """A review fires when time passes it, and a later mission arms it anew."""
    batches = [mission(0, skills=1), mission(0, 5, 2, 8, 1), mission(1, minute=60, skills=1), mission(9, 1, 3, 600)]
    answers = sent(spark, str(tmp_path / "in"), batches)
    got = ST.run_available(LS.due_reviews(LS.learner_events(answers, {"math": 1}, "1 minute")))
    minutes = lambda r: (r.next_review_at - K.DAY_MS) // K.MINUTE_MS
    assert sorted((r.learner_id, r.skill_id, minutes(r), r.streak) for r in got.collect()) == [
        (1, "s0", 4 + 30, 1),
        (1, "s0", 64 + 120, 2),
        (2, "s0", 12 + 30, 1),
    ]


class Kept:
    """A list or value state in memory."""

    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = [*self.rows, *rows]

    def clear(self):
        self.rows = []


class One(Kept):
    def get(self):
        return self.rows or None

    def update(self, row):
        self.rows = row


class Timers:
    """The handle of one key: its states and the timers that were set."""

    def __init__(self):
        self.set = []

    def getListState(self, *_):
        return Kept()

    def getValueState(self, *_):
        return One()

    def registerTimer(self, at):
        self.set.append(at)


class At:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def given(seq):
    return Row(seq=seq, mission_no=seq // 5, pos=seq % 5, subject="math", difficulty=1, correct=True, latency_ms=900, answered_ms=1000 * seq, body="{}")


def fold_row(seq):
    return Row(mission_no=seq // 5, pos=seq % 5, skill_id="s", correct=True, difficulty=1, error_tag=None, mode="learn", answered_ms=1000 * seq)


@pytest.mark.parametrize(
    "processor, key, row, done",
    [
        (LS.Thresholds(3, 200), (1,), given, 25),
        (LS.LearnerEvents({"math": 2}), (1, "math"), fold_row, 5),
        (LS.Cooldowns({"tap": 0}), (1,), lambda n: Row(effect="tap", answered_ms=1000 * n, event_id=n), 25),
    ],
)
def test_a_key_sets_one_timer_a_trigger(processor, key, row, done):
    """However many answers come; when it fires it does all that is due and sets the next."""
    handle = Timers()
    processor.init(handle)
    list(processor.handleInputRows(key, iter([row(n) for n in range(50)]), At(0)))
    assert len(handle.set) == 1
    assert len(list(processor.handleExpiredTimer(key, At(25_000), None))) == done
    assert len(handle.set) == 2 and handle.set[1] > 25_000


def test_a_revision_sent_again_sets_no_timer():
    handle, revisions = Timers(), LS.Revisions(10)
    revisions.init(handle)
    rows = [Row(pos=0, event_id=n, answered_ms=n, seq=n) for n in range(3)]
    first = list(revisions.handleInputRows((1, 1), iter(rows), At(0)))
    assert [tuple(r) for r in first] == [(1, 1, 0, 2, 2, 1)]
    assert list(revisions.handleInputRows((1, 1), iter(rows), At(0))) == []
    assert handle.set == [12]


def test_dedup_query_shuffles_only_what_it_reads(tables, monkeypatch):
    seen = []
    whole = ST.dedup_answers
    monkeypatch.setattr(ST, "dedup_answers", lambda sent, *a: seen.append(sent.columns) or whole(sent, *a))
    stream_queries.stream_dedup(tables)
    assert seen == [["learner_id", "mission_no", "pos", "answered_at"]]
