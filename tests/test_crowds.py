"""Keys that share a crowd are run together: few state calls, the same results."""

import json

import pytest
from pyspark.sql import functions as F

from learnloom.llm import components as cc
from learnloom.sources import testdata
from learnloom.streaming import learner as LS
from test_streaming import At, Kept, One, Timers, fold_row, given


class Counted(Timers):
    """A handle whose states count their calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def counted(self, state):
        def call(name, whole):
            def run(*args):
                self.calls += 1
                return whole(*args)

            setattr(state, name, run)

        for name in ("get", "put", "appendList", "clear"):
            call(name, getattr(state, name))
        return state

    def getListState(self, *_):
        return self.counted(Kept())

    def getValueState(self, *_):
        return self.counted(One())


CASES = {
    "thresholds": (lambda: LS.Thresholds(3, 200), lambda n: (n,), given, False),
    "events": (lambda: LS.LearnerEvents({"math": 2}), lambda n: (n, "math"), fold_row, True),
    "cooldowns": (lambda: LS.Cooldowns({"tap": 0}), lambda n: (n,), lambda n: LS.Row(effect="tap", answered_ms=1000 * n, event_id=n), True),
    "revisions": (lambda: LS.Revisions(10), lambda n: (n, 1), lambda n: LS.Row(pos=n % 5, event_id=n, answered_ms=n, seq=n), True),
}


class Expiry:
    def __init__(self, at):
        self.getExpiryTimeInMs = lambda: at


@pytest.mark.parametrize("case", CASES)
def test_calls_do_not_grow_with_the_learners(case):
    """Two triggers of 40 learners: the rows of a processor per key, with the calls of one crowd."""
    make, key_of, row_of, packed = CASES[case]
    wanted, handles = [], {}
    for n in range(40):
        handles[n] = Timers(), make()
        handles[n][1].init(handles[n][0])
    handle, crowd = Counted(), LS.Crowd(make(), len(key_of(0)), packed)
    crowd.init(handle)
    got = []
    for first, watermark in ((0, 12_000), (25, 50_000)):
        sent = [(key_of(n), row_of(i)) for i in range(first, first + 25) for n in range(40)]
        for n, (timers, processor) in handles.items():
            wanted += processor.handleInputRows(key_of(n), iter([r for k, r in sent if k == key_of(n)]), At(0))
            passed = [t for t in timers.set if t <= watermark]
            if passed:
                wanted += processor.handleExpiredTimer(key_of(n), At(watermark), Expiry(max(passed)))
        bodies = [json.dumps({f"k{i}": v for i, v in enumerate(k)} | r.asDict()) for k, r in sent]
        got += crowd.handleInputRows((0,), iter([LS.Row(crowd=0, body=b) for b in bodies]), At(0))
        got += crowd.handleExpiredTimer((0,), At(watermark), None)
    if packed:
        got = [tuple(r.values()) for found in got for r in json.loads(found.found)]
    plain = lambda rows: sorted(json.dumps(list(r), default=str) for r in rows)
    assert wanted and plain(got) == plain(wanted)
    assert handle.calls < 40


def test_a_crowd_without_live_keys_keeps_nothing():
    handle, crowd = Timers(), LS.Crowd(LS.Cooldowns({"tap": 0}), 1, True)
    crowd.init(handle)
    bodies = [json.dumps({"learner_id": n, "effect": "tap", "event_id": n, "answered_ms": 1000}) for n in range(40)]
    list(crowd.handleInputRows((0,), iter([LS.Row(body=b) for b in bodies]), At(0)))
    assert any(log.stored.rows for log in crowd.logs)
    list(crowd.handleExpiredTimer((0,), At(2000), None))
    assert not any(log.stored.rows for log in crowd.logs)


def test_slices_come_in_order_and_whole(spark, tables):
    """Rows are cut once; a file stream takes the files by time of change."""
    rows = spark.range(1000).select("id", (F.col("id") * 1000).alias("at"))
    path, _ = testdata.Tables(spark, tables.sf_dir).sliced("cut", rows, "at", [1, 0, 0, 1], 2)
    files = sorted((time, name.rsplit("/", 1)[-1]) for name, _, time in testdata.listing(spark, path) if name.endswith(".parquet"))
    assert [int(name[:4]) for _, name in files] == [0, 0, 1, 1, 2, 2, 3, 3]
    low = [spark.read.parquet(*[f"{path}/{name}" for _, name in files if name.startswith(f"{turn:04d}")]).agg(F.min("id"), F.count("*")).first() for turn in range(4)]
    assert [r[0] == 0 for r in low] == [False, True, True, False]
    assert sum(r[1] for r in low) == 2000


def test_components_are_joined_without_broadcasts(spark):
    """The driver builds a broadcast whole, and these grow with the input."""
    edges = spark.createDataFrame([(3, 1), (2, 1), (5, 4)], "u long, v long")
    for step in (cc._large_star, cc._small_star):
        assert "Broadcast" not in step(edges)._jdf.queryExecution().executedPlan().toString()
