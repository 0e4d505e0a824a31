"""Line dedup against plain Python and SQL; the perfect hash and its arrays."""

import hashlib

import compare
import duckdb
import numpy as np
from fixtures import SF_DIR
from pyspark.sql import functions as F

from learnloom.llm import line_dedup as L
from learnloom.llm.queries import ORACLE, QUERIES

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, shard long, kept_text string, lost int, n_lines string, doc long"


def key(line):
    found = line.strip(WHITE).translate(LOWER)
    return found if len(found) >= 10 else None


def expected(rows):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(L.LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = lambda k: k is not None and len(holders[k]) > 1 and min(holders[k]) != (L.LAST if doc is None else doc)
        kept = [x for x in lines if not gone(key(x))]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "kept_text", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def rows():
    common, accents = "The common line of all", "éàüßñçøåéàü"
    many = [(i, f"line {i} of its own\n{common} \n\t{common.upper()}\nshort\n{'x' * (i % 30)}") for i in range(20, 60)]
    return many + [
        (1, f"{common}\n{common}\n\n{accents}"),  # smallest holder keeps both
        (2, f"{accents}\r\n{'Ä' * 10}\n{'é' * 9}"),
        (3, f"{accents.upper()}\n{'Ä' * 10}\n{'é' * 9}"),  # only A-Z are lower-cased
        (4, None), (5, ""), (6, "\n\n \n"), (7, " " + common), (8, "nul\x00 in a long line"), (9, "nul\x00 in a long line"),
        (10, f"twice here twice here\n{'z' * 300_000}"), (11, "Z" * 300_000), (12, "same row, same document"), (12, "same row, same document"),
        (None, f"{common}\nno number either way"), (None, "no number either way\nno number, one document"), (13, " no number EITHER way\n"),
    ]


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "k", 2, "x", 3) for r in data], SCHEMA).repartition(3)


def test_awkward_lines(spark):
    got = L.drop_repeated_lines(table(spark, rows()))
    assert [c for c in got.columns if c in ("shard", "lost", "doc")] == ["shard", "lost", "doc"]
    assert {(r.shard, r.lost, r.doc) for r in got.collect()} == {(1, 2, 3)}
    assert found(got) == expected(rows())


def test_small_tasks_and_packets(spark, monkeypatch):
    """Every few keys are sent on their own: holders meet in the arrays only."""
    docs = table(spark, rows())
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    import pyarrow as pa

    text = pa.table({"doc": [d if d is not None else L.LAST for d, _ in rows()], "text": [t for _, t in rows()]}).to_batches(max_chunksize=1)
    monkeypatch.setattr(L, "PACKET", 2)
    monkeypatch.setattr(L, "TASK_KEYS", 1)
    assert sum(len(h) for _, h in L._collected(iter(text))) == len({(d, key(x)) for d, t in rows() for x in (t or "").split("\n")} - {(d, None) for d, _ in rows()}) + 2
    probes = [r for b in L._probes(3)(iter(text)) for r in zip(*b.to_pydict().values())]
    assert all(len(data) <= 2 * L.PROBE.itemsize for _, _, data in probes)
    assert found(L.drop_repeated_lines(docs)) == expected(rows())


def test_no_documents(spark):
    assert L.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        keys[: n // 3, 0] = 7  # equal first halves part by the second
        table = L.PerfectHash.build(keys)
        again = L.PerfectHash.unpacked(*table.packed())
        assert sorted(again.index(keys).tolist()) == list(range(n))
        counts, holders = np.arange(n) + 2, rng.integers(0, 99, n)
        shard = L.Shard.read(L.Shard.build(keys, counts, holders).record())
        assert (shard.look_up(keys)[0] == counts).all() and (shard.look_up(keys)[1] == holders).all()
        others = rng.integers(0, 1 << 63, (1000, 2)).astype(np.uint64)
        assert not shard.look_up(others)[0].any()


def test_lines_sql(spark):
    con = duckdb.connect()
    docs = table(spark, rows()).select("doc_id", "text")
    arrow = docs.toArrow()
    con.register("documents", arrow)
    assert compare.difference(L.drop_repeated_lines(docs).drop("kept_text", "text"), con, L.SQL) is None


def test_query(spark, oracle):
    assert compare.difference(QUERIES["op12_line_dedup"](spark, SF_DIR), oracle, ORACLE["op12_line_dedup"]) is None
