"""Fingerprints, quality rules and backoff scores."""

import math
from collections import Counter

import compare
import pytest
from fixtures import SF_DIR, WORD
from pyspark.sql import functions as F

from learnloom.llm import backoff, fingerprints, quality_rules
from learnloom.llm.common import text_bytes
from learnloom.llm.queries import ORACLE, QUERIES
from learnloom.llm.shingles import span_hashes, word_spans


@pytest.mark.parametrize("name", ["op1_fingerprints", "op2_quality_rules"])
def test_query_against_sql(spark, oracle, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), oracle, ORACLE[name]) is None


def test_fingerprints_of_awkward_texts(awkward, duck):
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    con = duck(documents=rows.select("doc_id", "text"))
    assert compare.difference(fingerprints.fingerprints(rows), con, fingerprints.SQL) is None


def test_fingerprints_of_repeated_and_missing_ids(awkward, nothing):
    found = fingerprints.fingerprints(awkward).toPandas()
    assert len(found) == awkward.count()
    assert found[found.doc_id == 12].fingerprint.nunique() == 1
    alone = found[found.doc_id.isna()].iloc[0]
    assert alone.near_next == 0 and 0 < alone.near_edited <= 1
    assert fingerprints.fingerprints(nothing).count() == 0


def test_containment_of_short_passages(spark):
    """Passages wholly inside a long text: null where no hash is below the threshold, else 1."""
    long = [f"w{i}" for i in range(300)]
    rows = [(" ".join(long[i : i + n]), " ".join(long)) for n in (5, 6, 8, 10) for i in range(0, 280, 7)] + [("w1 w2", "w1 w2")]
    frame = spark.createDataFrame(rows, "short string, long string")
    for c in ("short", "long"):
        frame = fingerprints.with_sketch(frame, c, f"s_{c}")
    found = [r[0] for r in frame.select(fingerprints.containment(F.col("s_short"), F.col("s_long"))).collect()]
    assert set(found[:-1]) == {None, 1.0} and found[-1] == 1.0


def test_sketches_merge_and_estimate_containment(spark):
    words = [f"w{i}" for i in range(3000)]
    frame = spark.createDataFrame([(" ".join(words), " ".join(words[:600]), "a b")], "long string, short string, tiny string")
    for c in ("long", "short", "tiny"):
        frame = fingerprints.with_sketch(frame, c, f"s_{c}")
    inside, share, merged, small = frame.select(
        fingerprints.containment(F.col("s_short"), F.col("s_long")),
        fingerprints.containment(F.col("s_long"), F.col("s_short")),
        fingerprints.merge(F.col("s_long"), F.col("s_short")) == F.col("s_long"),
        F.size("s_tiny"),
    ).first()
    assert inside == 1 and abs(share - 0.2) < 0.05 and merged and small == 1


def test_quality_of_awkward_texts(awkward, nothing, duck, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (13, 0, 1), (10, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = awkward.where("doc_id is not null")
    con = duck(documents=rows.select("doc_id", "text"), labels=labels)
    assert compare.difference(quality_rules.judge(rows, labels), con, quality_rules.SQL) is None
    found = quality_rules.judge(awkward, labels.limit(0)).toPandas()
    assert len(found) == awkward.count() and found[found.n_words == 0].base_failed.all()
    assert quality_rules.judge(nothing, labels).count() == 0


def test_threshold():
    assert quality_rules.best_threshold([]) == 0
    assert quality_rules.best_threshold([(5, 3, 0)]) == 0
    assert quality_rules.best_threshold([(-9, 0, 4), (2, 5, 0), (7, 1, 0)]) == -3000
    assert quality_rules.best_threshold([(1, 1, 1)]) == 1000


def brute_scores(rows: list[tuple]) -> list[tuple]:
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    singles, pairs = Counter(), Counter()
    for _, w in words:
        singles.update(w)
        pairs.update(zip(w, w[1:]))
    total = sum(singles.values())
    out = []
    for k, w in words:
        own, own_pairs, score, known, unseen = Counter(w), Counter(zip(w, w[1:])), 0.0, 0, 0
        for i, word in enumerate(w):
            count = singles[word] - own[word]
            unseen += count == 0
            step = math.log((count or backoff.ALPHA) / max(total - len(w), 1))
            if i:
                both = (w[i - 1], word)
                if pairs[both] > own_pairs[both]:
                    known += 1
                    step = math.log((pairs[both] - own_pairs[both]) / (singles[w[i - 1]] - own[w[i - 1]]))
                else:
                    step += math.log(backoff.ALPHA)
            score += step
        out.append((k, len(w), round(score, 5), known, unseen))
    return sorted(out, key=str)


def test_backoff_against_brute_force(documents, awkward, nothing, monkeypatch):
    monkeypatch.setattr(backoff, "input_parts", lambda _: 7)
    for table in (documents, awkward):
        found = [(r.doc_id, r.n_words, round(r.log_score, 5), r.n_known_pairs, r.n_unseen_words) for r in backoff.scores(table).collect()]
        want = brute_scores([tuple(r) for r in table.select("doc_id", "text").collect()])
        for got, expected in zip(sorted(found, key=str), want, strict=True):
            assert got[:2] + got[3:] == expected[:2] + expected[3:]
            assert math.isclose(got[2], expected[2], rel_tol=1e-6, abs_tol=1e-4)
    assert backoff.scores(nothing).count() == 0


def brute_orders(rows: list[tuple], order: int) -> list[tuple]:
    """As ``brute_scores``, by the definition for n-grams of up to ``order`` words."""
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    corpus = Counter()
    for _, w in words:
        corpus.update(grams(w))
    total = sum(len(w) for _, w in words)
    out = []
    for k, w in words:
        own, known, score = grams(w), [0] * (order + 1), 0.0
        others = lambda g: corpus[g] - own[g]
        for i in range(len(w)):
            factor, found = 1.0, False
            for n in range(min(order, i + 1), 0, -1):
                count = others(tuple(w[i - n + 1 : i + 1]))
                known[n] += count > 0
                if not found and (count or n == 1):
                    base = others(tuple(w[i - n + 1 : i])) if n > 1 else max(total - len(w), 1)
                    score += math.log(factor * (count or backoff.ALPHA) / base)
                    found = True
                factor *= backoff.ALPHA
        out.append((k, len(w), score, *known[2:], len(w) - known[1]))
    return sorted(out, key=lambda r: (str(r[0]), r[1:]))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_backoff_of_longer_ngrams(documents, awkward, nothing, monkeypatch, order):
    monkeypatch.setattr(backoff, "input_parts", lambda _: 7)
    for table in (documents, awkward):
        found = backoff.scores(table, order=order).drop("mean_log_score").collect()
        want = brute_orders([tuple(r) for r in table.select("doc_id", "text").collect()], order)
        for got, expected in zip(sorted(map(tuple, found), key=lambda r: (str(r[0]), r[1:])), want, strict=True):
            assert got[:2] + got[3:] == expected[:2] + expected[3:]
            assert math.isclose(got[2], expected[2], rel_tol=1e-6, abs_tol=1e-4)
    assert backoff.scores(nothing, order=order).count() == 0


def test_backoff_query_sees_two_words_before(spark):
    assert "n_known_triples" in QUERIES["op6_backoff"](spark, SF_DIR).columns
    rows = [(1, "a b c"), (2, "a b x"), (3, "y b c"), (4, "a b c")]
    found = {r.doc_id: r for r in backoff.scores(spark.createDataFrame(rows, "doc_id long, text string"), order=backoff.ORDER).collect()}
    assert [found[i].n_known_triples for i in (1, 2, 3, 4)] == [1, 0, 0, 1]
    assert math.isclose(found[1].log_score, math.log(2 / 9) + math.log(2 / 2) + math.log(1 / 2))
    assert math.isclose(found[3].log_score, math.log(0.4 / 9) + math.log(0.4 * 3 / 9) + math.log(0.4 * 2 / 3))


def test_word_hashes_of_batches():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["a b", None, "", "b", "b a\tb"])[1:])
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    assert first.tolist() == [0, 0, 0, 1, 4]
    assert hashes[0] == hashes[1] == hashes[3] != hashes[2]
