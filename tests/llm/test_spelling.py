"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from fixtures import SF_DIR

from learnloom.llm import spelling as S
from learnloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, form string, len int, part int"


def words_of(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def neighbours(word, words):
    """Words one edit away, by making all edits over the letters in use."""
    letters = sorted(set("".join(words)))
    made = {word[:i] + word[i + 1 :] for i in range(len(word))}
    made |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    made |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return [w for w in made - {word} if w in words]


def expected(words):
    near = {w: neighbours(w, words) for w in words}
    best = {w: min(found, key=lambda v: (-words[v], v)) for w, found in near.items() if found}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "f", 2, 3) for r in rows], SCHEMA).repartition(3)


def crowd(seed=1, size=400):
    """Many words of few letters, with chains of counts."""
    rng = random.Random(seed)
    return {"".join(rng.choice("abéz") for _ in range(rng.randint(5, 7))): 3 << rng.randint(0, 9) for _ in range(size)}


def test_variants_of_a_crowd(spark, monkeypatch):
    words = crowd()
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(S.variants(frame)) == expected(words)
    monkeypatch.setattr(S, "TILE", 7)  # tiles that meet pairwise
    monkeypatch.setattr(S, "BLOCK_WORDS", 20)
    assert found(S.variants(frame)) == expected(words)


def test_long_chain_of_forms(spark):
    words = {"a" * (5 + i): 3 << i for i in range(40)}
    got = found(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == expected(words) and {r[2] for r in got} == {"a" * 44}


def test_near_pairs_are_exact():
    words = sorted(crowd(2, 200))
    total = 0
    for n in (5, 6, 7):
        for m in (n, n + 1):
            a, b = [w for w in words if len(w) == n], [w for w in words if len(w) == m]
            if not b:
                continue
            code = lambda ws, k: np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(-1, k)
            found = [(a[i], b[j]) for p in range(S.PARTS) for i, j in zip(*S.near_pairs(code(a, n), code(b, m), p, n == m))]
            want = {tuple(sorted((x, y), key=lambda w: (len(w), w))) for x in a for y in b if y in neighbours(x, set(words))}
            assert len(found) == len(set(found)) and {tuple(sorted(f, key=lambda w: (len(w), w))) for f in found} == want
            total += len(found)
    assert total > 50


def test_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_WORDS", 3)
    base = "Straße straße STRASSE élève élèves eleve ÉLÈVE naïve×naïve÷ hello hellos helo HELLO hallo"
    rows = [(i, base) for i in range(120)] + [(None, base)] * 4 + [(500, None), (501, ""), (502, "12 .. 日本"), (503, "hello " * 20_000)]
    rows += [(504, "a" * 300 + " " + "a" * 299 + "b")] * 9
    assert found(S.variants(S.count_words(table(spark, rows), S.DAMAGE))) == expected(words_of(rows))


def test_no_words(spark):
    assert S.variants(S.count_words(table(spark, []))).count() == 0
    assert S.variants(S.count_words(table(spark, [(1, "few words here")]))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = found(QUERIES["op13_spelling_variants"](spark, SF_DIR))
    assert got == expected(words_of(rows)) and sum(r[1] is not None for r in got) > 10
