"""Small tables with every awkward case, and brute-force answers."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns named like columns that operators add or use inside.
CLASHES = "size long, copies long, target double, score double, key long, part int, _id long, _crc long, _row int, n_words long, features int"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES


def prose(seed: int, words: int, vocabulary: int = 300) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, words))


def awkward_texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows."""
    base, passage = prose(1, 120), prose(2, 60)
    changed = base.split()
    changed[60] = "other"
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # exact copy
        (3, " ".join(changed), "en", None),  # near copy
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n ", "de", "b"),
        (7, "one two", "de", None),
        (8, "One  TWO", "de", "c"),
        (9, prose(3, 40) + "\n" + passage, "fr", "c"),
        (10, prose(4, 50) + " " + passage + " " + prose(5, 20), "fr", "c"),
        (11, "12 34 !!", "fr", "c"),
        (12, prose(6, 30_000), "en", "a"),  # very long
        (12, prose(6, 30_000), "en", "a"),  # the same row again
        (13, "ab" * 400, "es", "a"),  # repeats inside
        (14, "é日本𝄞 ñ\x00 " * 30 + "ß", "es", "d"),
        (15, "é日本𝄞 ñ\x00 " * 30 + "ß.", "es", "d"),
        (None, prose(7, 80), "en", "d"),
        (17, "same line\nsame line\n\nother\nsame line", "en", "d"),
    ]


def awkward_documents(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    extra = (7,) * CLASHES.count(",") + (7,)
    data = [(*r, len(r[1] or ""), *[float(x) if i in (2, 3) else x for i, x in enumerate(extra)]) for r in rows]
    return spark.createDataFrame(data, DOCUMENTS).repartition(3)


def shingle_set(text: str | None) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def component_ids(texts: dict[int, str | None]) -> dict[int, int]:
    """Smallest id reachable by links with Jaccard similarity of at least 0.8."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    holders: dict[tuple, list[int]] = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    return {k: find(k) for k in sets}


def cut_repeats(rows: list[tuple], length: int = 100) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept) of texts given in order of their ids."""
    seen: set[bytes] = set()
    out = []
    for text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = hashlib.md5(data[i : i + length]).digest()
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out
