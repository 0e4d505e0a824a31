"""Vectorised word and shingle hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from learnloom.llm.common import mix64

WORDS = 5  # words of a shingle
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ORDER = np.uint64(0xD6E8FEB86659FD93)

_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words before each text (n+1 values)."""
    solid = ~_white[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False  # a text border ends a word
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    cut = inner[inner > 0] - 1
    after[cut] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a difference of prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = _powers(BASE, len(data))
    terms *= data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    inverse = _powers(INVERSE, len(data))
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the words before each text."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a text, and how many each text has."""
    counts = np.diff(first)
    per_text = np.maximum(counts - n + 1, 0)
    if len(words) < n:
        return np.zeros(0, np.uint64), per_text
    rolled = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        rolled *= ORDER
        rolled += words[j : len(words) - n + 1 + j]
    keep = np.ones(len(words), bool)
    for j in range(1, n):  # runs that would cross the end of a text
        ends = first[1:] - j
        keep[ends[ends >= 0]] = False
    return mix64(rolled[keep[: len(rolled)]] + np.uint64(n)), per_text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, A-Z in lower case.

    A text of fewer words is one shingle, one without words none.
    """
    words, first = word_hashes(lower_ascii(data), offsets)
    hashes, per_text = ngrams(words, first, n)
    stops = np.cumsum(per_text)
    out = []
    for i, (stop, size) in enumerate(zip(stops.tolist(), per_text.tolist())):
        if size:
            out.append(np.unique(hashes[stop - size : stop]))
        elif first[i + 1] > first[i]:
            few = int(first[i + 1] - first[i])
            out.append(ngrams(words[first[i] : first[i + 1]], np.array([0, few]), few)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
