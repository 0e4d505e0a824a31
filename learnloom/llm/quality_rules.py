"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words fall into ``BUCKETS`` hash buckets. Two multinomials over
the buckets are counted over all documents: the trusted target (labelled good and not toxic)
and the raw corpus. A document's score is the mean log ratio of its n-grams. The threshold is
the one with the best balanced accuracy on the labelled documents: all their scores are counted
in bins of a fixed width, and it lies half way between the best bin and the one below. Every
document gets the same verdict in every run: log ratios are whole micro-units and sums are
exact. A document is kept when it passes the base rules and reaches the threshold.

Counting is one pass (each task adds up its buckets, one row per bucket and task is shuffled);
scoring is a second one with the bucket table, whose size is fixed, sent to every task.

Edge cases: null and blank texts have no words and fail the base rules. Repeated rows are
counted and scored each; repeated labels count as their largest value. Without labels of both
kinds the threshold is 0. Rows without a doc_id have no label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnloom.llm.common import chunks, mix64, small_batches, text_bytes
from learnloom.llm.shingles import ngrams, span_hashes, word_spans
from learnloom.session import Scratch

BUCKETS = 10_000
MICRO = 1_000_000
BIN = 1_000  # micro-units; log ratios are bounded, so there are few bins
LEAST_WORDS = 50  # base rules
MOST_REPEATED = 50  # percent of words in repeated 3-word windows
SYMBOLS = b"#*$%&|<>"

_cache: dict[int, int] = {}


def word_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Bucket of each word: first 8 hexadecimal digits of its MD5 modulo BUCKETS. Each distinct
    word of the batch is hashed once."""
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if len(_cache) > 200_000:
        _cache.clear()
    raw = data.tobytes()
    out = np.empty(len(distinct), np.int64)
    for i, (h, f) in enumerate(zip(distinct.tolist(), first.tolist())):
        bucket = _cache.get(h)
        if bucket is None:
            digest = hashlib.md5(raw[starts[f] : ends[f]]).digest()
            bucket = _cache[h] = int.from_bytes(digest[:4]) % BUCKETS
        out[i] = bucket
    return out[inverse]


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Buckets of all words and word pairs, the text each is from, and the words themselves."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    single = word_buckets(data, starts, ends, hashes)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    paired = of[:-1] == of[1:]
    pair = ((single[:-1] * 31 + single[1:]) % BUCKETS)[paired]
    return np.concatenate([single, pair]), np.concatenate([of, of[:-1][paired]]), (data, offsets, starts, ends, first, hashes)


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches):
            bucket, of, _ = features(batch)
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[trusted[of]], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})

    counted = labelled.select("text", "trusted").mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Smoothed log ratio of each bucket in micro-units (BUCKETS numbers)."""
    table = counts.toPandas().set_index("bucket").reindex(range(BUCKETS), fill_value=0)
    raw, target = table["raw"].to_numpy(np.float64), table["target"].to_numpy(np.float64)
    ratio = np.log(((target + 1) / (target.sum() + BUCKETS)) / ((raw + 1) / (raw.sum() + BUCKETS)))
    return np.rint(ratio * MICRO).astype(np.int64)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(data, offsets, starts, ends, first, hashes) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    n_words = np.diff(first)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters before each byte
    chars = np.append(0, np.cumsum(lead[ends] - lead[starts]))
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbols = np.append(0, np.cumsum(table[data]))
    line_cut = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], line_cut + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((line_end > 0) & (data[np.maximum(line_end, 1) - 1] == 10) & (line_end > line_start))
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_of = np.searchsorted(offsets, line_start, side="right") - 1
    line_key = mix64(span_hashes(data, line_start, line_end) + mix64(line_of.astype(np.uint64)))
    _, earliest = np.unique(line_key, return_index=True)
    again = np.ones(len(line_key), bool)
    again[earliest] = False
    windows, per_text = ngrams(hashes, first, 3)
    window_of = np.repeat(np.arange(texts), per_text)
    number = np.arange(len(windows)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    _, inverse, count = np.unique(mix64(windows + mix64(window_of.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    at = first[window_of[twice]] + number[twice]
    covered = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        covered[at + j] = True
    repeated = np.append(0, np.cumsum(covered[: len(hashes)]))
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": (chars[first[1:]] - chars[first[:-1]]).astype(np.int64),
        "n_symbols": (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64),
        "n_dup_lines": np.bincount(line_of[again], minlength=texts).astype(np.int64),
        "n_repeat_words": (repeated[first[1:]] - repeated[first[:-1]]).astype(np.int64),
    }


def scored(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, base counts, n_features, score_micro): mean log ratio, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bucket, of, texts = features(batch)
            n = batch.num_rows
            total = np.zeros(n, np.int64)
            np.add.at(total, of, ratios[bucket])
            count = np.bincount(of, minlength=n).astype(np.int64)
            score = np.floor(total / np.maximum(count, 1)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")} | base_counts(*texts) | {"n_features": count, "score_micro": score}
            )

    fields = ", ".join(f"{c} long" for c in ["doc_id", *BASE, "n_features", "score_micro"])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def label_table(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def best_threshold(bins: list[tuple[int, int, int]]) -> float:
    """Score with the best balanced accuracy, from (bin, good, bad); the lowest of equal ones."""
    bins = sorted(bins)
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return 0.0
    best, threshold, above, below, previous = -1, 0.0, good, 0, None
    for bin_, g, b in bins:
        if above * bad + below * good > best:
            best = above * bad + below * good
            threshold = ((bin_ if previous is None else previous + 1) + bin_) * BIN / 2
        above, below, previous = above - g, below + b, bin_
    return threshold


def judge(documents: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Base counts, base_failed, score_micro and kept of every document."""
    small_batches(documents.sparkSession)
    scratch = scratch or Scratch(documents.sparkSession)
    known = label_table(labels)
    trusted = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    # Labels grow with the documents: always a merge join, which shuffles the texts once.
    labelled = documents.select("doc_id", "text").join(known.hint("merge"), "doc_id", "left").select("text", trusted.alias("trusted"))
    table = scratch.save(scored(documents, log_ratios(bucket_counts(labelled))))
    bins = (
        table.where("n_features > 0").join(known, "doc_id").where("quality in (0, 1)")
        .groupBy(F.floor(F.col("score_micro") / BIN).alias("bin"))
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    )
    threshold = best_threshold([tuple(r) for r in bins.collect()])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (F.col("score_micro") >= F.lit(float(threshold)))
    return table.select("doc_id", *BASE, failed.alias("base_failed"), kept.alias("kept"), "score_micro")


SQL = rf"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
b AS (SELECT r, doc_id, w, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {BUCKETS}) AS b FROM w),
f AS (SELECT r, doc_id, unnest(list_concat(b, list_transform(range(1, len(b)), lambda i: (b[i] * 31 + b[i + 1]) % {BUCKETS}))) AS f FROM b),
g AS (SELECT f.*, coalesce(l.quality = 1 AND coalesce(l.toxic, 0) = 0, false) AS good FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT f, count(*) AS raw, count(*) FILTER (good) AS target FROM g GROUP BY f),
n AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM c),
p AS (SELECT f, round(ln(((target + 1) / (targets + {BUCKETS})) / ((raw + 1) / (raws + {BUCKETS}))) * {MICRO})::BIGINT AS micro FROM c, n),
s AS (SELECT r, floor(sum(micro)::DOUBLE / count(*))::BIGINT AS score_micro FROM f JOIN p USING (f) GROUP BY r),
k AS (SELECT floor(score_micro::DOUBLE / {BIN}) AS bin, sum(quality)::BIGINT AS good, sum(1 - quality)::BIGINT AS bad
  FROM s JOIN t USING (r) JOIN l USING (doc_id) WHERE quality IN (0, 1) GROUP BY bin),
m AS (SELECT bin, sum(good) OVER () AS g, sum(bad) OVER () AS b, sum(good) OVER (ORDER BY bin DESC) AS above,
    sum(bad) OVER (ORDER BY bin) - bad AS below, lag(bin) OVER (ORDER BY bin) AS previous FROM k),
best AS (SELECT (coalesce(previous + 1, bin) + bin) * {BIN} / 2 AS threshold FROM m WHERE g > 0 AND b > 0
  ORDER BY above * b + below * g DESC, bin LIMIT 1),
h AS (SELECT coalesce((SELECT threshold FROM best), 0) AS threshold),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM t),
dup AS (SELECT r, sum(k - 1)::BIGINT AS n_dup_lines FROM (SELECT r, line, count(*) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT win.r, unnest([i, i + 1, i + 2]) AS j FROM win JOIN twice USING (r, g)) GROUP BY r),
base AS (SELECT w.r, w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score_micro, 0) AS score_micro
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN s USING (r)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND score_micro >= threshold AS kept, score_micro FROM v, h"""
