"""Stupid-backoff language model scores with the corpus itself as model.

A word's score given the words before is the relative frequency, in all *other* documents, of
the n-gram of ``order`` words that it ends among those that share its first words. Where that
n-gram occurs nowhere else, it is ``ALPHA`` times the score given one word less, and so on down
to the word's own relative frequency; a word that no other document has counts as one occurrence,
backed off again. A word with fewer words before it starts at the longest n-gram there is. A
document's score is the sum of the logarithms.

The counting is relational, in compact form: documents are dealt into parts, each part counts
its distinct n-grams (of 1 to ``order`` words) and sends them, by hash, to the bucket that holds
this slice of the n-gram count table. The bucket adds the counts of all parts and answers each
part with what the other parts have of the n-grams it asked for, in the same order; the part
joins them with the n-grams of its documents and sums up. An n-gram that a third of all documents
contain thus costs one entry per part. Hashes have 48 bits inside a bucket. Nothing is sampled or
pruned. What moves is packed with zstd: texts that go to one part together, hashes as differences in
their order, answers as they are (most are 0, since most long n-grams are in one part only).

Edge cases: null and blank texts have no words, score 0 and no mean. Identical rows are separate
documents, so each finds its n-grams in the other. With a single document every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnloom.llm.common import input_parts, release, small_batches
from learnloom.llm.shingles import ngrams, word_hashes
from learnloom.session import Scratch

ALPHA = 0.4
ORDER = 3  # words of the longest n-grams of the query
HASH_BYTES = 6
NAMES = {2: "n_known_pairs", 3: "n_known_triples"}


def known_columns(order: int) -> list[str]:
    return [NAMES.get(n, f"n_known_{n}_grams") for n in range(2, order + 1)]


def dealt(documents: DataFrame, parts: int) -> DataFrame:
    part = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(parts)).cast("int")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part.alias("part"))


def part_ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a part: words before each text, n-gram of each word, pair, ... (as an index
    into the distinct ones), the distinct n-grams' hashes, and how often each occurs."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    words, first = word_hashes(data, offsets)
    hashes = np.concatenate([ngrams(words, first, n)[0] for n in range(1, order + 1)])
    distinct, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return first, inverse, distinct, count


def buckets_of(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the distinct hashes by bucket and hash in it, and (bucket, from, to) in that order."""
    top = distinct >> np.uint64(8 * HASH_BYTES)
    bucket = top * np.uint64(buckets) >> np.uint64(64 - 8 * HASH_BYTES)
    group = np.minimum(bucket, top)  # as many and in the same order, but 16 bits also with more buckets
    order = np.argsort((group << np.uint64(8 * HASH_BYTES)) | short_hashes(distinct), kind="stable")
    used, starts = np.unique(bucket[order].astype(np.int64), return_index=True)
    return order, list(zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)]))


def short_hashes(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * HASH_BYTES) - 1)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of sorted batches gathered by ``key``."""
    current, held = None, []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop == start:
                continue
            if values[start] != current and held:
                yield current, held
                held = []
            current = int(values[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield current, held


def column(batches: list[pa.RecordBatch], name: str) -> list:
    return [v for b in batches for v in b.column(name).to_pylist()]


def packed(values: np.ndarray) -> bytes:
    """Compressed 64-bit values, equal bytes of their places side by side."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def packed_texts(documents: DataFrame) -> DataFrame:
    """(part, sizes, texts): the texts of a batch that go to one part, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            order = np.argsort(part, kind="stable")
            used, starts = np.unique(part[order], return_index=True)
            texts = [(t or "").encode() for t in batch.column("text").take(pa.array(order)).to_pylist()]
            groups = [texts[s:e] for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)])]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(used, pa.int32()), "sizes": pa.array([[len(t) for t in g] for g in groups], pa.list_(pa.int32())),
                    "texts": pa.array([pa.compress(b"".join(g), codec="zstd", asbytes=True) for g in groups], pa.binary()),
                }
            )

    return documents.select("part", "text").mapInArrow(run, "part int, sizes array<int>, texts binary")


def texts_of(sizes: list[int], packed_text: bytes) -> list[bytes]:
    whole, ends = pa.decompress(packed_text, sum(sizes), codec="zstd", asbytes=True), np.cumsum(sizes).tolist()
    return [whole[e - s : e] for s, e in zip(sizes, ends)]


def asked_ngrams(documents: DataFrame, buckets: int, order: int) -> DataFrame:
    """(bucket, part, n_words, hashes, counts): what each part asks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches, "part"):
            groups = zip(column(rows, "sizes"), column(rows, "texts"))
            first, _, distinct, count = part_ngrams([t for g in groups for t in texts_of(*g)], order)
            by_bucket, slices = buckets_of(distinct, buckets)
            short, count = short_hashes(distinct[by_bucket]), count[by_bucket]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([b for b, _, _ in slices], pa.int32()), "part": pa.array([part] * len(slices), pa.int32()),
                    "n_words": pa.array([int(first[-1]) if i == 0 else 0 for i in range(len(slices))], pa.int64()),
                    "hashes": pa.array([packed(np.diff(short[s:e], prepend=np.uint64(0))) for _, s, e in slices], pa.binary()),
                    "counts": pa.array([packed(count[s:e] - 1) for _, s, e in slices], pa.binary()),
                }
            )

    rows = packed_texts(documents).repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "bucket int, part int, n_words long, hashes binary, counts binary")


def answered_ngrams(asked: DataFrame) -> DataFrame:
    """(part, bucket, n_words, elsewhere): counts in other parts of what each part asked, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches, "bucket"):
            counts = [unpacked(c) + 1 for c in column(rows, "counts")]
            _, inverse = np.unique(np.concatenate([np.cumsum(unpacked(h)) for h in column(rows, "hashes")]), return_inverse=True)
            mine = np.concatenate(counts)
            other = np.bincount(inverse, weights=mine)[inverse].astype(np.int64) - mine
            ends = np.cumsum([len(c) for c in counts])
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(column(rows, "part"), pa.int32()), "bucket": pa.array([bucket] * len(ends), pa.int32()),
                    "n_words": pa.array(column(rows, "n_words"), pa.int64()),
                    "elsewhere": pa.array([packed(t) for t in np.split(other, ends[:-1])], pa.binary()),
                }
            )

    rows = asked.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "part int, bucket int, n_words long, elsewhere binary")


def score_part(texts: list[bytes], elsewhere: np.ndarray, buckets: int, corpus_words: int, order: int) -> dict[str, np.ndarray]:
    """Scores of the texts of one part. ``elsewhere``: counts in other parts in the order asked."""
    first, ngram, distinct, count = part_ngrams(texts, order)
    by_bucket, _ = buckets_of(distinct, buckets)
    total = count.astype(np.int64)
    total[by_bucket] += elsewhere
    n = np.diff(first)
    owners = [np.repeat(np.arange(len(n)), np.maximum(n - k, 0)) for k in range(order)]
    owner = np.concatenate(owners)
    _, inverse, own = np.unique(owner * max(len(distinct), 1) + ngram, return_inverse=True, return_counts=True)
    others = np.split(total[ngram] - own[inverse], np.cumsum([len(o) for o in owners])[:-1])  # occurrences in other documents
    word, of_word = others[0], owners[0]
    seen = word > 0
    score = np.log(np.where(seen, word, ALPHA) / np.maximum(corpus_words - n, 1)[of_word])
    after = first[1:][of_word]  # end of each word's text
    context, known_of = word, []  # counts of the n-grams one word shorter, by first word
    for k in range(1, order):
        start = np.flatnonzero(np.arange(len(word)) + k < after)
        known = others[k] > 0
        score[start + k] += np.log(ALPHA)
        hit = start[known]
        score[hit + k] = np.log(others[k][known] / context[hit])
        known_of.append(np.bincount(owners[k][known], minlength=len(n)).astype(np.int64))
        context = np.zeros(len(word), np.int64)
        context[start] = others[k]
    return {
        "n_words": n.astype(np.int64),
        "log_score": np.bincount(of_word, weights=score, minlength=len(n)),
        **dict(zip(known_columns(order), known_of)),
        "n_unseen_words": np.bincount(of_word[~seen], minlength=len(n)).astype(np.int64),
    }


def scores(documents: DataFrame, scratch: Scratch | None = None, order: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_known_pairs, ..., n_unseen_words) per document,
    with one ``n_known_`` column for each length of n-gram from 2 to ``order``."""
    spark = documents.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark)
    parts = input_parts(documents)
    rows = dealt(documents, parts)
    answers = scratch.save(answered_ngrams(asked_ngrams(rows, parts, order)))
    corpus_words = answers.agg(F.sum("n_words")).first()[0] or 0
    release(spark)
    none = F.lit(None)
    both = answers.select("part", "bucket", "elsewhere", none.cast("long").alias("doc_id"), none.cast("string").alias("text")).unionByName(
        rows.select("part", none.cast("int").alias("bucket"), none.cast("binary").alias("elsewhere"), "doc_id", "text")
    )
    both = both.repartition("part").sortWithinPartitions("part", F.asc_nulls_last("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, "part"):
            bucket, answer = column(held, "bucket"), column(held, "elsewhere")
            doc, text = column(held, "doc_id"), column(held, "text")
            is_doc = [b is None for b in bucket]
            counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(a) for a, d in zip(answer, is_doc) if not d)])
            texts = [(t or "").encode() for t, d in zip(text, is_doc) if d]
            ids = pa.array([i for i, d in zip(doc, is_doc) if d], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": ids} | score_part(texts, counts, parts, corpus_words, order))

    known = known_columns(order)
    schema = ", ".join(["doc_id long, n_words long, log_score double", *(f"{c} long" for c in known), "n_unseen_words long"])
    scored = both.mapInArrow(run, schema)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.greatest("n_words", F.lit(1)))
    return scored.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"), *known, "n_unseen_words")
