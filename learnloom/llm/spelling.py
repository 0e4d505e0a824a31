"""Spelling variants: words that one inserted, deleted or replaced letter tells apart.

1. Tasks count the words of whole texts and hand on one row per distinct word now and then; Spark
   adds the rows up, so a word that is everywhere costs a few rows per task.
2. Letter counts of two such words differ by one at one letter (lengths differ by one) or by one
   at two letters (equal lengths): a squared distance of 1 or 2. Products of blocks of count
   vectors (Gram matrices) give the distances of all pairs of a block of one length with itself
   and with the block of the next length; pairs at most 2 apart are verified letter by letter.
3. So that blocks do not have to meet all blocks of a length, letters are dealt into three parts.
   At most two letters differ, so in one part at least the counts are equal: words are blocked
   three times, by length and a hash of their counts in each part. A pair is reported in the
   first part with equal counts only. The number of blocks follows the vocabulary, and a block of
   more than ``TILE`` words is split into tiles that meet pairwise, each pair in a row of its own.
4. A word's form is its commonest near word if that is at least twice as common; roots follow
   forms by doubling pointers. Counts at least double on each step, so six rounds always do.

Edge cases: null and empty texts have no words. Repeated rows count as often as they occur. Ties
between forms go to the smaller word in code-point order. Words of any length are compared. Empty
tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from learnloom.llm.common import small_batches
from learnloom.session import Scratch

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT = 5, 3
DAMAGE = 97  # one run in so many loses a letter in ``count_words(damage=...)``
TASK_WORDS = 200_000  # distinct words a task counts before it hands them on
PARTS = 3  # letters are dealt by code point
BLOCK_WORDS = 4000  # words of a block, on average over its lengths
TILE = 2048  # words of a tile
FEWER = 2  # a form is at least so many times as common

_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))
_PART = np.array(_LETTERS) % PARTS


def count_words(documents: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, n) of the words of at least MIN_CHARS letters that occur MIN_COUNT times or more.

    ``damage``: a run whose hash (CRC-32 of doc_id, colon and run) it divides loses the letter at
    that hash modulo the run's length.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": list(totals), "n": np.fromiter(totals.values(), np.int64, len(totals))})
            totals.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{doc}:".encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    if damage:
                        mark = zlib.crc32(word.encode(), prefix)
                        if mark % damage == 0:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= MIN_CHARS:
                        totals[word] += n
                if len(totals) >= TASK_WORDS:
                    yield flush()
        if totals:
            yield flush()

    texts = documents.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _blocked(words: DataFrame, blocks: int) -> DataFrame:
    """Each word once per part: (part, block, len, word, n)."""

    def letters(part: int) -> Column:
        of_part = F.filter(F.split("word", ""), lambda c: (c != "") & (F.ascii(c) % PARTS == part))
        return F.struct(F.lit(part).alias("part"), F.pmod(F.xxhash64(F.array_join(F.array_sort(of_part), "")), F.lit(blocks)).alias("block"))

    each = F.inline(F.array(*[letters(p) for p in range(PARTS)]))
    return words.select(F.length("word").alias("len"), "word", "n", each)


def _matrix(words: pa.Array, length: int) -> np.ndarray:
    """Words of one length as rows of single-byte letters."""
    data = "".join(words.to_pylist()).encode("latin-1")
    return np.frombuffer(data, np.uint8).reshape(-1, length)


def _counts(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(_LETTERS)), np.float32)
    rows = np.arange(len(codes))
    for column in _COLUMN[codes].T:
        out[rows, column] += 1
    return out


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ by exactly one edit; ``b`` may be one letter longer."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_pairs(a: np.ndarray, b: np.ndarray, part: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words of two tiles whose first part with equal counts is ``part``;
    ``same``: a tile with itself, each pair once."""
    x, y = _counts(a), _counts(b)
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    close = squares <= 2
    i, j = np.nonzero(np.triu(close, 1) if same else close)
    ok = _one_edit(a[i], b[j])
    i, j = i[ok], j[ok]
    for p in range(part + 1):
        equal = (x[i][:, _PART == p] == y[j][:, _PART == p]).all(axis=1)
        ok = equal if p == part else ~equal
        i, j = i[ok], j[ok]
    return i, j


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) in both directions from rows of two tiles."""
    for batch in batches:
        columns = [batch.column(c) for c in ("part", "len", "len_b", "same", "a", "a_n", "b", "b_n")]
        for k in range(batch.num_rows):
            part, length, length_b, same = (c[k].as_py() for c in columns[:4])
            a, a_n, b, b_n = (c[k].values for c in columns[4:])
            i, j = near_pairs(_matrix(a, length), _matrix(b, length_b), part, same)
            if len(i):
                i, j = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([a.take(i), b.take(j), b_n.take(j)], ["word", "near", "near_n"])
                yield pa.RecordBatch.from_arrays([b.take(j), a.take(i), a_n.take(i)], ["word", "near", "near_n"])


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words, once."""
    small_batches(words.sparkSession)
    blocks = max(1, words.count() // BLOCK_WORDS)
    blocked = scratch.save(_blocked(words, blocks))
    by = ["part", "block", "len"]
    tiles = scratch.save(blocked.groupBy(*by).agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    cells = scratch.save(
        blocked.join(tiles, by)
        .groupBy(*by, F.pmod(F.xxhash64("word", F.lit(1)), "tiles").alias("tile"))
        .agg(F.collect_list(F.struct("word", "n")).alias("w"))
        .select(*by, "tile", F.col("w.word").alias("a"), F.col("w.n").alias("a_n"))
    )
    scratch.drop(blocked)
    # A cell meets the cells of its own length from its own tile on, and all of the next length.
    further = F.explode(F.array(F.col("len"), F.col("len") + 1)).alias("len_b")
    others = tiles.select("part", "block", F.col("len").alias("len_b"), F.col("tiles").alias("tiles_b"))
    first = F.when(F.col("len") == F.col("len_b"), F.col("tile")).otherwise(0)
    met = cells.select("*", further).join(others, ["part", "block", "len_b"])
    met = met.select("*", F.explode(F.sequence(first, F.col("tiles_b") - 1)).alias("tile_b")).drop("tiles_b")
    right = cells.select("part", "block", F.col("len").alias("len_b"), F.col("tile").alias("tile_b"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    same = (F.col("len") == F.col("len_b")) & (F.col("tile") == F.col("tile_b"))
    pairs = met.join(right, ["part", "block", "len_b", "tile_b"])
    pairs = pairs.select("part", "len", "len_b", same.alias("same"), "a", "a_n", "b", "b_n")
    return pairs.mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): the last form reached. Pointers double in every round; words
    that have arrived take no part in the next."""
    moving = scratch.save(forms.select("word", F.col("form").alias("root")))
    arrived = moving.limit(0)
    while not moving.isEmpty():
        here = moving.unionByName(arrived)
        ahead = here.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.save(moving.join(ahead, "root", "left").select("word", "root", "further"))
        arrived = arrived.unionByName(step.where("further IS NULL").select("word", "root"))
        moving = step.where("further IS NOT NULL").select("word", F.col("further").alias("root"))
    return arrived


def variants(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts (word, n), which
    are written in a-z and U+00C0 to U+00FF."""
    scratch = scratch or Scratch(words.sparkSession)
    words = scratch.save(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near_words(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best.minus") >= FEWER * F.col("n")
    found = scratch.save(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.minus")).alias("form_n"),
        )
    )
    ends = roots(found.where("form IS NOT NULL"), scratch)
    joined = found.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
