"""Packing by concatenate and cut.

All documents are tokenised, an end id closes each, and the ids are laid end to end; the line
is cut into fixed windows. Two passes: the first writes the ids once, each document with its
offset inside its task and each task's total; a running sum over the totals (one row per task,
so the size is bounded by the number of tasks) gives every task its global offset. The second
pass then knows the global offset of each document and cuts it where a window ends: a document
that crosses a border gives one piece per window. Nothing but the totals is shuffled, and only
the very last window is not full.

Edge cases: a null or empty text is its end id alone. Repeated rows are packed as often as they
occur. No rows give no pieces. Very long texts give many pieces. A null doc_id stays null.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from learnloom.llm.common import chunks, small_batches
from learnloom.session import Scratch

WINDOW = 2048
END_ID = 1
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Characters whose classes are alike in all Unicode versions: such texts may be split here.
PLAIN = re.compile(r"[\x20-\x7E\n\r\t¡-¬®-ɏ‐-‧€]*")
# The vocabulary's own pre-tokenisation (fixed value), with its letters and digits spelt out for
# the characters of PLAIN; possessive where giving back could not change a match.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PIECES = rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]++| ?[{DIGITS}]++| ?[^\s{LETTERS}{DIGITS}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be
    printed, else the next free letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


BYTE_OF = byte_letters()


class Encoder:
    """Texts -> ids, as the tokenizer gives them without its surrounding special tokens.

    Texts of plain characters are split and merged by tiktoken, which is given the tokenizer's
    own vocabulary and is quicker: an id is the rank of its merge in this kind of vocabulary.
    Texts with other characters, or with the string of an added token, go to the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        tokens = self.tokenizer.get_vocab()
        ranks = {bytes(map(BYTE_OF.__getitem__, token)): i for token, i in tokens.items() if i not in added}
        self.merges = tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit values."""
        if not text:
            return b""
        if PLAIN.fullmatch(text) and not self.added.search(text):
            return self.merges.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenised(documents: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, n, task, before): ids with the end id, and the ids before them in the task."""
    small_batches(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            encode = encoder(tokenizer).encode
            ids = [encode(x) + end for x in batch.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n": n,
                 "task": np.full(len(n), task, np.int32), "before": starts}
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids binary, n long, task int, before long")


def pack(
    documents: DataFrame,
    scratch: Scratch | None = None,
    window: int = WINDOW,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit values.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    stored = scratch.save(tokenised(documents, tokenizer, end_id))
    totals = stored.groupBy("task").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = totals.select("task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(offsets), "task").select(
        "doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("at")
    )
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ids"):
            n, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
            first = at // window
            count = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(sequence * window, at[row])
            stop = np.minimum((sequence + 1) * window, (at + n)[row])
            start = begin - at[row]
            ids = batch.column("ids")
            views = [memoryview(ids[i].as_buffer()) for i in range(len(ids))]
            pieces = [views[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), (stop - begin).tolist())]
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "length": stop - begin,
                "ids_crc32": np.array([zlib.crc32(p) for p in pieces], np.int64), "doc_tokens": n[row],
                "sequence_id": sequence, "offset": begin - sequence * window,
            }
            if with_ids:
                out["ids"] = pa.array([bytes(p) for p in pieces], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return placed.mapInArrow(cut, fields + (", ids binary" if with_ids else ""))
