"""Removal of byte strings that occur earlier, by a collection Burrows-Wheeler transform.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller doc_id, or the
same document and an earlier start) is removed; all strings are judged on the input.

1. *Pieces.* The hash-smallest ``KGRAM``-byte string inside a window of LENGTH bytes is its
   anchor. Runs of windows with the same anchor form a piece; equal windows have equal
   anchors, so they meet in one part when pieces are dealt by anchor. Only compact records
   (hashes and places) move. Equal pieces collapse to the earliest; the rest is repeated text.
2. *Collections.* Different pieces with the same anchor may still share windows. Their bytes are
   fetched and dealt by anchor into small collections. Of an anchor with very many different
   pieces (a passage that a large share of documents contain, in different surroundings) single
   windows are compared by a 128-bit hash of their bytes: an aggregate, salted because a window
   may have any number of copies, finds the earliest place, and all others are repeated.
3. *Column-wise construction.* A collection's transform grows from the right ends of its pieces:
   each round inserts one symbol per piece into the transform and its array of common prefixes.
   Windows whose common prefix reaches LENGTH are equal, and all but the earliest are repeated.

The arrays of a round are read and written in order; since a collection is bounded
(``COLLECTION`` pieces on average) they stay in memory rather than in files, because a task has
no shared folder for scratch files. All tables between the steps are written tables.

Edge cases: null and empty texts have no bytes, texts shorter than LENGTH keep all. Identical
rows (same doc_id and text) are one document. Different texts with one doc_id stand at the same
place: neither is earlier than the other at the same start. A null doc_id comes last. Extra
columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnloom.llm.common import boxed, chunks, give_back_memory, input_parts, mix64, release, small_batches, text_bytes, unboxed
from learnloom.llm.shingles import BASE, INVERSE, _powers
from learnloom.session import Scratch

LENGTH = 100
KGRAM = 32
SPAN = LENGTH - KGRAM + 1  # k-grams of a window
COLLECTION = 2000  # pieces of a collection on average
CROWD = 4096  # different pieces of an anchor from which single windows are dealt
RECORD = np.dtype(
    [("anchor", "u1", (5,)), ("content", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("n", "u1"), ("again", "u1")]
)
LAST = 2**63 - 1


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(text, start, windows, anchor, content hash, again) of all pieces of all texts.

    ``again``: the anchor occurs twice in the piece, so windows inside may be equal. Such runs
    are cut after SPAN windows.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, int(BASE)
    while size < KGRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = size * 2, factor * factor % 2**64
    h = mix64(h)
    least, size = h, 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if SPAN > size:
        least = np.minimum(least[: -(SPAN - size)], least[SPAN - size :])
    n = len(least)  # least[i]: anchor of the window at i
    text = np.searchsorted(offsets, np.arange(n), side="right") - 1
    valid = np.arange(n) + LENGTH <= offsets[text + 1]
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(opens)
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    last = np.flatnonzero(closes)
    near = np.arange(SPAN)
    again = np.zeros(len(first), bool)
    for s in range(0, len(first), 1 << 15):
        f, e = first[s : s + (1 << 15)], last[s : s + (1 << 15)]
        a = least[f][:, None]
        left = f + (h[f[:, None] + near] == a).argmax(axis=1)
        right = e + SPAN - 1 - (h[e[:, None] + near[::-1]] == a).argmax(axis=1)
        again[s : s + (1 << 15)] = left != right
    size = last - first + 1
    cuts = -(-size // SPAN)
    of = np.repeat(np.arange(len(first)), cuts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = first[of] + k * SPAN
    windows = np.minimum(size[of] - k * SPAN, SPAN)
    terms = _powers(BASE, len(data))
    terms *= data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    inverse = _powers(INVERSE, len(data))
    content = mix64((sums[begin + windows + LENGTH - 1] - sums[begin]) * inverse[begin] + windows.astype(np.uint64))
    of_text = text[begin]
    return of_text, begin - offsets[of_text], windows, least[begin], content, again[of] | (cuts[of] > 1)


def keyed(documents: DataFrame) -> DataFrame:
    """Adds the document's identity: _id (doc_id, null last) and _crc of its text."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return documents.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_crc": crc})


def dealt_pieces(documents: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text, start, windows, anchor, content, again = pieces(*text_bytes(batch.column("text")))
            to = ((anchor >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            records = np.empty(len(to), RECORD)
            records["anchor"] = anchor[order].view(np.uint8).reshape(-1, 8)[:, :5]
            records["content"] = content[order]
            records["doc"] = batch.column("_id").to_numpy()[text[order]]
            records["crc"] = batch.column("_crc").to_numpy()[text[order]]
            records["start"] = start[order]
            records["n"] = windows[order]
            records["again"] = again[order]
            used, starts = np.unique(to[order], return_index=True)
            blobs = [r.tobytes() for r in np.split(records, starts[1:])] if len(used) else []
            yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "records": pa.array(blobs, pa.binary())})

    return keyed(documents).select("_id", "_crc", "text").mapInArrow(run, "part int, records binary")


PLACE = "_id long, _crc long, start long, n long"


def compared_pieces(dealt: DataFrame) -> DataFrame:
    """Places of repeated pieces (``crowd`` null) and of the pieces still to be compared
    (``crowd``: different pieces of their anchor)."""

    def compare(blobs: list[bytes], part: int) -> pa.RecordBatch:
        records = np.frombuffer(b"".join(blobs), RECORD)
        anchor = np.zeros((len(records), 8), np.uint8)
        anchor[:, :5] = records["anchor"]
        anchor = anchor.view(np.uint64).ravel()
        order = np.lexsort((records["start"], records["doc"], records["content"], anchor))
        records, anchor = records[order], anchor[order]
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        earliest = new_anchor.copy()
        earliest[1:] |= records["content"][1:] != records["content"][:-1]
        # the same place in another text of the same doc_id, or in an identical row
        twin = np.zeros(len(anchor), bool)
        twin[1:] = ~earliest[1:] & (records["doc"][1:] == records["doc"][:-1]) & (records["start"][1:] == records["start"][:-1])
        for i in np.flatnonzero(twin):  # rare: repeated ids only
            twin[i] = earliest[i - 1] or twin[i - 1]
        starts = np.flatnonzero(new_anchor)
        size = np.diff(np.append(starts, len(anchor)))
        different = np.add.reduceat(earliest.astype(np.int64), starts)
        doubtful = (different > 1) | (np.add.reduceat(records["again"].astype(np.int64), starts) > 0)
        different, doubtful = np.repeat(different, size), np.repeat(doubtful, size)
        repeated = ~earliest & ~twin
        asked = (earliest | twin) & doubtful
        chosen = np.flatnonzero(repeated | asked)
        r = records[chosen]
        return pa.RecordBatch.from_pydict(
            {
                "_id": r["doc"], "_crc": r["crc"].astype(np.int64), "start": r["start"].astype(np.int64), "n": r["n"].astype(np.int64),
                "anchor": (anchor[chosen] | (np.uint64(part) << np.uint64(40))).view(np.int64),
                "crowd": pa.array(different[chosen], mask=repeated[chosen]),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("records").to_pylist()):
                if p != part and blobs:
                    yield compare(blobs, part)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield compare(blobs, part)

    by_part = dealt.repartition("part").sortWithinPartitions("part")
    return by_part.mapInArrow(run, f"{PLACE}, anchor long, crowd long")


def fetch_bytes(documents: DataFrame, asked: DataFrame, collections: int, crowd: int = CROWD) -> DataFrame:
    """(collection, bytes, h0, h1, _id, _crc, start): the strings to compare, dealt by anchor;
    of crowded anchors single windows, with a hash in place of a collection and bytes."""
    wanted = asked.groupBy("_id", "_crc").agg(F.collect_list(F.struct("start", "n", "anchor", "crowd")).alias("asked"))
    rows = keyed(documents).select("_id", "_crc", "text").join(wanted, ["_id", "_crc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("asked")
            items = lists.flatten()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start, n, anchor, many = (items.field(f).to_numpy() for f in ("start", "n", "anchor", "crowd"))
            single = many > crowd
            repeat = np.where(single, n, 1)
            index = np.repeat(np.arange(len(of)), repeat)
            shift = np.arange(len(index)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            size = np.where(single, 1, n)[index] + LENGTH - 1
            begin = start[index] + shift
            place = offsets[of[index]] + begin
            raw, alone = data.tobytes(), single[index]
            h = np.zeros((len(index), 2), np.int64)
            digests = [hashlib.blake2b(raw[p : p + LENGTH], digest_size=16).digest() for p in place[alone].tolist()]
            h[alone] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            texts = [None if w else raw[p : p + s] for p, s, w in zip(place.tolist(), size.tolist(), alone.tolist())]
            row = pa.array(of[index])
            yield pa.RecordBatch.from_pydict(
                {
                    "collection": pa.array((mix64(anchor) % np.uint64(collections)).astype(np.int64)[index], mask=alone),
                    "bytes": pa.array(texts, pa.binary()), "h0": pa.array(h[:, 0], mask=~alone), "h1": pa.array(h[:, 1], mask=~alone),
                    "_id": batch.column("_id").take(row), "_crc": batch.column("_crc").take(row), "start": begin,
                }
            )

    return rows.mapInArrow(run, "collection long, bytes binary, h0 long, h1 long, _id long, _crc long, start long")


def compare_windows(windows: DataFrame, salts: int) -> DataFrame:
    """Places of the windows that also start earlier. Copies of one window are spread over
    ``salts`` groups, each of which gets the earliest place of all."""
    place = F.struct("_id", "start")
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("_id", "start"), F.lit(salts)))
    groups = salted.groupBy("h0", "h1", "salt").agg(F.min(place).alias("least"), F.count("*").alias("copies"))
    first = groups.groupBy("h0", "h1").agg(F.min("least").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    first_of = groups.select("h0", "h1", "salt").join(first.drop("copies"), ["h0", "h1"])
    later = salted.join(first_of, ["h0", "h1", "salt"]).where(place != F.col("first"))
    return later.select("_id", "_crc", "start", F.lit(1).cast("long").alias("n"))


def collection_bwt(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (symbol+1; 0 ends a text) and common-prefix array (at most
    255) of a collection, by inserting one symbol of every text per round.

    Row i of the arrays is the i-th smallest suffix inserted so far. The symbol that precedes
    a suffix stands at its row, so the suffix with that symbol in front belongs to the row that
    a stable count of the symbols gives. Its common prefix with a neighbour is one more than
    the least common prefix between the rows of the two shorter suffixes.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)

    def symbol(text: np.ndarray, taken: int) -> np.ndarray:
        """The symbol before the last ``taken`` ones, 0 at the front of the text."""
        left = sizes[text] > taken
        out = np.zeros(len(text), np.uint8)
        out[left] = data[ends[text[left]] - taken - 1] + 1
        return out

    text = np.arange(m)
    bwt, lcp = symbol(text, 0), np.zeros(m, np.uint8)
    rows = np.arange(m)  # rows of the suffixes inserted last, in order
    for taken in range(1, int(sizes.max(initial=0)) + 1):
        live = bwt[rows] > 0
        rows, text = rows[live], text[live]
        order = np.argsort(bwt, kind="stable")  # rows by their symbol: the order of all longer suffixes
        bounds = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
        symbols = bwt[rows]
        by_symbol = np.argsort(symbols, kind="stable")
        rows, text, symbols = rows[by_symbol], text[by_symbol], symbols[by_symbol]
        place = np.empty(len(rows), np.int64)  # where the new suffixes stand in ``order``
        edge = np.searchsorted(symbols, np.arange(257))
        for s in np.unique(symbols).tolist():
            part = slice(edge[s], edge[s + 1])
            place[part] = bounds[s] + np.searchsorted(order[bounds[s] : bounds[s + 1]], rows[part])
        padded = np.append(lcp, np.uint8(0))
        before = least_between(padded, order, place - 1, place, bounds)
        after = least_between(padded, order, place, place + 1, bounds)
        # of the rows in ``order``, those without a symbol (text fronts) make no longer suffix
        target = place - bounds[1] + m
        n = len(bwt) + len(rows)
        old = np.ones(n, bool)
        old[target] = False
        new_bwt, new_lcp = np.empty(n, np.uint8), np.empty(n + 1, np.uint8)
        new_bwt[old], new_bwt[target] = bwt, symbol(text, taken)
        new_lcp[:n][old], new_lcp[target] = lcp, before
        new_lcp[target + 1] = np.where(old[np.minimum(target + 1, n - 1)], after, new_lcp[target + 1])
        bwt, lcp, rows = new_bwt, new_lcp[:n], target
    return bwt, lcp


def least_between(lcp: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1 + least common prefix between rows order[left] and order[right] (at most 255); 0 where
    they are not neighbours with the same symbol."""
    border = np.zeros(len(order) + 1, bool)
    border[bounds[bounds <= len(order)]] = True
    inside = (left >= 0) & (right < len(order))
    inside[inside] = ~border[right[inside]]
    out = np.zeros(len(left), np.uint8)
    if inside.any():
        spans = np.stack([order[left[inside]] + 1, order[right[inside]] + 1], axis=1).ravel()
        least = np.minimum.reduceat(lcp, spans)[::2]
        out[inside] = np.minimum(least, 254) + 1
    return out


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of the windows of a collection that also start earlier."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    bwt, lcp = collection_bwt(texts)
    order = np.argsort(bwt, kind="stable")
    fronts = np.count_nonzero(bwt == 0)
    step = np.empty(len(bwt), np.int64)  # row of a suffix -> row of the next longer one
    step[order] = np.arange(len(bwt)) - fronts + m
    row, text = np.arange(m), np.arange(m)
    found_row, found_text, found_window = [], [], []
    for taken in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[text] >= taken
        row, text = step[row[live]], text[live]
        if taken >= LENGTH:
            found_row.append(row)
            found_text.append(text)
            found_window.append(sizes[text] - taken)
    row, text, window = (np.concatenate(x) for x in (found_row, found_text, found_window))
    by_row = np.argsort(row)
    text, window, same = text[by_row], window[by_row], lcp[row[by_row]] >= LENGTH
    place = np.empty(len(text), [("doc", np.int64), ("at", np.int64)])
    place["doc"], place["at"] = doc[text], start[text] + window
    group = np.cumsum(~same) - 1
    rank = np.lexsort((place["at"], place["doc"], group))
    first_of = rank[np.searchsorted(group[rank], np.arange(group[-1] + 1))]
    later = place != place[first_of[group]]
    return text[later], window[later]


def compare_collections(strings: DataFrame) -> DataFrame:
    """Places of the repeated windows: start and number of consecutive windows."""

    def places(part: list[tuple]) -> pa.RecordBatch:
        texts = [p[0] for p in part]
        doc, crc, start = (np.array([p[i] for p in part], np.int64) for i in (1, 2, 3))
        text, window = repeated_windows(texts, doc, start)
        order = np.lexsort((window, text))
        text, window = text[order], window[order]
        opens = np.ones(len(text), bool)
        opens[1:] = (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(opens)
        n = np.diff(np.append(at, len(text)))
        return pa.RecordBatch.from_pydict({"_id": doc[text[at]], "_crc": crc[text[at]], "start": start[text[at]] + window[at], "n": n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, part = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("collection", "bytes", "_id", "_crc", "start")]
            for collection, *row in zip(*columns):
                if collection != current and part:
                    yield places(part)
                    part = []
                current = collection
                part.append(row)
        if part:
            yield places(part)
        give_back_memory()

    return strings.repartition("collection").sortWithinPartitions("collection").mapInArrow(run, PLACE)


def repeated_places(documents: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(_id, _crc, _spans) of every document with repeated windows; a span is the start of a run
    of windows, times 256, plus their number."""
    spark = documents.sparkSession
    small_batches(spark)
    found = scratch.save(compared_pieces(dealt_pieces(documents, input_parts(documents))))
    release(spark)
    asked = found.where("crowd is not null")
    collections = 1 + asked.where(F.col("crowd") <= crowd).count() // COLLECTION
    fetched = scratch.save(fetch_bytes(documents, asked, collections, crowd))
    release(spark)
    strings = fetched.where("collection is not null").select("collection", "bytes", "_id", "_crc", "start")
    windows = fetched.where("collection is null").select("h0", "h1", "_id", "_crc", "start")
    compared = scratch.save(compare_collections(strings))
    release(spark)
    later = scratch.save(compare_windows(windows, input_parts(documents)))
    scratch.drop(fetched)
    release(spark)
    places = found.where("crowd is null").select("_id", "_crc", "start", "n").unionByName(compared).unionByName(later)
    return places.groupBy("_id", "_crc").agg(F.collect_list(F.col("start") * 256 + F.col("n")).alias("_spans"))


def keep(text: str | None, spans: np.ndarray | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go and in how many runs."""
    data = text.encode() if isinstance(text, str) else b""
    if spans is None or not len(spans):
        return data, 0, 0
    change = np.zeros(len(data) + 1, np.int32)
    start, n = spans >> 8, spans & 255
    np.add.at(change, start, 1)
    np.add.at(change, start + n + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All columns, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text added.

    ``kept_text`` drops the halves of characters that a cut went through.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    spans = scratch.save(repeated_places(documents, scratch))
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    columns = [c for c in documents.columns if c not in added]
    rows = documents.select(boxed(documents), "doc_id", "text")
    rows = keyed(rows).join(spans, ["_id", "_crc"], "left").select("_row", "text", "_spans")

    @F.pandas_udf("struct<n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string>")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, places):
            kept, removed, runs = keep(text, spans)
            whole = len(kept) + removed
            out.append((whole, removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        return pd.DataFrame(out, columns=added)

    done = rows.select("_row", cut("text", "_spans").alias("_cut"))
    return done.select(*unboxed(columns), *[F.col(f"_cut.{c}").alias(c) for c in added])

