"""Line dedup by a sharded minimal perfect hash over the hashes of repeated lines.

A line's key is the line without white space at both ends, A-Z in lower case; keys of fewer than
``MIN_CHARS`` code points are left alone. A key found in two documents or more keeps its lines in
the smallest doc_id only.

1. Each task hashes its lines (MD5, 128 bits) and sends every distinct key once, with the smallest
   and largest doc_id and the number of documents it saw; Spark aggregates these rows, so a line
   that all documents share costs a row per task. Keys with two different holders are repeated.
2. Repeated keys are dealt by hash into shards. A shard becomes one record: a minimal perfect hash
   (levels of bit arrays, in which a key that is alone at its place settles and the others go on)
   and, in its order, arrays of fingerprints, document counts and smallest holders.
3. Documents probe: a task sends each distinct key of its lines once, with its smallest holder there,
   packed by shard. The shard's stream begins with its record, and packets are looked up in the
   arrays. A place of the array answers for any key, so a 64-bit fingerprint tells members apart;
   it and the place come from all 128 bits. All other holders in the task lose the line at once,
   since a smaller one is known, so a common line is one probe per task.
4. What documents lose is gathered per document and the texts are cut.

Edge cases: a null or empty text is one empty line. A null doc_id counts as one document after all
others. Rows that share a doc_id are one document, each row is cut. Empty tables give no rows. Texts
are cut whole, however long. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnloom.llm.common import boxed, mix64, small_batches, unboxed
from learnloom.session import Scratch

MIN_CHARS = 10
SHARD_KEYS = 500_000  # repeated keys of a shard
TASK_KEYS = 200_000  # distinct keys (five times as many holders) that a task collects before it sends them
PACKET = 4096  # probes of a packet
SPREAD = 2  # places per key on each level of the hash
LAST = (1 << 63) - 1  # doc_id that stands for null
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """16-byte hash of a line's key, None for keys that are too short."""
    key = line.strip(WHITE_BYTES)
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return hashlib.md5(key.lower(), usedforsecurity=False).digest()


class Seen:
    """Distinct keys of a task with their smallest and largest holder and number of holders."""

    def __init__(self):
        self.holders: dict[bytes, list[int]] = {}
        self.held = 0

    def add(self, doc: int, text: str | None) -> None:
        for key in {line_key(line) for line in (text or "").encode().split(b"\n")}:
            if key is None:
                continue
            self.holders.setdefault(key, []).append(doc)
            self.held += 1

    def take(self) -> tuple[np.ndarray, list[list[int]]]:
        """Keys as rows of two 64-bit halves, and their holders; starts anew."""
        halves = np.frombuffer(b"".join(self.holders), np.uint64).reshape(-1, 2)
        holders, self.holders, self.held = list(self.holders.values()), {}, 0
        return halves, holders


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    seen = Seen()
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            seen.add(doc, text)
            if len(seen.holders) >= TASK_KEYS or seen.held >= 5 * TASK_KEYS:
                yield seen.take()
    if seen.holders:
        yield seen.take()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for halves, holders in _collected(batches):
        signed = halves.view(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"h1": signed[:, 0], "h2": signed[:, 1], "least": np.array(list(map(min, holders)), np.int64),
             "most": np.array(list(map(max, holders)), np.int64), "n": np.array([len(set(d)) for d in holders], np.int64)}
        )


# ---- minimal perfect hash ---------------------------------------------------------------------


def _places(halves: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key on a level, from both halves of its hash."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
    return (mix64(halves[:, 0] ^ mix64(halves[:, 1] + salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Bijection of distinct 128-bit keys onto 0..n-1, held as one bit array per level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        settled = [int(bits.sum()) for bits in levels]
        self.before = np.cumsum([0, *settled])
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]

    @classmethod
    def build(cls, halves: np.ndarray) -> "PerfectHash":
        levels = []
        while len(halves):
            size = SPREAD * len(halves) + 1
            places = _places(halves, len(levels), size)
            bits = np.bincount(places, minlength=size) == 1
            levels.append(bits)
            halves = halves[~bits[places]]
        return cls(levels)

    def index(self, halves: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or any index for what is not a member."""
        out = np.full(len(halves), -1, np.int64)
        left = np.arange(len(halves))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            places = _places(halves[left], level, len(bits))
            hit = bits[places]
            out[left[hit]] = self.before[level] + ranks[places[hit]]
            left = left[~hit]
        return out

    def packed(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.levels], b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpacked(cls, sizes: list[int], data: bytes) -> "PerfectHash":
        levels, at = [], 0
        for size in sizes:
            n = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(levels)


class Shard:
    """Arrays of a shard in the order of its perfect hash."""

    def __init__(self, table: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.table, self.fingerprints, self.counts, self.holders = table, fingerprints, counts, holders

    @classmethod
    def build(cls, halves: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> "Shard":
        table = PerfectHash.build(halves)
        order = np.argsort(table.index(halves))
        return cls(table, halves[order, 1], counts[order], holders[order])

    def record(self) -> bytes:
        sizes, bits = self.table.packed()
        head = np.array([len(sizes), len(self.counts), *sizes], np.int64).tobytes()
        return b"".join([head, self.fingerprints.tobytes(), self.counts.tobytes(), self.holders.tobytes(), bits])

    @classmethod
    def read(cls, record: bytes) -> "Shard":
        levels, n = np.frombuffer(record, np.int64, 2).tolist()
        sizes, at = np.frombuffer(record, np.int64, levels, 16).tolist(), 16 + 8 * levels
        part = lambda i, kind: np.frombuffer(record, kind, n, at + 8 * n * i)
        return cls(PerfectHash.unpacked(sizes, record[at + 24 * n :]), part(0, np.uint64), part(1, np.int64), part(2, np.int64))

    def look_up(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, smallest holder) of each key; 0 documents: not a member."""
        if not len(self.counts):
            return np.zeros(len(halves), np.int64), np.full(len(halves), LAST)
        index = self.table.index(halves)
        member = (index >= 0) & (self.fingerprints[index] == halves[:, 1])
        return np.where(member, self.counts[index], 0), np.where(member, self.holders[index], LAST)


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(h1.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per shard from its keys (sorted by shard)."""
    shard, parts = None, []

    def record() -> pa.RecordBatch:
        h1, h2, n, least = (np.concatenate(c) for c in zip(*parts))
        halves = np.column_stack([h1, h2]).view(np.uint64)
        return pa.RecordBatch.from_pydict(
            {"shard": np.array([shard], np.int64), "kind": np.array([0], np.int32),
             "data": pa.array([Shard.build(halves, n, least).record()], pa.binary())}
        )

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        columns = [batch.column(c).to_numpy() for c in ("h1", "h2", "n", "least")]
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if parts and shards[a] != shard:
                yield record()
                parts = []
            shard = int(shards[a])
            parts.append([c[a:b] for c in columns])
    if parts:
        yield record()


PROBE = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("doc", "<i8")])
LOST = "doc long, h1 long, h2 long"


def _probes(shards: int):
    """Per task: keys that some holder loses here for certain, and packets of probes by shard.

    One shape for both: kind 1 is a packet for a shard, kind 2 a packet of (key, doc) to drop.
    """

    def packets(probes: np.ndarray, shard: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
        for at in range(0, len(probes), PACKET):
            yield shard, kind, probes[at : at + PACKET].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for halves, holders in _collected(batches):
            signed = halves.view(np.int64)
            least = np.array(list(map(min, holders)), np.int64)
            sizes = np.array(list(map(len, holders)))
            docs = np.fromiter((d for held in holders for d in held), np.int64, int(sizes.sum()))
            row = np.repeat(np.arange(len(holders)), sizes)
            larger = docs != least[row]
            known = np.empty(int(larger.sum()), PROBE)
            known["h1"], known["h2"], known["doc"] = signed[row[larger], 0], signed[row[larger], 1], docs[larger]
            ask = np.empty(len(holders), PROBE)
            ask["h1"], ask["h2"], ask["doc"] = signed[:, 0], signed[:, 1], least
            to = _shard_of(ask["h1"], shards)
            order = np.argsort(to, kind="stable")
            ask, to = ask[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
            rows = [p for a, b in zip(cuts, [*cuts[1:], len(to)]) for p in packets(ask[a:b], int(to[a]), 1)]
            # what is known needs no shard, the number only spreads it
            rows += [(i % shards, 2, data) for i, (_, _, data) in enumerate(packets(known, 0, 2))]
            for at in range(0, len(rows), 256):
                shard, kind, data = zip(*rows[at : at + 256])
                yield pa.RecordBatch.from_pydict(
                    {"shard": np.array(shard, np.int64), "kind": np.array(kind, np.int32), "data": pa.array(data, pa.binary())}
                )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key) that go; a shard's record comes before its packets."""
    shard, arrays = None, None
    for batch in batches:
        for at, kind, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "data"))):
            if at != shard:
                shard, arrays = at, None
            if kind == 0:
                arrays = Shard.read(data)
                continue
            probes = np.frombuffer(data, PROBE)
            if kind == 1:
                if arrays is None:  # no repeated key in this shard
                    continue
                halves = np.column_stack([probes["h1"], probes["h2"]]).view(np.uint64)
                count, holder = arrays.look_up(halves)
                probes = probes[(count > 1) & (holder != probes["doc"])]
            if len(probes):
                yield pa.RecordBatch.from_pydict({c: np.ascontiguousarray(probes[c]) for c in ("doc", "h1", "h2")})


def repeated_keys(texts: DataFrame) -> DataFrame:
    """(h1, h2, least, n) of the keys found in at least two documents of (doc, text)."""
    counted = texts.mapInArrow(_count, "h1 long, h2 long, least long, most long, n long")
    totals = counted.groupBy("h1", "h2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    return totals.where("least < most").drop("most")


def lost_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, keys): hashes of the keys whose lines a document loses."""
    small_batches(documents.sparkSession)
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    keys = scratch.save(repeated_keys(texts))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // SHARD_KEYS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = pa.array(_shard_of(batch.column("h1").to_numpy(), shards))
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], ["shard", *batch.schema.names])

    spread = keys.mapInArrow(dealt, "shard long, h1 long, h2 long, least long, n long").repartition("shard")
    spread = spread.sortWithinPartitions("shard")
    records = scratch.save(spread.mapInArrow(_build, "shard long, kind int, data binary"))
    probes = texts.mapInArrow(_probes(shards), "shard long, kind int, data binary")
    stream = records.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "kind")
    lost = stream.mapInArrow(_answer, LOST)
    return lost.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))


KEPT = "kept_text string, n_lines long, n_dropped long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist()):
            data = (text or "").encode()
            lines = data.split(b"\n")
            if lost:
                keys = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in lost}
                kept = [line for line in lines if line_key(line) not in keys]
                data = b"\n".join(kept)
            else:
                kept = lines
            out.append((data.decode(), len(lines), len(lines) - len(kept), hashlib.sha256(data).hexdigest()))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        cut = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)]
        names = ["kept_text", "n_lines", "n_dropped", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), *cut], ["_row", *names])


def drop_repeated_lines(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``documents`` (needs doc_id, text) with kept_text, n_lines, n_dropped and
    kept_sha256 (of those names the operator's values win)."""
    scratch = scratch or Scratch(documents.sparkSession)
    lost = lost_lines(documents, scratch)
    new = [c.split()[0] for c in KEPT.split(", ")]
    names = [c for c in documents.columns if c not in new]
    rows = documents.select(boxed(documents.select(*names)), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    joined = rows.join(lost, "doc", "left").select("_row", "text", "lost")
    schema = joined.select("_row").schema.simpleString()[len("struct<_row:") : -1]
    cut = joined.mapInArrow(_cut, f"_row {schema}, {KEPT}")
    return cut.select(*unboxed(names), *new)


# Keys that occur in two documents, their smallest holder, and the lines that stay.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {LAST}) AS doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT rid, doc, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM docs)),
held AS (SELECT k, min(doc) AS least FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING min(doc) < max(doc)),
marked AS (SELECT rid, i, l, coalesce(doc <> least, false) AS gone FROM lines LEFT JOIN held USING (k)),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS body FROM marked GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(body) AS kept_sha256 FROM docs JOIN kept USING (rid)
"""
