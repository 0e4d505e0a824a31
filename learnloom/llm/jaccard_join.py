"""Exact Jaccard self-join of documents on word shingles with PartEnum signatures.

Two sets link when their Jaccard similarity is at least 4/5, so their symmetric difference is
at most a ninth of their sizes together. Sets are put into size bands whose bounds grow by 5/4:
partners are in the same or the next band. For band i all sets of bands i and i-1 see the
feature domain cut by hash into the same ``n1`` first-level parts, and each of these into
``SECOND`` second-level parts. With at most k differences between two linked sets:

- no more than k/2 first-level parts hold two or more differences, and ``n1`` is greater;
- any other part holds at most one, so all but one of its second-level parts agree. Each subset
  of ``SECOND`` - 1 of them is enumerated as one signature, and one of these is shared;
- a set leaves out subsets without features as long as fewer than n1 - k/2 of its parts have
  one (a part that agrees and has none is left over then); otherwise it publishes them all.

Signatures are dealt by hash in compact binary records. A signature with few sets gives all
their pairs; one with many gives pairs with its smallest set. Before any set is fetched, 256
parity bits per set bound the difference from below; what remains is verified on the full sets.
Sets that these links leave outside their smallest set's component are compared in blocks: sets
connected by crowded signatures form a group, and blocks of those left outside meet blocks of
the whole group, by products of their feature matrices. Linked sets hold at least 4/5 of their
features in common, so a set with more than a fifth of its features to itself in its group links
with none of it and meets no block. A pair meets once, not once for
each signature, and a block gives the links of a spanning forest only. Equal sets are one class
from the start, so copies are never paired.

Edge cases: a null or blank text has an empty set and links with nothing. Texts of fewer than
five words are one shingle. Repeated rows are copies. A null doc_id never names a component
that has another id. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from learnloom.llm import components as cc
from learnloom.llm.common import boxed, chunks, input_parts, mix64, release, small_batches, text_bytes, unboxed
from learnloom.llm.shingles import shingle_sets
from learnloom.operators.sequence import number_rows
from learnloom.session import Scratch

SECOND = 3  # second-level parts of a first-level part
SPARE = 0.1  # first-level parts beyond k/2 + 1, so that empty subsets need not be published
FEW = 16  # sets of a signature that are paired with each other at once
BLOCK_SETS = 2048  # sets of a block
BLOCK_FEATURES = 1 << 20  # and their features, as long as one set does not have more
SLICE_FEATURES = 1 << 24  # features of a cluster that are counted in one part, 13 bytes each
STEP_FEATURES = 1 << 20  # and of these in one sort
RECORD = np.dtype([("sig", "u1", (5,)), ("key", "<u8")])


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast, since the driver builds a broadcast
    whole, and the runtime would make one of every side that is small when compressed."""
    return side.hint("merge")


def bands(largest: int) -> np.ndarray:
    """Upper bounds of the size bands, up to one beyond ``largest``."""
    out = [1]
    while out[-1] < largest:
        out.append((out[-1] + 1) * 5 // 4)
    out.append((out[-1] + 1) * 5 // 4)
    return np.array(out, np.int64)


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, 64-bit key and 256 parity bits (four integers) of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    key = sizes.astype(np.uint64)
    np.add.at(key, owner, mix64(every ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    key = mix64(key) & ~np.uint64(1)  # the lowest bit is a flag of the records
    counts = np.bincount(owner * 256 + (every & np.uint64(255)).astype(np.int64), minlength=256 * len(sets))
    bits = np.packbits((counts & 1).astype(np.uint8).reshape(-1, 256), axis=1).copy().view(np.int64)
    return sizes, key, bits.reshape(-1, 4)


def signatures(sets: list[np.ndarray], key: np.ndarray, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, key) of all sets; the key's lowest bit is set in the set's own band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    limits = bands(int(sizes.max(initial=1))) if limits is None else limits
    band = np.searchsorted(limits, sizes)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out_sig, out_key = [], []
    for step in (0, 1):  # the own band's cut, then the next band's
        instance = band + step
        bad = limits[instance] // 9  # parts that may hold two differences or more: k/2
        parts = np.where((2 * limits[instance] >= 9) & (sizes > 0), bad + 1 + np.ceil(SPARE * (bad + 1)).astype(np.int64) + 1, 0)
        total = int(parts.sum())
        if not total:
            continue
        live = parts[owner] > 0
        features, of = every[live], owner[live]
        base = np.cumsum(parts) - parts
        seed = mix64(instance.astype(np.uint64) + np.uint64(77))
        spread = mix64(features ^ seed[of])
        cell = ((spread >> np.uint64(32)) * (parts[of] * SECOND).astype(np.uint64)) >> np.uint64(32)
        at = base[of] * SECOND + cell.astype(np.int64)
        count = np.bincount(at, minlength=total * SECOND).reshape(total, SECOND)
        content = np.zeros(total * SECOND, np.uint64)
        np.add.at(content, at, mix64(spread))
        content = content.reshape(total, SECOND)
        of_part = np.repeat(np.arange(len(sets)), parts)
        number = (np.arange(total) - base[of_part]).astype(np.uint64)
        filled = count.sum(axis=1, keepdims=True) > count  # by the second-level part left out
        weak = np.bincount(of_part, weights=~filled.all(axis=1), minlength=len(sets)).astype(np.int64)
        whole = weak >= parts - bad  # publishes every subset
        for left_out in range(SECOND):
            chosen = np.flatnonzero(whole[of_part] | filled[:, left_out])
            subset = content[chosen].sum(axis=1) - content[chosen, left_out]
            name = mix64(seed[of_part[chosen]] + number[chosen] * np.uint64(SECOND) + np.uint64(left_out))
            out_sig.append(mix64(subset + name))
            out_key.append(key[of_part[chosen]] | np.uint64(1 - step))
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_sig), np.concatenate(out_key)


def text_crc() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc")


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, text_crc, n_shingles, key, p0..p3): the narrow table of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sizes, key, bits = set_keys(shingle_sets(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "text_crc": batch.column("text_crc"), "n_shingles": sizes, "key": key.view(np.int64)}
                | {f"p{i}": np.ascontiguousarray(bits[:, i]) for i in range(4)}
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_crc(), "text")
    return rows.mapInArrow(run, "doc_id long, text_crc long, n_shingles long, key long, p0 long, p1 long, p2 long, p3 long")


def dealt_signatures(documents: DataFrame, parts: int) -> DataFrame:
    """(part, records): the signatures of all documents, dealt by hash into ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")))
            _, key, _ = set_keys(sets)
            _, first = np.unique(key, return_index=True)
            sig, key = signatures([sets[i] for i in first], key[first])
            to = ((sig >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            records = np.empty(len(sig), RECORD)
            records["sig"] = sig[order].view(np.uint8).reshape(-1, 8)[:, :5]
            records["key"] = key[order]
            used, starts = np.unique(to[order], return_index=True)
            blobs = [r.tobytes() for r in np.split(records, starts[1:])] if len(used) else []
            yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "records": pa.array(blobs, pa.binary())})

    return documents.select("text").mapInArrow(run, "part int, records binary")


def shared_signatures(dealt: DataFrame) -> DataFrame:
    """(many, sig, a, b): pairs of the signatures with few sets; for one with many sets its
    smallest set with each other (many = true), ``sig`` naming the signature."""

    def pairs_of(blobs: list[bytes], part: int) -> pa.RecordBatch:
        records = np.frombuffer(b"".join(blobs), RECORD)
        sig = np.zeros((len(records), 8), np.uint8)
        sig[:, :5] = records["sig"]
        sig = sig.view(np.uint64).ravel()
        key = records["key"]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, own, key = sig[fresh], (key[fresh] & np.uint64(1)).astype(bool), key[fresh] & ~np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
        size = np.diff(np.append(starts, len(sig)))
        run = np.repeat(np.arange(len(starts)), size)
        left, right = [key[:0]], [key[:0]]
        few = np.repeat((size > 1) & (size <= FEW), size)
        for gap in range(1, FEW):
            i = np.flatnonzero(few[: len(few) - gap] & (run[: len(run) - gap] == run[gap:])) if len(run) > gap else np.zeros(0, int)
            i = i[own[i] | own[i + gap]]
            left.append(key[i])
            right.append(key[i + gap])
        a, b = np.concatenate(left), np.concatenate(right)
        low, high = np.minimum(a, b).view(np.int64), np.maximum(a, b).view(np.int64)
        pairs = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
        hot = np.flatnonzero(np.repeat(size > FEW, size))
        name = (sig[hot] | (np.uint64(part) << np.uint64(40))).view(np.int64)
        many = np.concatenate([np.zeros(len(pairs), bool), np.ones(len(hot), bool)])
        return pa.RecordBatch.from_pydict(
            {
                "many": many,
                "sig": np.concatenate([np.zeros(len(pairs), np.int64), name]),
                "a": np.concatenate([pairs[:, 0], key[starts[run[hot]]].view(np.int64)]),
                "b": np.concatenate([pairs[:, 1], key[hot].view(np.int64)]),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("records").to_pylist()):
                if p != part and blobs:
                    yield pairs_of(blobs, part)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield pairs_of(blobs, part)

    by_part = dealt.repartition("part").sortWithinPartitions("part")
    return by_part.mapInArrow(run, "many boolean, sig long, a long, b long")


def may_link(left: str, right: str):
    """Bounds that every linked pair keeps: the ratio of sizes and the differing parity bits."""
    n, m = F.col(f"{left}_n"), F.col(f"{right}_n")
    differing = sum((F.bit_count(F.col(f"{left}_p{i}").bitwiseXOR(F.col(f"{right}_p{i}"))) for i in range(4)), F.lit(0))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differing <= n + m)


def named(classes: DataFrame, prefix: str) -> DataFrame:
    return classes.select(
        F.col("key").alias(prefix), F.col("n_shingles").alias(f"{prefix}_n"), *[F.col(f"p{i}").alias(f"{prefix}_p{i}") for i in range(4)]
    )


def fetch_sets(documents: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, features): the full set of each class in ``keys``, from one document of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column("text")))
            _, key, _ = set_keys(sets)
            yield pa.RecordBatch.from_pydict(
                {"key": key.view(np.int64), "features": pa.array([s.tobytes() for s in sets], pa.binary())}
            )

    none = F.lit(-(2**63))
    wanted = classes.join(shuffled(keys), "key", "left_semi").select(F.coalesce("rep", none).alias("_id")).distinct()
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"), "text").join(shuffled(wanted), "_id", "left_semi")
    return rows.select("text").mapInArrow(run, "key long, features binary")


def verify(pairs: DataFrame, sets: DataFrame, most: int = 256) -> DataFrame:
    """The pairs (a, b) whose sets link. The set of ``a`` is sent once per ``most`` partners."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("_salts"))
    partner = sets.groupBy("key").agg(F.first("features").alias("features"))  # ids may repeat
    left = (
        salts.join(shuffled(partner), salts.a == partner.key)
        .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "features")
    )
    right = (
        pairs.join(shuffled(salts), "a")
        .join(shuffled(partner), F.col("b") == partner.key)
        .select("a", F.pmod(F.xxhash64("b"), F.col("_salts")).alias("salt"), "b", "features")
    )
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for i, blob in enumerate(batch.column("features")):
                features = np.frombuffer(blob.as_buffer(), np.uint64)
                if b[i] is None:
                    mine = features
                    continue
                common = len(np.intersect1d(mine, features, assume_unique=True))
                if 9 * common >= 4 * (len(mine) + len(features)):
                    found.append(i)
            yield pa.RecordBatch.from_pydict(
                {"u": pa.array([a[i] for i in found], pa.int64()), "v": pa.array([b[i] for i in found], pa.int64())}
            )

    return rows.mapInArrow(run, "u long, v long")


def with_slices(people: DataFrame) -> DataFrame:
    """``people`` with ``slices``: the parts that the features of a set's cluster have for themselves,
    0 for a cluster that shares a part with others. The broadcast has a row per SLICE_FEATURES / 4."""
    size = people.groupBy("cluster").agg(F.sum("n_shingles").alias("_size")).where(F.col("_size") > SLICE_FEATURES // 4)
    large = size.select("cluster", F.ceil(F.col("_size") / SLICE_FEATURES).alias("slices"))
    return people.join(F.broadcast(large), "cluster", "left").withColumn("slices", F.coalesce("slices", F.lit(0)))


def alone_counts(people: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(key, alone): features that no other set of the cluster holds; their sum over a key's rows.

    A cluster is dealt to one part, or by feature to as many as its size takes, in the records of
    the signatures. So a set has one row, and more only in a cluster above SLICE_FEATURES. Two
    features of one name only keep a set that could have gone.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("features")]
            sizes = [len(s) for s in sets]
            cluster = np.repeat(mix64(batch.column("cluster").to_numpy().view(np.uint64)), sizes)
            slices = np.repeat(batch.column("slices").to_numpy().astype(np.uint64), sizes)
            name = mix64(np.concatenate(sets) ^ cluster)
            part = (name >> np.uint64(40)) % np.maximum(slices, np.uint64(1))
            own = (mix64(cluster + part) >> np.uint64(2)) | np.uint64(1 << 62)
            to = np.where(slices > 0, own, (cluster >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            records = np.empty(len(name), RECORD)
            records["sig"] = name[order].view(np.uint8).reshape(-1, 8)[:, :5]
            records["key"] = np.repeat(batch.column("key").to_numpy().view(np.uint64), sizes)[order]
            used, starts = np.unique(to[order], return_index=True)
            blobs = [r.tobytes() for r in np.split(records, starts[1:])] if len(used) else []
            yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int64()), "records": pa.array(blobs, pa.binary())})

    def alone(blobs: list[bytes]) -> pa.RecordBatch:
        dealt = [np.frombuffer(blob, RECORD) for blob in blobs]
        steps = min(255, -(-sum(len(r) for r in dealt) // STEP_FEATURES))
        owners, numbers = [], []
        for step in range(steps):  # by the last byte of the names: bounds the memory of the sort
            records = np.concatenate([r[r["sig"][:, 0] % steps == step] for r in dealt])
            if not len(records):
                continue
            name = np.zeros((len(records), 8), np.uint8)
            name[:, :5] = records["sig"]
            order = np.argsort(name.view(np.uint64).ravel(), kind="stable")
            name, key = name.view(np.uint64).ravel()[order], records["key"][order]
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            single = np.minimum.reduceat(key, starts) == np.maximum.reduceat(key, starts)
            size = np.diff(np.append(starts, len(name)))
            owner, n = np.unique(key[np.repeat(single, size)], return_counts=True)
            owners.append(owner)
            numbers.append(n)
        owner, at = np.unique(np.concatenate(owners), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(numbers), minlength=len(owner)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"key": owner.view(np.int64), "alone": total})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("records").to_pylist()):
                if p != part and blobs:
                    yield alone(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield alone(blobs)

    each = with_slices(people).select("key", "cluster", "slices").join(shuffled(sets.groupBy("key").agg(F.first("features").alias("features"))), "key")
    dealt = each.mapInArrow(deal, "part long, records binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "key long, alone long")


def in_company(people: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(key): the sets of ``people`` that hold 4/5 of their features together with other sets of
    their cluster. No other set can link inside its cluster."""
    counts = alone_counts(people, sets, parts).groupBy("key").agg(F.sum("alone").alias("alone"))
    lonely = people.join(shuffled(counts), "key").where("5 * alone > n_shingles").select("key")
    return people.select("key").join(shuffled(lonely), "key", "left_anti")


def set_blocks(people: DataFrame) -> DataFrame:
    """(cluster, band, a_block, b_block, side, key, own): the meetings of the blocks of each cluster.

    ``people``: key, n_shingles, cluster, outside. Sides are 0 for sets left outside and 1 for
    all; each block of one side meets each of the other. Linked sets are in the same or in
    adjacent bands, so a set goes to its own and to the next band.
    """
    own = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(1.2501)))  # a little over 5/4: rounding cannot part partners
    dealt = people.withColumn("_own", own).select(
        "cluster", "key", "outside", "_own", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("band")
    )
    most = F.pow(F.lit(1.2501), F.col("band") + 1)
    sets = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(BLOCK_FEATURES / most))).cast("long")
    dealt = dealt.select("cluster", "band", "key", "outside", (F.col("_own") == F.col("band")).alias("own"), sets.alias("sets"))
    where = ["cluster", "band"]
    everyone = number_rows(dealt, where, ["key"], "at").withColumn("block", F.floor(F.col("at") / F.col("sets")))
    outside = number_rows(dealt.where("outside"), where, ["key"], "at").withColumn("block", F.floor(F.col("at") / F.col("sets")))
    blocks_of = lambda df, name: df.groupBy(*where).agg((F.max("block") + 1).alias(name))
    left = outside.join(shuffled(blocks_of(everyone, "_n")), where)
    right = everyone.join(shuffled(blocks_of(outside, "_n")), where)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return left.select(*where, F.col("block").alias("a_block"), numbers.alias("b_block"), F.lit(0).alias("side"), "key", "own").unionByName(
        right.select(*where, numbers.alias("a_block"), F.col("block").alias("b_block"), F.lit(1).alias("side"), "key", "own")
    )


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Size of the intersection of each set of ``left`` with each of ``right``.

    Features that the same sets hold are one column, weighted by their number.
    """

    def matrix(column: np.ndarray, owner: np.ndarray, rows: int, low: int, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, width), weight.dtype)
        a, b = np.searchsorted(column, [low, low + width])
        out[owner[a:b], column[a:b] - low] = weight[column[a:b]]
        return out

    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides, holders = [], np.zeros(len(shared), np.uint64)
    for side, sets in enumerate((left, right)):
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, every)
        at[at == len(shared)] = 0
        known = np.flatnonzero(shared[at] == every) if len(shared) else np.zeros(0, int)
        sides.append((at[known], owner[known], len(sets)))
        np.add.at(holders, at[known], mix64(2 * owner[known].astype(np.uint64) + np.uint64(side + 1)))
    _, first, column, weight = np.unique(holders, return_index=True, return_inverse=True, return_counts=True)
    keep = np.zeros(len(shared), bool)
    keep[first] = True
    merged = []
    for at, owner, rows in sides:
        at, owner = at[keep[at]], owner[keep[at]]
        order = np.argsort(column[at], kind="stable")
        merged.append((column[at][order], owner[order], rows))
    exact = np.float32 if len(shared) < 1 << 24 else np.float64
    weight, one = weight.astype(exact), np.ones(len(weight), exact)
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(weight), width):
        out += (matrix(*merged[0], low, weight) @ matrix(*merged[1], low, one).T).astype(np.int64)
    return out


def met_features(keys: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray | None]:
    """Of each set the features that a set of another key holds; None for a set of which they are
    less than 4/5: it links with none of these. Repeated until no more set goes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    live = np.ones(len(sets), bool)
    while len(every):
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        holder = keys[owner]
        met = np.minimum.reduceat(holder, starts) != np.maximum.reduceat(holder, starts)
        here = np.repeat(met, np.diff(np.append(starts, len(every))))
        stay = live & (5 * np.bincount(owner[here], minlength=len(sets)) >= 4 * sizes)
        more = (live & ~stay).any()
        here &= stay[owner]
        every, owner, live = every[here], owner[here], stay
        if not more:
            break
    order = np.argsort(owner, kind="stable")
    split = np.split(every[order], np.searchsorted(owner[order], np.arange(1, len(sets))))
    return [found if ok else None for found, ok in zip(split, live)]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the graph whose edges are the true cells."""
    edges, open_row, open_column = [], np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    for start in range(linked.shape[0]):
        if not open_row[start]:
            continue
        open_row[start] = False
        rows = [start]
        while rows:
            row = rows.pop()
            for column in np.flatnonzero(linked[row] & open_column).tolist():
                open_column[column] = False
                edges.append((row, column))
                more = np.flatnonzero(linked[:, column] & open_row).tolist()
                open_row[more] = False
                edges += [(r, column) for r in more]
                rows += more
    return edges


def links_of_blocks(meeting: pa.Table) -> pa.Table:
    """(u, v) of one meeting of two blocks: a spanning forest of its links."""
    sides = []
    for side in (0, 1):
        rows = meeting.filter(pc.equal(meeting.column("side"), side))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("features")]
        sides.append((rows.column("key").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False), sets))
    edges, whole = [], [sets for _, _, sets in sides]
    if all(whole):
        met = met_features(np.concatenate([key for key, _, _ in sides]), whole[0] + whole[1])
        for i, found in enumerate((met[: len(whole[0])], met[len(whole[0]) :])):
            stay = np.array([f is not None for f in found])
            sides[i] = (sides[i][0][stay], sides[i][1][stay], [f for f in found if f is not None])
            whole[i] = np.array([len(s) for s in whole[i]])[stay]
    (a, a_own, left), (b, b_own, right) = sides
    if left and right:
        sizes = whole[0][:, None] + whole[1][None, :]
        linked = (9 * common_counts(left, right) >= 4 * sizes) & (a_own[:, None] | b_own[None, :]) & (a[:, None] != b[None, :])
        edges = forest(linked)
    return pa.table({"u": pa.array([a[i] for i, _ in edges], pa.int64()), "v": pa.array([b[j] for _, j in edges], pa.int64())})


def outside_links(documents: DataFrame, classes: DataFrame, crowded: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links of the sets that share a crowded signature, but not the component of its smallest set."""
    found = scratch.save(cc.components(links, scratch))
    root = found.select(F.col("node").alias("key"), "root")
    of_pivot = found.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    members = scratch.save(
        crowded.join(shuffled(root), "key", "left").join(shuffled(of_pivot), "pivot", "left")
        .select("sig", "key", "pivot", (F.coalesce("root", "key") != F.coalesce("pivot_root", "pivot")).alias("outside"))
    )
    inside = members.join(shuffled(members.where("outside").select("sig").distinct()), "sig", "left_semi")
    edges = scratch.save(inside.select(F.col("key").alias("u"), F.col("pivot").alias("v"), "outside").groupBy("u", "v").agg(F.max("outside").alias("outside")))
    scratch.drop(found, members)
    if edges.isEmpty():
        return None
    cluster = cc.components(edges.select("u", "v"), scratch).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    people = edges.groupBy(F.col("u").alias("key")).agg(F.max("outside").alias("outside")).join(shuffled(cluster), "key")
    people = scratch.save(people.join(shuffled(classes.select("key", "n_shingles")), "key"))
    sets = scratch.save(fetch_sets(documents, classes, people.select("key")))
    near = scratch.save(people.join(shuffled(in_company(people, sets, input_parts(documents))), "key", "left_semi"))
    met = set_blocks(near).join(shuffled(sets.groupBy("key").agg(F.first("features").alias("features"))), "key")
    more = scratch.save(
        met.groupBy("cluster", "band", "a_block", "b_block").applyInArrow(links_of_blocks, "u long, v long")
    )
    scratch.drop(sets, edges, people, near)
    return more


def linked_classes(documents: DataFrame, described: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (key, n_shingles, p0..p3, rep) and their components (node, root)."""
    spark = documents.sparkSession
    described_key = ["key", "n_shingles", "p0", "p1", "p2", "p3"]
    classes = scratch.save(described.where("n_shingles > 0").groupBy(*described_key).agg(F.min("doc_id").alias("rep")))
    shared = scratch.save(shared_signatures(dealt_signatures(documents, input_parts(documents))))
    release(spark)
    a, b = named(classes, "a"), named(classes, "b")
    candidates = shared.where("a != b").select("a", "b").distinct()
    first = scratch.save(candidates.join(shuffled(a), "a").join(shuffled(b), "b").where(may_link("a", "b")).select("a", "b"))
    crowded = scratch.save(shared.where("many").select("sig", F.col("b").alias("key"), F.col("a").alias("pivot")))
    scratch.drop(shared)
    links = check(documents, classes, first, scratch)
    scratch.drop(first)
    release(spark)
    more = None if crowded.isEmpty() else outside_links(documents, classes, crowded, links, scratch)
    scratch.drop(crowded)
    found = scratch.save(cc.components(links if more is None else links.unionByName(more), scratch))
    scratch.drop(links, *([] if more is None else [more]))
    return classes, found


def check(documents: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = scratch.save(fetch_sets(documents, classes, keys))
    links = scratch.save(verify(pairs, sets))
    scratch.drop(sets)
    return links


def near_duplicates(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_crc): one row per document."""
    small_batches(documents.sparkSession)
    scratch = scratch or Scratch(documents.sparkSession)
    described = scratch.save(describe(documents))
    classes, roots = linked_classes(documents, described, scratch)
    group = classes.join(shuffled(roots), classes.key == roots.node, "left").select(
        "key", "n_shingles", "p0", "rep", F.coalesce("root", "key").alias("root")
    )
    least = group.groupBy("root").agg(F.min("rep").alias("component_id"))
    named_class = scratch.save(group.join(shuffled(least), "root").select("key", "n_shingles", "p0", "component_id"))
    return described.join(shuffled(named_class), ["key", "n_shingles", "p0"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_crc"
    )


def keep_one(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``documents`` without near copies: the smallest doc_id of each component stays."""
    found = near_duplicates(documents, scratch)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("_stay_id"), F.col("text_crc").alias("_stay_crc"))
    row_id = F.col("doc_id").cast("long").alias("_row_id")
    rows = documents.select(boxed(documents), row_id, text_crc().alias("_row_crc"), F.xxhash64("text").alias("_row_text"))
    match = F.col("_row_id").eqNullSafe(F.col("_stay_id")) & (F.col("_row_crc") == F.col("_stay_crc"))
    again = Window.partitionBy("_row_id", "_row_crc").orderBy("_row_text")  # identical rows
    kept = rows.join(shuffled(stay), match, "left_semi").withColumn("_again", F.row_number().over(again))
    return kept.where("_again = 1").select(*unboxed(documents.columns))
