"""Ordered per-key computations that do not depend on how many rows one key holds.

A learner may own a large share of all rows, so nothing here windows over a whole
learner. Rows get a dense ``seq`` per learner from a range-partitioned pass, and
``block = seq // block_rows`` bounds every later group. A window runs inside
(keys, block); what crosses a block border is carried by a per-block summary, and only
for learners that own more than one block (``n_blocks > 1``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from learnloom.session import Scratch, materialise

BLOCK_ROWS = 100_000


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Dense 0-based row number per key, plus ``n_rows`` per key.

    ``order`` must be unique within a key. Range partitions over (keys, order) split a hot
    key evenly; the partition id is stored with the rows so that later passes agree on it.
    """
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    per_range = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("n_rows"),
        )
    )
    return (
        ranged.withColumn("_rn", F.row_number().over(per_range))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop("_offset", "_rn", "_range")
    )


def with_blocks(df: DataFrame, seq: str = "seq", total: str = "n_rows", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block`` and ``n_blocks`` from a dense sequence number."""
    return df.withColumn("block", F.floor(F.col(seq) / block_rows)).withColumn(
        "n_blocks", F.floor((F.col(total) - 1) / block_rows) + 1
    )


def is_split(df: DataFrame) -> bool:
    """True when some key owns more than one block (one pruned look at ``n_blocks``)."""
    return not df.where(F.col("n_blocks") > 1).select("n_blocks").isEmpty()


_KINDS = {
    "sum": (F.sum, lambda carry, inside: F.coalesce(carry, F.lit(0)) + F.coalesce(inside, F.lit(0))),
    "max": (F.max, lambda carry, inside: F.greatest(carry, inside)),
    "min": (F.min, lambda carry, inside: F.least(carry, inside)),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    spec: dict[str, tuple[str, Column]],
    split: bool = True,
    upto: int = 0,
) -> DataFrame:
    """Running sum/max/min per key. ``upto=-1`` leaves the current row out.

    ``spec`` maps an output name to (kind, expression).
    """
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    out = df
    for name, (kind, expr) in spec.items():
        value = _KINDS[kind][0](expr).over(inside)
        out = out.withColumn(name, F.coalesce(value, F.lit(0)) if kind == "sum" else value)
    if not split:
        return out
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.where(F.col("n_blocks") > 1)
        .groupBy(*keys, "block")
        .agg(*[_KINDS[kind][0](expr).alias(f"_{name}") for name, (kind, expr) in spec.items()])
        .select(*keys, "block", *[_KINDS[k][0](f"_{n}").over(earlier).alias(f"_{n}") for n, (k, _) in spec.items()])
    )
    out = out.join(carry, [*keys, "block"], "left")
    for name, (kind, _) in spec.items():
        out = out.withColumn(name, _KINDS[kind][1](F.col(f"_{name}"), F.col(name)))
    return out.drop(*[f"_{name}" for name in spec])


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: dict[str, Column],
    forward: bool = True,
    split: bool = True,
    name: str = "next",
) -> DataFrame:
    """Struct of ``value`` from the next (or previous) row of the same key, null at the end."""
    item = F.struct(*[expr.alias(n) for n, expr in value.items()])
    inside = Window.partitionBy(*keys, "block").orderBy(order)
    step = F.lead if forward else F.lag
    out = df.withColumn(name, step(item).over(inside))
    if not split:
        return out
    edge = F.min_by(item, order) if forward else F.max_by(item, order)
    carry = (
        df.where(F.col("n_blocks") > 1)
        .groupBy(*keys, "block")
        .agg(edge.alias("_edge"))
        .select(
            *keys,
            "block",
            (F.lead if forward else F.lag)("_edge").over(Window.partitionBy(*keys).orderBy("block")).alias("_edge"),
        )
    )
    return (
        out.join(carry, [*keys, "block"], "left")
        .withColumn(name, F.coalesce(name, "_edge"))
        .drop("_edge")
    )


def top_rows(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The optimizer limits each key before the shuffle, so a hot
    key sends at most ``n`` rows per map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def with_halo(
    df: DataFrame, rows: int, block_rows: int, split: bool = True, seq: str = "seq", columns: list[str] | None = None
) -> DataFrame:
    """Copy the last ``rows`` rows of each block into the next ones, flagged ``is_halo``.

    ``columns`` (default: all): what a halo row is read for; its other columns are null and cost no
    shuffle. All copies come from one pass.
    """
    own = df.withColumn("is_halo", F.lit(False))
    if not split:
        return own
    needed = {*(columns or df.columns), "block", "n_blocks", seq}
    last = F.least(F.col("n_blocks") - 1, F.floor((F.col(seq) + rows) / block_rows)).cast("bigint")
    copies = (
        df.select([F.col(c) if c in needed else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        .where(F.col("block") < last)
        .withColumn("block", F.explode(F.sequence(F.col("block") + 1, last)))
        .withColumn("is_halo", F.lit(True))
    )
    return own.unionByName(copies)


STATE = "array<struct<part:string,value:{}>>"


def fold_blocks(
    rows: DataFrame, keys: list[str], run, kind: str = "string", initial: DataFrame | None = None
) -> DataFrame | None:
    """Start state of every (keys, block) for a fold that must run in order.

    A state is a set of named parts (say one per skill). ``run(rows, starts)`` folds each
    (keys, block) from its state in ``starts`` (None = all initial) and returns (keys, block,
    part, value) for the parts that the block touched. All blocks run at once; a part starts a
    block with the value of the last earlier block that touched it, so one that is no longer
    used reaches all later blocks at once. A block is repeated only while its start state
    changes. The result is exact: block k is final after at most k+1 rounds, and earlier where
    blocks forget the state they began with. Only states move between rounds.
    ``initial`` (keys, part, value) is a saved state to go on from.
    Joins are by sorted shuffles: the files of these tables are small for their rows, and a
    broadcast chosen by file size would build them in the driver's memory.
    Returns (keys, block, ``state``: array of part and value, sorted) of the learners that own
    several blocks (with ``initial``, of all), or None when there are none.
    """
    if initial is None and not is_split(rows):
        return None
    scratch = Scratch(rows.sparkSession)
    split_rows = rows if initial is not None else rows.where(F.col("n_blocks") > 1)
    block, kind = [*keys, "block"], STATE.format(kind)
    chain = scratch.save(split_rows.select(*block).distinct())
    starts = chain.withColumn("state", F.array().cast(kind))
    ends = scratch.save(run(split_rows, None))
    earlier = Window.partitionBy(*keys, "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        known, blocks = ends, chain
        if initial is not None:  # stands before the first block
            before = initial.select(*keys, F.lit(-1).cast("bigint").alias("block"), "part", "value")
            known = ends.unionByName(before)
            blocks = chain.unionByName(chain.select(*keys).distinct().withColumn("block", F.lit(-1).cast("bigint")))
        parts = known.select(*keys, "part").distinct().hint("merge")
        grid = blocks.join(parts, keys).join(known.hint("merge"), [*block, "part"], "left")
        filled = grid.withColumn("value", F.last("value", ignorenulls=True).over(earlier)).where("value is not null")
        incoming = filled.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("_in"))
        linked = scratch.save(
            starts.join(incoming.hint("merge"), block, "left").withColumn("_in", F.coalesce("_in", F.array().cast(kind)))
        )
        changed = linked.where(F.col("state") != F.col("_in"))
        following = linked.select(*block, F.col("_in").alias("state"))
        if changed.isEmpty():
            return following
        changed = changed.select(*block, F.col("_in").alias("state"))
        which = changed.drop("state").hint("merge")
        fresh = run(split_rows.join(which, block, "left_semi"), changed)
        replaced = scratch.save(ends.join(which, block, "left_anti").unionByName(fresh))
        scratch.drop(ends, starts)
        starts, ends = following, replaced
