"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies (target words divided
by the words of the source). The whole part is taken at once; the fraction is rounded by the
pivotal method: two documents meet and move mass (copies x words) from one to the other at
random until one of them is a whole copy or none. The words of the source stay constant in
every step and the expectation of each document is its fraction, so a source misses its
target by less than one document; large documents meet first, so that one is mostly small.

The meetings form a reduction tree. Documents fall into small groups by hash, each group is
folded by the SQL function ``aggregate`` and leaves at most one undecided document, and these
residuals are grouped again until one is left per source. No task sees more than ``GROUP``
documents at once and a level moves only the residuals of the one below. Only DataFrame
functions run; random numbers are hashes of the two document ids, so reruns agree.

Edge cases: a null or blank text has size 0 and takes 0 words. A null source is a source of
its own, last in order. Rows equal in doc_id, source and text are taken equally often. With no
words at all every target is 0. ``apply_mix`` keeps all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from learnloom.llm.common import boxed, n_words, unboxed
from learnloom.operators.sequence import number_rows
from learnloom.session import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # words of the mix as a multiple of all words
MOST = 2.0  # a source gives at most this multiple of its words
GROUP = 64
SEED = 11


def source_targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target): shares by weight, none above MOST x its size.

    Sources at their limit are fixed and the rest is shared again by weight; each round is
    one aggregate over the sources and caps at least one more of them.
    """
    by_source = scratch.save(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    )
    numbered = number_rows(by_source.withColumn("_all", F.lit(0)), ["_all"], ["_last", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    shares = scratch.save(
        numbered.select("source", "source_size", weight.alias("_weight"), (MOST * F.col("source_size")).alias("_limit"))
    )
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    if total:
        ratio = F.col("_limit") / F.col("_weight")
        while True:  # unit: words per unit of weight among the sources below their limit
            full = F.coalesce(ratio <= unit, F.lit(False))
            fixed, weights = shares.agg(
                F.sum(F.when(full, F.col("_limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))
            ).first()
            following = (SHARE * total - fixed) / weights if weights else unit
            if following <= unit:
                break
            unit = following
    target = F.least(F.col("_limit"), F.lit(float(unit)) * F.col("_weight"))
    return shares.select("source", "source_size", target.alias("target"))


def uniform(*columns: Column) -> Column:
    """Hash of the columns as a number in (0, 1)."""
    top = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11).cast("double")
    return (top + 0.5) / F.lit(float(1 << 53))


ITEM = "struct<size:bigint,key:bigint,doc_id:bigint,n:bigint,p:double>"
DONE = "struct<size:bigint,key:bigint,doc_id:bigint,n:bigint,extra:boolean>"
FIELDS = ("size", "key", "doc_id", "n")


def decision(item: Column, extra: Column) -> Column:
    return F.struct(*[item[f].alias(f) for f in FIELDS], extra.alias("extra"))


def with_fraction(item: Column, p: Column) -> Column:
    return F.struct(*[item[f].alias(f) for f in FIELDS], p.alias("p"))


def meet(held: Column, item: Column) -> Column:
    """One pivotal step of an undecided and the next document: struct(left, decided)."""
    a, b = (held["size"] * held["n"]).cast("double"), (item["size"] * item["n"]).cast("double")
    p, q = held["p"], item["p"]
    up = F.least(1.0 - p, q * b / a)  # held may rise by this much
    down = F.least(p, (1.0 - q) * b / a)  # or fall by this much
    rises = uniform(held["key"], held["doc_id"], item["key"], item["doc_id"]) * (up + down) < down
    held_done = F.when(rises, 1.0 - p <= q * b / a).otherwise(p <= (1.0 - q) * b / a)
    new_p = F.when(rises, p + up).otherwise(p - down)
    new_q = F.when(rises, q - up * a / b).otherwise(q + down * a / b)
    left = F.when(held_done, with_fraction(item, new_q)).otherwise(with_fraction(held, new_p))
    decided = F.when(held_done, decision(held, rises)).otherwise(decision(item, ~rises))
    return F.struct(left.alias("left"), decided.alias("decided"))


def fold_group(items: Column) -> Column:
    """Fold sorted documents: struct(left: the undecided one or null, done: decided ones)."""
    start = F.struct(F.lit(None).cast(ITEM).alias("left"), F.array().cast(f"array<{DONE}>").alias("done"))
    edge = 1e-12  # a fraction this close to a whole number is decided

    def step(state: Column, item: Column) -> Column:
        def state_of(left, decided):
            return F.struct(left.alias("left"), F.concat(state["done"], F.array(decided)).alias("done"))

        # transform over one element binds the outcome, so the meeting is computed once
        met = F.transform(F.array(meet(state["left"], item)), lambda m: state_of(m["left"], m["decided"]))
        settled = (item["p"] <= edge) | (item["p"] >= 1 - edge)
        return (
            F.when(settled, state_of(state["left"], decision(item, item["p"] >= 0.5)))
            .when(state["left"].isNull(), F.struct(item.alias("left"), state["done"].alias("done")))
            .otherwise(F.get(met, F.lit(0)))
        )

    return F.aggregate(items, start, step)


def decide(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc_id, source, size, n, source_size, target, copies) for every distinct row.

    Rows equal in doc_id, source and text are one unit of ``n`` rows with the same copies.
    """
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), row_key().alias("key"))
    units = scratch.save(sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n")))
    targets = scratch.save(source_targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), scratch))
    counts = units.where("size > 0").groupBy("source").agg(F.count("*").alias("_units"))
    shared = scratch.save(targets.join(counts, targets.source.eqNullSafe(counts.source), "left").drop(counts.source))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(MOST))).otherwise(0.0)
    rows = units.join(
        shared.withColumn("_rate", rate).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    whole = F.floor("_rate").cast("int")
    by_source = ["source", "source_size", "target", "_units", "_whole"]
    rows = rows.withColumn("_whole", whole).withColumn("_p", F.col("_rate") - whole)
    empty = rows.where("size = 0").select(*FIELDS, "source", "source_size", "target", F.col("_whole").alias("copies"))
    item = F.struct(*FIELDS, F.col("_p").alias("p"))
    level = rows.where("size > 0").select(*by_source, item.alias("item"))
    most = shared.agg(F.max("_units")).first()[0] or 0
    decided, depth = [empty], 0
    while True:
        span = float(GROUP ** (depth + 1))
        group = F.pmod(F.xxhash64("item.key", "item.doc_id", F.lit(depth)), F.ceil(F.col("_units") / span))
        folded = scratch.save(
            level.groupBy(*by_source, group.alias("_group"))
            .agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
            .select(*by_source, fold_group(F.col("items")).alias("fold"))
        )
        done = folded.select(*by_source, F.explode("fold.done").alias("d"))
        decided.append(outcome(done, F.col("d"), F.col("d.extra")))
        level = folded.where("fold.left is not null").select(*by_source, F.col("fold.left").alias("item"))
        if most <= span:
            break
        depth += 1
    last = F.col("item")  # one per source: rounded by itself
    decided.append(outcome(level, last, uniform(last["key"], last["doc_id"]) < last["p"]))
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    return result


def outcome(rows: DataFrame, item: Column, extra: Column) -> DataFrame:
    copies = (F.col("_whole") + extra.cast("int")).alias("copies")
    return rows.select(*[item[f].alias(f) for f in FIELDS], "source", "source_size", "target", copies)


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "source", F.coalesce("text", F.lit("")), F.col("text").isNull())


def mix(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per document."""
    rows = decide(documents, scratch or Scratch(documents.sparkSession))
    return rows.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply_mix(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: every row of ``documents`` as often as it is taken."""
    taken = decide(documents, scratch or Scratch(documents.sparkSession)).where("copies > 0")
    taken = taken.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc_id"), F.col("copies").alias("_copies"))
    keyed = documents.select(boxed(documents), row_key().alias("_row_key"), F.col("doc_id").cast("long").alias("_row_id"))
    match = (F.col("_row_key") == F.col("_key")) & F.col("_row_id").eqNullSafe(F.col("_doc_id"))
    repeated = keyed.join(taken, match).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
    return repeated.select(*unboxed(documents.columns))
