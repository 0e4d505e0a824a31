"""Mission assembly for every (learner, subject) at once.

A question is picked by score (distance to the wanted difficulty, penalties) with ties
broken at random. Scoring every (learner, question) pair would be a cross product, so the
bank is indexed instead: the questions of each bucket (skill x difficulty, skill x tag x
difficulty, subject x difficulty, subject) get a dense position in a seeded order, and a
learner probes a bucket from a seeded start position. At most ``MISSION_SIZE`` questions of
a mission can already be used, so the first ``MISSION_SIZE`` non-recent positions of the
best score classes, plus the learner's recent questions, always hold the exact pick.
Probes are an equi join on (bucket, position), which no bucket size can skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from learnloom import constants as K
from learnloom.functions.scalars import clamp
from learnloom.operators.sequence import number_rows
from learnloom.session import materialise

GROUP = ["learner_id", "subject"]
BUCKET = ["kind", "subject", "skill_id", "tag", "difficulty"]


def seeded(*parts) -> Column:
    """Hash text of the seed and the given values; an order that repeats for a seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def seeded_shuffle(bank: DataFrame, seed: int) -> DataFrame:
    return bank.withColumn("shuffle_key", seeded(seed, F.col("question_id")))


def _seeded_start(n: Column, *parts) -> Column:
    return F.pmod(F.conv(F.substring(seeded(*parts), 1, 15), 16, 10).cast("bigint"), n)


def weakness_rank(dense: DataFrame) -> DataFrame:
    """Rank of every skill: mastery, then seen count, then bank order. Catalogue-sized groups."""
    order = Window.partitionBy(*GROUP).orderBy("mastery", "seen_count", "skill_ordinal")
    return dense.withColumn("weak_rank", F.row_number().over(order))


def due_rank(dense: DataFrame, now_ms: int) -> DataFrame:
    """Both ranks: ``due_rank`` counts the due skills in the same order, null if not due."""
    due = F.col("next_review_at") <= now_ms
    order = Window.partitionBy(*GROUP).orderBy("mastery", "seen_count", "skill_ordinal")
    so_far = F.count_if(due).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return weakness_rank(dense).withColumn("due_rank", F.when(due, so_far.cast("int")))


def misconception_rank(due: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Due misconceptions by priority desc, due time, bank order, first seen."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc("priority"), "due_at", "skill_ordinal", "ordinal")
    return due.join(catalogue.select("subject", "skill_id", "skill_ordinal"), ["subject", "skill_id"]).withColumn(
        "tag_rank", F.row_number().over(order)
    )


def in_band_or_all(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Keep difficulties within ``width`` of the target; if a key has none, keep all."""
    inside = F.abs(F.col("difficulty") - F.col("target_difficulty")) <= width
    any_inside = F.max(F.col("_inside")).over(Window.partitionBy(*keys))
    return (
        rows.withColumn("_inside", inside)
        .withColumn("_any", any_inside)
        .where(F.col("_inside") == F.col("_any"))
        .drop("_inside", "_any")
    )


def bank_index(bank: DataFrame, seed: int) -> DataFrame:
    """(bucket, idx, n, question_id) for the four kinds of bucket."""
    q = bank.select("question_id", "subject", "skill_id", "difficulty", "wrong_choice_tags")
    none = F.lit("")
    tags = F.coalesce(
        F.array_distinct(F.array_compact("wrong_choice_tags")), F.array().cast("array<string>")
    )
    entry = lambda kind, skill, tag, difficulty: F.struct(
        F.lit(kind).alias("kind"), skill.alias("skill_id"), tag.alias("tag"), difficulty.alias("difficulty")
    )
    d = F.col("difficulty")
    entries = F.concat(
        F.array(
            entry("skill", F.col("skill_id"), none, d),
            entry("challenge", none, none, d),
            entry("fill", none, none, F.lit(0)),
        ),
        F.transform(tags, lambda t: entry("tag", F.col("skill_id"), t, d)),
    )
    rows = q.select("question_id", "subject", F.inline(entries)).withColumn("_order", seeded(seed, F.col("question_id")))
    numbered = number_rows(rows, BUCKET, ["_order", "question_id"], "idx")
    return materialise(numbered.withColumnRenamed("n_rows", "n").drop("_order"))


def _requests(targets, dense, due, catalogue, stats, now_ms) -> DataFrame:
    """One row per (learner, subject) and score class that a slot may draw from.

    Skills beyond the first few ranks are never served: a skill of the catalogue has a question,
    so it is passed over only when its questions are used already. With u questions used, at
    most u skills are passed over and 5 - u places are left for weak skills, so these have a rank
    of at most MISSION_SIZE; review has REVIEW_SLOTS places after at most MISCONCEPTION_SLOTS used.
    """
    distance = F.abs(F.col("difficulty") - F.col("target_difficulty"))
    none = F.lit(None).cast("int")
    columns = [*GROUP, "kind", "skill_id", "tag", "difficulty", "n", "score", "weak_rank", "due_rank", "tag_rank"]

    by_kind = {k: stats.where(F.col("kind") == k) for k in ("skill", "tag", "challenge", "fill")}
    reach = (F.col("weak_rank") <= K.MISSION_SIZE) | (F.col("due_rank") <= K.REVIEW_SLOTS + K.MISCONCEPTION_SLOTS)
    skill = due_rank(dense, now_ms).where(reach).join(targets, GROUP).join(by_kind["skill"], ["subject", "skill_id"])
    skill = in_band_or_all(skill, [*GROUP, "skill_id"], K.SKILL_BAND).withColumns({"score": distance, "tag_rank": none})

    tag = misconception_rank(due, catalogue).join(targets, GROUP).join(by_kind["tag"], ["subject", "skill_id", "tag"])
    tag = in_band_or_all(tag, [*GROUP, "skill_id", "tag"], K.MISCONCEPTION_BAND).withColumns(
        {"score": distance, "weak_rank": none, "due_rank": none}
    )

    wanted = clamp(F.col("target_difficulty") + 1, K.MIN_DIFFICULTY, K.MAX_DIFFICULTY)
    penalty = F.when(F.col("difficulty") < wanted, K.CHALLENGE_PENALTY).otherwise(0)
    no_ranks = {"weak_rank": none, "due_rank": none, "tag_rank": none}
    challenge = targets.join(by_kind["challenge"], "subject").withColumns(
        {"score": F.abs(F.col("difficulty") - wanted) + penalty, **no_ranks}
    )
    fill = targets.join(by_kind["fill"], "subject").withColumns({"score": F.lit(0), **no_ranks})
    out = skill.select(columns)
    for part in (tag, challenge, fill):
        out = out.unionByName(part.select(columns))
    return out


def candidates(targets, dense, due, recents, bank, catalogue, now_ms: int, seed: int) -> DataFrame:
    """Bounded candidate rows per (learner, subject) that contain every possible pick."""
    index = bank_index(bank, seed)
    stats = materialise(index.where(F.col("idx") == 0).select(*BUCKET, "n"))  # its real size decides the joins
    asks = _requests(targets, dense, due, catalogue, stats, now_ms)
    start = _seeded_start(
        F.col("n"), seed, F.col("learner_id"), F.col("kind"), F.col("subject"), F.col("skill_id"), F.col("tag"),
        F.col("difficulty"),
    )
    asks = materialise(asks.withColumn("start", start))

    recent = recents.select(*GROUP, "question_id")
    recent_at = recent.join(index.where(F.col("kind") != "fill").drop("n"), ["subject", "question_id"])
    keys = ["learner_id", *BUCKET]
    recent_n = recent_at.groupBy(*keys).agg(F.count("*").alias("_recent"))

    slot = [*GROUP, "kind", "skill_id", "tag"]
    lower_scores = Window.partitionBy(*slot).orderBy("score").rangeBetween(Window.unboundedPreceding, -1)
    need = F.when(F.col("kind") == "fill", 2 * K.MISSION_SIZE - 1).otherwise(K.MISSION_SIZE)
    probes = (
        asks.join(recent_n, keys, "left")
        .withColumn("_recent", F.coalesce("_recent", F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum(F.col("n") - F.col("_recent")).over(lower_scores), F.lit(0)))
        .where(F.col("_before") < K.MISSION_SIZE)
        .withColumn("probe", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), need + F.col("_recent")).cast("int") - 1)))
        .withColumn("idx", (F.col("start") + F.col("probe")) % F.col("n"))
        .drop("n", "_recent", "_before", "start")
    )
    fields = [*GROUP, "kind", "question_id", "skill_id", "tag", "difficulty", "score", "probe", "weak_rank", "due_rank", "tag_rank"]
    found = probes.join(index.drop("n"), [*BUCKET, "idx"])
    # One row of recent questions per group, so that found rows meet it where they are assembled.
    seen = recent.groupBy(*GROUP).agg(F.collect_set("question_id").alias("_recent"))
    is_recent = F.coalesce(F.array_contains("_recent", F.col("question_id")), F.lit(False))
    fresh = found.join(seen, GROUP, "left").where((F.col("kind") == "fill") | ~is_recent).select(fields)
    repeated = (
        asks.join(recent_at, keys)
        .withColumn("probe", F.pmod(F.col("idx") - F.col("start"), F.col("n")).cast("int"))
        .withColumn("score", F.col("score") + K.RECENT_PENALTY)
        .select(fields)
    )
    return fresh.unionByName(repeated)


def _best(rows: Column) -> Column:
    return F.get(F.array_sort(rows), F.lit(0))


def _per_rank(ordered: str, n: Column) -> Column:
    """Best row of each rank of a sorted array column, the first ``n`` ranks. The array is a
    column of its own, so the lambda reads it instead of sorting again."""
    best = F.filter(ordered, lambda r, i: (i == 0) | (F.get(F.col(ordered), i - 1).rank != r.rank))
    return F.when(n > 0, F.slice(best, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.slice(best, 1, 0))


def assemble(found: DataFrame, targets: DataFrame, due_counts: DataFrame, seed: int) -> DataFrame:
    """Slot picks per (learner, subject) as arrays of question ids plus the plan.

    The candidates of one mission become one row; the picks are column expressions on it,
    so the dependent steps (each must skip what earlier ones used) need no further shuffle.
    The hash that breaks ties between skills follows from the row, so it is made after the shuffle.
    """

    def rows(kind: str, rank: str) -> Column:
        item = F.struct(F.col(rank).alias("rank"), "score", "skill_id", "difficulty", "probe", "question_id", "tag")
        wanted = F.col("kind") == kind
        if rank == "due_rank":
            wanted = wanted & F.col("due_rank").isNotNull()
        return F.collect_list(F.when(wanted, item))

    unused = lambda arr: F.filter(arr, lambda r: ~F.array_contains("used", r.question_id))
    ids = lambda arr: F.transform(arr, lambda r: r.question_id)
    size = F.lit(K.MISSION_SIZE)

    group = found.groupBy(*GROUP).agg(
        rows("tag", "tag_rank").alias("m"),
        rows("skill", "due_rank").alias("r"),
        rows("skill", "weak_rank").alias("c"),
        rows("challenge", "weak_rank").alias("h"),
        rows("fill", "weak_rank").alias("f"),
        F.max(F.when(F.col("kind") == "challenge", F.col("difficulty"))).alias("_seen_difficulty"),
    )
    tie = lambda r: seeded(seed, F.col("learner_id"), r.skill_id, r.difficulty)
    ranked = lambda r: F.struct(
        r["rank"].alias("rank"), r.score.alias("score"), tie(r).alias("class_tie"), r.probe.alias("probe"),
        r.question_id.alias("question_id"), r.tag.alias("tag"),
    )
    group = group.withColumns({name: F.transform(name, ranked) for name in ("m", "r", "c", "h", "f")})
    out = targets.join(due_counts, GROUP, "left").join(group, GROUP)
    none = F.array().cast("array<string>")

    # Misconception slots: best candidate first, then one with another tag, else any other.
    out = out.withColumn("_m1", _best("m"))
    rest = F.filter("m", lambda r: r.question_id != F.col("_m1.question_id"))
    other = F.filter(rest, lambda r: r.tag != F.col("_m1.tag"))
    out = out.withColumn("_m2", F.when(F.col("due_misconceptions") >= K.MISCONCEPTION_SLOTS, F.coalesce(_best(other), _best(rest))))
    out = out.withColumn(
        "misconception_ids", F.coalesce(F.array_compact(F.array("_m1.question_id", "_m2.question_id")), none)
    ).withColumn("used", F.col("misconception_ids"))

    # Review slots: due skills in rank order.
    n_review = F.least(F.lit(K.REVIEW_SLOTS), size - F.size("used"))
    out = out.withColumn("r", F.array_sort(unused(F.col("r"))))
    out = out.withColumn("review_ids", ids(_per_rank("r", n_review)))
    out = out.withColumn("used", F.concat("used", "review_ids"))

    # Core slots: weakest skills, one place kept for a challenge if the subject has one.
    room = size - F.size("used")
    out = out.withColumn("_challenge_n", F.when(F.col("has_challenge") & (room > 0), 1).otherwise(0))
    out = out.withColumn("c", F.array_sort(unused(F.col("c"))))
    out = out.withColumn("core_ids", ids(_per_rank("c", room - F.col("_challenge_n"))))
    out = out.withColumn("used", F.concat("used", "core_ids"))

    out = out.withColumn(
        "challenge_ids",
        F.when(F.col("_challenge_n") == 1, F.array_compact(F.array(_best(unused(F.col("h"))).question_id))).otherwise(none),
    )
    out = out.withColumn("used", F.concat("used", "challenge_ids"))

    fillers = ids(F.array_sort(unused(F.col("f"))))
    missing = size - F.size("used")
    out = out.withColumn(
        "fill_ids", F.when(missing > 0, F.slice(fillers, F.lit(1), F.greatest(missing, F.lit(1)))).otherwise(none)
    )
    review = F.size("misconception_ids") + F.size("review_ids")
    mode = (
        F.when(review >= 2, "review")
        .when((F.size("challenge_ids") == 1) & (F.col("target_difficulty") >= 2), "challenge")
        .otherwise("learn")
    )
    return out.select(
        *GROUP,
        "target_difficulty",
        "misconception_ids",
        "review_ids",
        "core_ids",
        "challenge_ids",
        "fill_ids",
        mode.alias("mode"),
        F.size("misconception_ids").alias("misconception_count"),
        review.alias("review_count"),
        (F.size("core_ids") + F.size("fill_ids")).alias("core_count"),
        F.size("challenge_ids").alias("challenge_count"),
    )


def challenge_available(targets: DataFrame, bank: DataFrame) -> DataFrame:
    """Does the subject have a question at least one step above the target?"""
    hardest = bank.groupBy("subject").agg(F.max("difficulty").alias("_hardest"))
    wanted = clamp(F.col("target_difficulty") + 1, K.MIN_DIFFICULTY, K.MAX_DIFFICULTY)
    return targets.join(hardest, "subject").withColumn("has_challenge", F.col("_hardest") >= wanted).drop("_hardest")


def plan_missions(targets, dense, due, recents, bank, catalogue, now_ms: int, seed: int = 0) -> DataFrame:
    found = candidates(targets, dense, due, recents, bank, catalogue, now_ms, seed)
    counts = due.groupBy(*GROUP).agg(F.count("*").alias("due_misconceptions"))
    return assemble(found, challenge_available(targets, bank), counts, seed)


def build_missions(plans: DataFrame) -> DataFrame:
    """One row per served question: slot kind and order."""
    kinds = ["misconception", "review", "core", "challenge", "fill"]

    def named(kind):
        return F.transform(f"{kind}_ids", lambda q: F.struct(F.lit(kind).alias("slot"), q.alias("question_id")))

    slots = F.concat(*[named(kind) for kind in kinds])
    return plans.select(*GROUP, F.posexplode(slots).alias("slot_no", "_s")).select(*GROUP, "slot_no", "_s.*")
