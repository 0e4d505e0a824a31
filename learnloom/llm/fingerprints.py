"""Document fingerprints: threshold-scaled sketches of word shingles.

The sketch of a text holds every hash of a five-word shingle below a fixed fraction of the hash
range, so its size follows the text. Sketches of different texts therefore keep the same part of
the shingles: their union is the sketch of the joined texts, and the share of one sketch that is
in the other estimates containment even when one text is far longer. A text whose hashes all
lie above the threshold keeps its smallest one, so only texts without words have an empty
sketch; merging keeps that rule. Such a hash says nothing of containment, since the sketch of a
longer text cannot hold it: containment is null there, unless the sketches are equal.

A hash is the first 15 hexadecimal digits of the shingle's MD5, kept as an integer. All steps
are SQL functions; a document meets its successor by two joins on the document id, and texts are
shuffled once.

Edge cases: a null text is empty. Texts of fewer than five words are one shingle. Two empty
sketches are alike (1), an empty and another one are not (0). Where rows share a doc_id, the
next document is the next greater id and its smallest text stands for it; a null doc_id has no
next document (its edited text just ends earlier). Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from learnloom.llm.common import WORD, words
from learnloom.operators.sequence import number_rows
from learnloom.session import Scratch

WORDS = 5
BELOW = "4"  # hashes whose hexadecimal digits sort before this: a quarter of all
DIGITS = 15
BOUND = int(BELOW, 16) * 16 ** (DIGITS - 1)


def hashed(shingle: Column) -> Column:
    return F.substring(F.md5(shingle.cast("binary")), 1, DIGITS)


def shingle_hashes(split: Column, first: Column | int = 1) -> Column:
    """Hashes of the shingles of a list of words, from number ``first`` on."""
    first = F.lit(first) if isinstance(first, int) else first
    last = F.size(split) - (WORDS - 1)
    several = F.transform(F.sequence(first, last), lambda i: hashed(F.concat_ws(" ", F.slice(split, i, WORDS))))
    none = F.array().cast("array<string>")
    return (
        F.when((F.size(split) >= WORDS) & (first <= last), several)
        .when((F.size(split) > 0) & (F.size(split) < WORDS), F.array(hashed(F.concat_ws(" ", split))))
        .otherwise(none)
    )


def with_hashes(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the words and the shingle hashes of ``text``."""
    df = df.withColumn(f"_{name}_words", words(F.col(text)))
    return df.withColumn(f"_{name}_hashes", shingle_hashes(F.col(f"_{name}_words")))


def below(df: DataFrame, name: str) -> DataFrame:
    """Replace the hashes by the sketch: a sorted array of integers."""
    hashes, low = f"_{name}_hashes", f"_{name}_low"
    return (
        df.withColumn(low, F.filter(hashes, lambda h: h < BELOW))
        .withColumn(low, F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.col(low)))
        .withColumn(name, F.array_sort(F.array_distinct(F.transform(low, lambda h: F.conv(h, 16, 10).cast("long")))))
        .drop(low)
    )


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sketch of ``text``."""
    return below(with_hashes(df, text, name), name).drop(f"_{name}_words", f"_{name}_hashes")


def with_edited_hashes(df: DataFrame, edited: str, kept: Column, name: str, origin: str) -> DataFrame:
    """Hashes of an edited text that begins with ``kept`` characters of the original.

    All words of the part that stays, but its last one (the edit may continue it), are those of
    the original, and so are the hashes of shingles of such words.
    """
    same = F.greatest(F.regexp_count(F.expr(f"substring({edited}, 1, _kept)"), F.lit(WORD)) - WORDS, F.lit(0))
    split = f"_{name}_words"
    df = df.withColumn("_kept", kept.cast("int")).withColumn("_same", same).withColumn(split, words(F.col(edited)))
    rest = shingle_hashes(F.col(split), F.col("_same") + 1)
    hashes = F.concat(F.slice(f"_{origin}_hashes", F.lit(1), F.col("_same")), rest)
    return df.withColumn(f"_{name}_hashes", hashes)


def merge(a: Column, b: Column) -> Column:
    """Sketch of the two texts together. A smallest hash kept above the threshold goes as soon
    as one below it is there."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < BOUND)
    return F.when((F.size(low) == 0) & (F.size(both) > 0), F.slice(both, 1, 1)).otherwise(low)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text that is in the second; null where no hash of the first is below the threshold."""
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return F.when((F.size(a) == 0) | (a == b), F.lit(1.0)).when(F.get(a, F.lit(0)) < BOUND, share)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), " ")


def successors(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, next_id): the next greater doc_id, after the last one the first."""
    ids = documents.where("doc_id is not null").select("doc_id").distinct().withColumn("_all", F.lit(0))
    numbered = scratch.save(number_rows(ids, ["_all"], ["doc_id"], "_at").select("doc_id", "_at", "n_rows"))
    after = numbered.select(F.col("doc_id").alias("next_id"), F.col("_at").alias("_next"))
    return numbered.withColumn("_next", (F.col("_at") + 1) % F.col("n_rows")).join(after, "_next").select("doc_id", "next_id")


def fingerprints(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_chars, the fingerprints of a text and its edited text, and their likeness.

    The edited text has the last quarter of its characters replaced by the beginning of the
    next document.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    asked = texts.groupBy("doc_id").agg(F.max(quarter).alias("_most")).join(successors(documents, scratch), "doc_id")
    asked = scratch.save(asked).select(F.col("doc_id").alias("_asker"), F.col("next_id").alias("doc_id"), "_most")
    given = with_sketch(texts.join(asked, "doc_id"), "text", "_next_sketch")
    given = given.groupBy(F.col("_asker").alias("doc_id")).agg(
        F.min(F.struct(F.expr("substring(text, 1, _most)").alias("head"), F.col("_next_sketch").alias("sketch"))).alias("_next")
    )
    # Every id has a successor; with the same filter as above, Spark shuffles the texts once.
    rows = texts.where("doc_id is not null").join(given, "doc_id")
    alone = texts.where("doc_id is null").withColumn("_next", F.lit(None).cast(given.schema["_next"].dataType))
    rows = rows.unionByName(alone).withColumn("_cut", quarter)
    rows = rows.withColumn(
        "_edited", F.expr("concat(substring(text, 1, length(text) - _cut), substring(coalesce(_next.head, ''), 1, _cut))")
    )
    rows = with_hashes(rows, "text", "_sketch")
    rows = with_edited_hashes(rows, "_edited", F.length("text") - F.col("_cut"), "_edited_sketch", "_sketch")
    rows = below(below(rows, "_sketch"), "_edited_sketch")
    own, edited, following = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next.sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        F.coalesce(likeness(own, following), F.lit(0.0)).alias("near_next"),
        containment(own, edited).alias("contained_edited"),
    )


def _sketch_sql(words_column: str) -> str:
    hashed = "substr(md5(array_to_string({}, ' ')), 1, %d)" % DIGITS
    return f"""CASE WHEN len({words_column}) >= {WORDS}
        THEN list_transform(range(1, len({words_column}) - {WORDS - 2}), lambda i: {hashed.format(f"{words_column}[i:i + {WORDS - 1}]")})
        WHEN len({words_column}) > 0 THEN [{hashed.format(words_column)}] ELSE [] END"""


def _low_sql(hashes: str) -> str:
    low = f"list_filter({hashes}, lambda h: h < '{BELOW}')"
    return f"list_sort(list_distinct(CASE WHEN len({low}) = 0 AND len({hashes}) > 0 THEN [list_min({hashes})] ELSE {low} END))"


def _likeness_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {common})"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE {common}::DOUBLE / {union} END"


WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d),
e AS (SELECT *, substring(t, 1, n - n // 4) || substring(x, 1, n // 4) AS et FROM o),
w AS (SELECT *, {WORDS_SQL.format('t')} AS w1, {WORDS_SQL.format('et')} AS w2, {WORDS_SQL.format('x')} AS w3 FROM e),
h AS (SELECT doc_id, n, et, {_sketch_sql('w1')} AS h1, {_sketch_sql('w2')} AS h2, {_sketch_sql('w3')} AS h3 FROM w),
s AS (SELECT doc_id, n, et, {_low_sql('h1')} AS s1, {_low_sql('h2')} AS s2, {_low_sql('h3')} AS s3 FROM h)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, array_to_string(s1, ' ') AS fingerprint,
  array_to_string(s2, ' ') AS edited_fingerprint, {_likeness_sql('s1', 's2')} AS near_edited, {_likeness_sql('s1', 's3')} AS near_next,
  CASE WHEN len(s1) = 0 OR s1 = s2 THEN 1.0 WHEN s1[1] < '{BELOW}' THEN len(list_intersect(s1, s2))::DOUBLE / len(s1) END AS contained_edited
FROM s"""
