"""Cheapest repair of conversations by a run-length dynamic programme.

A legal conversation is an optional system turn and then user and assistant turns in pairs. Rows
may be kept (0), given another role (3) or deleted (4), and empty user or assistant rows inserted
(3); a row whose text breaks off costs 3 unless it goes, a blank or duplicate one has to go. What
has been written so far is one of four states, so a row is a 4 x 4 matrix over (min, +):

1. Spark reduces every row to a symbol (initial of the role, first fault); equal rows are counted.
   Whether a text was seen earlier comes from an aggregate and a join on all of its key.
2. Rows are numbered in order and cut into blocks, so a conversation of any length is many
   blocks. A block is a string of runs (equal consecutive symbols with their length). A run is a
   power of its symbol's matrix, from cached binary powers; the block is their product.
3. Only conversations of several blocks need carries: costs to go from the blocks behind (product
   of matrices) and, once these are known, the state each block starts in (composition of maps).
   Both are scans with a bounded fan-in.
4. The choices of a block are unrolled forwards: the ASCII-least letter that keeps the cost least.
   Inserts have one possible role in each state, so the letters fix the repaired rows.

Texts move once, into one stream per conversation in which the letters of a block come before its
rows; a SHA-256 needs all texts of a conversation in order, so that pass holds one row at a time
but cannot be divided.

Edge cases: nulls in role and text read as one space, null turns come first, a null conv_id is a
conversation of its own, more gaps than a long holds are its largest value. Rows of one turn are ordered by role, then by the text's MD5. No rows in,
no rows out. Very long texts are never gathered. Further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from learnloom.llm.common import small_batches
from learnloom.operators.sequence import number_rows
from learnloom.session import Scratch

BLOCK_ROWS = 10_000  # rows of a block
FAN_IN = 500  # blocks that one step of a scan combines
WHITE_CHARS = " \t\n\x0b\x0c\r"
KEYS = ["known", "conv"]  # a null conv_id is known = false
PLACE = ["has_turn", "at", "role", "digest"]  # order of the rows of a conversation
REPAIRED = "conv_id long, position long, edit string, role string, text string"

# States: nothing written yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
EITHER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the one role of an insert or new role
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 62
MOST = (1 << 63) - 1

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# ---- (min, +) algebra of symbols, runs and blocks -------------------------------------------


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(x + y[j] for x, y in zip(row, b))) for j in STATES) for row in a)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(NEVER, *(x + y for x, y in zip(row, v))) for row in a)


ONE: Matrix = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)


def _inserts() -> Matrix:
    """Least cost from state to state by inserts alone."""
    rows = []
    for state in STATES:
        cost, row, spent = [NEVER] * 4, state, 0
        while cost[row] > spent:
            cost[row], row, spent = spent, EITHER[row], spent + INSERT
        rows.append(tuple(cost))
    return tuple(rows)


INSERTS = _inserts()
DONE: Vector = apply(INSERTS, tuple(0 if s in (START, ASSISTANT) else NEVER for s in STATES))


def options(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row, in ASCII order of the letters."""
    role, fault = symbol
    found = [("D", DELETE, state)]
    if fault in "bd":
        return found
    extra = TRUNCATED if fault == "t" else 0
    if state in NEXT.get(role, {}):
        found.append(("K", extra, NEXT[role][state]))
    return [*found, ("R", REROLE + extra, EITHER[state])]


@functools.cache
def power(symbol: str, level: int) -> Matrix:
    """Matrix of 2**level rows with one symbol, inserts before each."""
    if level:
        half = power(symbol, level - 1)
        return times(half, half)
    row = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, after in options(symbol, state):
            row[state][after] = min(row[state][after], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def run_matrices(symbol: str, length: int) -> list[Matrix]:
    """Binary powers whose product is the run's matrix (they commute)."""
    return [power(symbol, level) for level in range(length.bit_length()) if length >> level & 1]


@functools.lru_cache(maxsize=4096)
def parse(text: str) -> tuple[tuple[str, int], ...]:
    """Runs of ``"uk1 ud2"``: equal consecutive symbols collapsed."""
    out: list[list] = []
    for item in text.split():
        symbol, length = item[:2], int(item[2:])
        if out and out[-1][0] == symbol:
            out[-1][1] += length
        else:
            out.append([symbol, length])
    return tuple(map(tuple, out))


@functools.lru_cache(maxsize=4096)
def summary(text: str) -> tuple:
    """(blank, duplicate, truncated, illegal, first, last, matrix) of a block."""
    runs = parse(text)
    faults = {f: sum(n for s, n in runs if s[1] == f) for f in "bdt"}
    within = sum(n - 1 for _, n in runs)  # two rows of one role are never legal
    between = sum(a[0][0] + b[0][0] not in LEGAL for a, b in zip(runs, runs[1:]))
    matrix = ONE
    for symbol, length in runs:
        for step in run_matrices(symbol, length):
            matrix = times(matrix, step)
    return faults["b"], faults["d"], faults["t"], within + between, runs[0][0][0], runs[-1][0][0], matrix


@functools.lru_cache(maxsize=4096)
def unroll(text: str, after: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """(letters, end state, cost to go at the start) of a block that starts in ``state`` when
    ``after`` is the cost to go behind it; the last block also writes what is missing at the end."""
    runs = parse(text)
    behind = [after]  # cost to go behind each run, from the last run to the first
    for symbol, length in reversed(runs):
        v = behind[-1]
        for step in run_matrices(symbol, length):
            v = apply(step, v)
        behind.append(v)
    cost = behind.pop()[state]
    letters = []
    for (symbol, length), v in zip(runs, reversed(behind)):
        if symbol[1] in "bd":  # nothing else is allowed, and D comes before any insert
            letters.append("D" * length)
            continue
        to_go = [v]
        for _ in range(length):
            to_go.append(apply(power(symbol, 0), to_go[-1]))
        for here, then in zip(to_go[:0:-1], to_go[-2::-1]):
            while True:
                choices = [(x, c + then[s], s) for x, c, s in options(symbol, state)]
                choices.append(("I", INSERT + here[EITHER[state]], EITHER[state]))
                letter, state = next((x, s) for x, c, s in sorted(choices) if c == here[state])
                letters.append(letter)
                if letter != "I":
                    break
    while last and DONE[state]:
        letters.append("I")
        state = EITHER[state]
    return "".join(letters), state, cost


# ---- Spark ------------------------------------------------------------------------------------


def _flat(matrix: Matrix) -> list[int]:
    return [x for row in matrix for x in row]


def _square(values) -> Matrix:
    v = [int(x) for x in values]
    return tuple(tuple(v[i : i + 4]) for i in range(0, 16, 4))


LONGS = T.ArrayType(T.LongType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@F.pandas_udf(
    _struct(
        blank=T.LongType(), duplicate=T.LongType(), truncated=T.LongType(), illegal=T.LongType(),
        first=T.StringType(), last=T.StringType(), matrix=LONGS,
    )
)
def _summary(runs: pd.Series) -> pd.DataFrame:
    rows = [(*s[:6], _flat(s[6])) for s in map(summary, runs)]
    return pd.DataFrame(rows, columns=["blank", "duplicate", "truncated", "illegal", "first", "last", "matrix"])


@F.pandas_udf(LONGS)
def _ends(runs: pd.Series, behind: pd.Series) -> pd.Series:
    """State after a block for each state before it."""
    return pd.Series([[unroll(r, apply(_square(m), DONE), s, False)[1] for s in STATES] for r, m in zip(runs, behind)], dtype=object)


@F.pandas_udf(_struct(letters=T.StringType(), start=T.LongType(), cost=T.LongType()))
def _letters(runs: pd.Series, behind: pd.Series, start: pd.Series, last: pd.Series) -> pd.DataFrame:
    rows = []
    for r, m, s, end in zip(runs, behind, start, last):
        letters, _, cost = unroll(r, apply(_square(m), DONE), int(s), bool(end))
        rows.append((letters, int(s), cost))
    return pd.DataFrame(rows, columns=["letters", "start", "cost"])


def _compose(first: list[int], then: list[int]) -> list[int]:
    return [then[s] for s in first]


def _product(first: list[int], then: list[int]) -> list[int]:
    return _flat(times(_square(first), _square(then)))


def scan(blocks: DataFrame, combine, unit: list[int], backwards: bool = False, fan_in: int = FAN_IN) -> DataFrame:
    """(known, conv, block, carry): values of all blocks before each one combined, or of all
    behind it. ``fan_in`` neighbours are combined at a time, level by level."""

    @F.pandas_udf(LONGS)
    def total(values: pd.Series) -> pd.Series:
        return pd.Series([functools.reduce(combine, ([int(x) for x in v] for v in group), unit) for group in values], dtype=object)

    @F.pandas_udf(T.ArrayType(LONGS))
    def carries(values: pd.Series, carry: pd.Series) -> pd.Series:
        out = []
        for group, acc in zip(values, carry):
            acc, found = [int(x) for x in acc], []
            for v in reversed(group) if backwards else group:
                found.append(acc)
                v = [int(x) for x in v]
                acc = combine(v, acc) if backwards else combine(acc, v)
            out.append(found[::-1] if backwards else found)
        return pd.Series(out, dtype=object)

    one = F.array(*[F.lit(x).cast("bigint") for x in unit])
    items = blocks.select(*KEYS, "block", "value", F.floor(F.col("block") / fan_in).alias("group"))
    groups = items.groupBy(*KEYS, "group").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("items"))
    if items.where(F.col("group") > 0).isEmpty():
        groups = groups.withColumn("carry", one)
    else:
        upper = groups.select(*KEYS, F.col("group").alias("block"), total("items.value").alias("value"))
        carried = scan(upper, combine, unit, backwards, fan_in).withColumnRenamed("block", "group")
        groups = groups.join(carried, [*KEYS, "group"])
    zipped = F.arrays_zip(F.col("items.block").alias("block"), carries("items.value", "carry").alias("carry"))
    return groups.select(*KEYS, F.inline(zipped))


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with their place in the order, role initial and first fault of the text itself."""
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    seen = F.rtrim(text, F.lit(WHITE_CHARS))
    initial = F.substring(role, 1, 1)
    return conversations.select(
        conv.isNotNull().alias("known"), F.coalesce(conv, F.lit(0)).alias("conv"),
        turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("at"),
        role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(seen == "", "b").when(F.right(seen, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t").alias("fault"),
        copies.cast("long").alias("copies"),
    )


def _runs(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with their count, and the same with the text of their symbols."""
    counted = scratch.save(
        rows.where("copies > 0").groupBy(*KEYS, *PLACE)
        .agg(F.sum("copies").alias("n"), F.first("initial").alias("initial"), F.first("fault").alias("fault"))
    )
    firsts = counted.groupBy(*KEYS, "role", "digest").agg(F.min(F.struct("has_turn", "at")).alias("first"))
    firsts = firsts.select(*KEYS, "role", "digest", "first.*", F.lit(True).alias("is_first"))
    symbol = lambda fault, n: F.concat("initial", fault, n.cast("string"))
    n, again = F.col("n"), F.lit("d")
    runs = (
        F.when(F.col("fault") == "b", symbol(F.col("fault"), n))
        .when(F.col("is_first").isNull(), symbol(again, n))
        .when(n > 1, F.concat_ws(" ", symbol(F.col("fault"), F.lit(1)), symbol(again, n - 1)))
        .otherwise(symbol(F.col("fault"), n))
    )
    return counted, counted.join(firsts, [*KEYS, *PLACE], "left").select(*KEYS, *PLACE, runs.alias("runs"))


def _blocks(symbols: DataFrame, scratch: Scratch, block_rows: int, fan_in: int) -> DataFrame:
    """One row per block: place of its first row, counts, letters, state it starts in, cost to go."""
    block = F.floor(F.col("seq") / block_rows)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "runs")))
    blocks = (
        number_rows(symbols, KEYS, PLACE)
        .groupBy(*KEYS, block.alias("block"), F.floor((F.col("n_rows") - 1) / block_rows).alias("last_block"))
        .agg(F.array_join(F.transform(ordered, lambda x: x.runs), " ").alias("runs"), F.min(F.struct(*PLACE)).alias("place"))
    )
    blocks = scratch.save(blocks.select("*", _summary("runs").alias("s")).select("*", "s.*").drop("s"))
    one = F.array(*[F.lit(x).cast("bigint") for x in _flat(ONE)])
    by = [*KEYS, "block"]
    several = blocks.where("last_block > 0")
    if several.isEmpty():
        found = blocks.withColumns({"behind": one, "start": F.lit(START), "previous": F.lit(None).cast("string")})
    else:
        costs = scan(several.withColumnRenamed("matrix", "value"), _product, _flat(ONE), True, fan_in)
        costs = scratch.save(several.join(costs.withColumnRenamed("carry", "behind"), by))
        ends = scratch.save(costs.select(*by, _ends("runs", "behind").alias("value")))
        states = scan(ends, _compose, list(STATES), False, fan_in).select(*by, F.get("carry", F.lit(START)).alias("start"))
        before = Window.partitionBy(*KEYS).orderBy("block")  # one small row per block
        linked = costs.select(*by, "behind", F.lag("last").over(before).alias("previous")).join(states, by)
        found = blocks.join(linked, by, "left").withColumns(
            {"behind": F.coalesce("behind", one), "start": F.coalesce("start", F.lit(START))}
        )
    crossing = F.col("previous").isNotNull() & ~F.concat("previous", "first").isin(*LEGAL)
    chosen = _letters("runs", "behind", "start", F.col("block") == F.col("last_block"))
    return scratch.save(
        found.withColumn("c", chosen).select(
            *KEYS, "block", "place", "blank", "duplicate", "truncated", (F.col("illegal") + crossing.cast("int")).alias("illegal"),
            "c.letters", "c.start", "c.cost",
        )
    )


def _in_order(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of each conversation in order, the letters of a block before its rows."""
    texts = rows.where("copies > 0").select(*KEYS, *PLACE, F.lit(1).alias("kind"), "text", "copies")
    letters = blocks.select(*KEYS, "place.*", F.lit(0).alias("kind"), F.col("letters").alias("text"), F.col("start").cast("long").alias("copies"))
    small_batches(rows.sparkSession)
    return texts.unionByName(letters).repartition(*KEYS).sortWithinPartitions(*KEYS, *PLACE, "kind")


class _Writer:
    """Edits of one conversation in order: ``edits`` yields (letter, role, text)."""

    def __init__(self):
        self.letters, self.at, self.state = "", 0, START

    def block(self, letters: str, state: int) -> Iterator[tuple[str, str, str]]:
        yield from self.rest()
        self.letters, self.at, self.state = letters, 0, state

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, EITHER[self.state]
            yield "I", NAME[self.state], ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self.inserts()
            letter, self.at = self.letters[self.at], self.at + 1
            if letter == "R":
                self.state = EITHER[self.state]
                role = NAME[self.state]
            elif letter == "K":
                self.state = NEXT[role[0]][self.state]
            yield letter, role, text

    rest = inserts


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, letters of a block or None, edit or None) of all conversations of a partition."""
    key, writer = None, _Writer()
    for batch in batches:
        columns = (batch.column(c) for c in ("known", "conv", "role", "kind", "text", "copies"))
        for known, conv, role, kind, text, copies in zip(*(c.to_pylist() for c in columns)):
            if (known, conv) != key:
                yield from ((key, None, e) for e in writer.rest())
                key, writer = (known, conv), _Writer()
            if kind:
                yield from ((key, None, e) for e in writer.row(role, text, copies))
            else:
                yield from ((key, None, e) for e in writer.block(text, copies))
                yield key, text, None
    yield from ((key, None, e) for e in writer.rest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, key, position, size = [], None, 0, 0
    fields = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for at, letters, edit in _edits(batches):
        if at != key:
            key, position = at, 0
        if edit and edit[0] != "D":
            rows.append((key[1] if key[0] else None, position, *edit))
            position, size = position + 1, size + len(edit[2])
        if len(rows) >= 2000 or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, conv, audit, repaired_sha256); of a text only its digest's state is held."""
    out: list[tuple] = []
    names = ["known", "conv", "audit", "repaired_sha256"]
    key, audit, digest, lines = None, [], hashlib.sha256(), 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    for at, letters, edit in _edits(batches):
        if at != key:
            if key is not None:
                out.append((*key, "".join(audit), digest.hexdigest()))
            key, audit, digest, lines = at, [], hashlib.sha256(), 0
            if len(out) >= 5000:
                yield flush()
                out.clear()
        if letters is not None:
            audit.append(letters)
        elif edit[0] != "D":
            digest.update(f"{chr(10) if lines else ''}{edit[1]}:{edit[2]}".encode())
            lines += 1
    if key is not None:
        out.append((*key, "".join(audit), digest.hexdigest()))
        yield flush()


def _prepare(conversations: DataFrame, scratch: Scratch, block_rows: int, fan_in: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(conversations)
    counted, symbols = _runs(rows, scratch)
    return rows, counted, _blocks(symbols, scratch, block_rows, fan_in)


def repair(conversations: DataFrame, scratch: Scratch | None = None, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The repaired rows: conv_id, position, edit (K, R or I), role, text.

    ``conversations`` has conv_id, turn, role, text and optionally ``copies`` (a row stands for
    so many equal ones in a row; 0: for none).
    """
    scratch = scratch or Scratch(conversations.sparkSession)
    rows, _, blocks = _prepare(conversations, scratch, block_rows, fan_in)
    return _in_order(rows, blocks).mapInArrow(_repaired, REPAIRED)


def report(conversations: DataFrame, scratch: Scratch | None = None, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per conv_id: gaps, counts of faults, cost, audit and digest of its repair."""
    scratch = scratch or Scratch(conversations.sparkSession)
    rows, counted, blocks = _prepare(conversations, scratch, block_rows, fan_in)
    turn = F.when(F.col("has_turn"), F.col("at"))
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  (turns may lie at both ends of a long)
    span = wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn)
    gaps = F.when(span > MOST, MOST).otherwise(span)
    numbers = ["blank", "duplicate", "truncated", "illegal"]
    first = F.when(F.col("block") == 0, F.col("cost")).otherwise(0)
    parts = [
        rows.select(*KEYS).distinct(),
        counted.groupBy(*KEYS).agg(gaps.cast("bigint").alias("gaps")),
        blocks.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in numbers], F.sum(first).alias("cost")),
        _in_order(rows, blocks).mapInArrow(_digests, "known boolean, conv long, audit string, repaired_sha256 string"),
    ]
    together = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    texts = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return (
        together.groupBy(*KEYS)
        .agg(*[F.max(c).alias(c) for c in ["gaps", *numbers, "cost", *texts]])
        .select(
            F.when(F.col("known"), F.col("conv")).alias("conv_id"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *numbers, "cost"]],
            *[F.coalesce(c, F.lit(v)).alias(c) for c, v in texts.items()],
        )
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by a hash of each row's place (see the query's contract)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = shown("text")
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
