"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from fixtures import SF_DIR

from learnloom.llm import conversations as C
from learnloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, n long, block long, copies_made long"
WHITE = "\x20\x09-\x0d"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role = "user" if kind == 4 else shown[2]
        text = "" if kind == 1 else re.sub("[.!?]", "", shown[3]) if kind == 2 else shown[3]
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    place = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest())
    return {c: sorted(rows, key=place) for c, rows in out.items()}


def faults(rows):
    found, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(f"[^{WHITE}]", text)
        found.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, kinds):
    """Least (cost, letters) by Dijkstra over (rows used, last two written roles' automaton)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, settled = [(0, "", 0, "", ())], {}
    while heap:
        cost, letters, i, state, written = heapq.heappop(heap)
        if i == len(rows) + 1:
            return cost, letters, written
        if settled.get((i, state)) is not None:
            continue
        settled[i, state] = cost, letters
        put = lambda c, x, j, s, w: heapq.heappush(heap, (cost + c, letters + x, j, s, w))
        if i == len(rows) and state in ("", "a"):
            put(0, "", i + 1, state, written)
        for role in ("user", "assistant"):
            if (state, role[0]) in after:
                put(3, "I", i, role[0], (*written, f"{role}:"))
                if i < len(rows) and kinds[i] in ("", "truncated"):
                    put(3 + 3 * (kinds[i] != ""), "R", i + 1, role[0], (*written, f"{role}:{rows[i][2]}"))
        if i < len(rows):
            put(4, "D", i + 1, state, written)
            if kinds[i] in ("", "truncated") and (state, rows[i][1][:1]) in after:
                put(3 * (kinds[i] != ""), "K", i + 1, rows[i][1][0], (*written, f"{rows[i][1]}:{rows[i][2]}"))


def expected(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    for conv, kept in damaged(rows).items():
        if not kept:
            continue
        kinds, turns = faults(kept), [t for t, _, _ in kept if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, letters, written = cheapest(kept, kinds)
        assert LEGAL.fullmatch("".join(w[0] for w in written))
        digest = hashlib.sha256("\n".join(written).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert df.columns == ["conv_id", *names]
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def awkward():
    """Nulls everywhere, other roles, turns at the ends of a long, repeated rows, long texts."""
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "u", "sys"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "é日本?", "Yes. ", "x" * 200_000 + ".", "a\nb"]
    rows = [
        (rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(roles), rng.choice(texts))
        for _ in range(70)
    ]
    # distinct rows at one turn are ordered by the text's digest, equal ones side by side
    rows += [(6, -(2**63), "user", "Hi."), (6, 2**63 - 1, "assistant", "Bye.")]
    return rows + [(7, None, "system", "A."), (7, None, "system", "A."), (8, 0, None, None)] + rows[:5]


def test_edit_search_on_all_short_conversations():
    """Every sequence of up to four symbols, whole and cut into two blocks."""
    symbols = [r + f for r in "suax" for f in "ktd"]
    name, fault = {"s": "sys", "u": "user", "a": "assistant", "x": "x"}, {"k": "", "t": "truncated", "d": "duplicate"}
    for n in range(1, 4):
        for seq in itertools.product(symbols, repeat=n):
            cost, letters, _ = cheapest([(0, name[s[0]], "") for s in seq], [fault[s[1]] for s in seq])
            text = " ".join(f"{s}1" for s in seq)
            assert C.unroll(text, C.DONE, C.START, True)[::2] == (letters, cost)
            if n > 1:
                first, second = text.split(" ", 1)
                behind = C.apply(C.summary(second)[6], C.DONE)
                head, state, whole = C.unroll(first, behind, C.START, False)
                tail, _, _ = C.unroll(second, C.DONE, state, True)
                assert (head + tail, whole) == (letters, cost)


def test_long_runs_are_powers():
    matrix = C.ONE
    for _ in range(1000):
        matrix = C.times(matrix, C.power("uk", 0))
    assert C.summary("uk1000")[6] == matrix
    assert C.summary("uk400 uk600")[6] == matrix
    letters, _, cost = C.unroll("uk1000 ad500", C.DONE, C.START, True)
    want = cheapest([(0, "user", "")] * 60, [""] * 60)
    assert C.unroll("uk60", C.DONE, C.START, True)[::2] == (want[1], want[0])
    assert len(letters) - letters.count("I") == 1500 and letters.endswith("D" * 500 + "I" * (len(letters) - len(letters.rstrip("I")))) and cost > 0


@pytest.mark.parametrize("block_rows, fan_in", [(C.BLOCK_ROWS, C.FAN_IN), (2, 2)])
def test_awkward_conversations(spark, block_rows, fan_in):
    rows = awkward()
    got = found(C.report(C.damage(table(spark, rows)), block_rows=block_rows, fan_in=fan_in))
    assert got == expected(rows)


def test_hot_conversation_in_blocks(spark):
    """One conversation of 400 rows in blocks of 3, scans of three levels and more."""
    rng = random.Random(1)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"t{i}.", f"t{i}"])) for i in range(400)]
    rows += [(2, i, "user" if i % 2 else "assistant", f"x{i}.") for i in range(7)]
    assert found(C.report(C.damage(table(spark, rows)), block_rows=3, fan_in=4)) == expected(rows)


def test_repaired_rows(spark):
    rows = awkward()
    got = {}
    for r in C.repair(C.damage(table(spark, rows)), block_rows=4).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, want in expected(rows).items():
        assert hashlib.sha256("\n".join(got.get(conv, [])).encode()).hexdigest() == want[-1]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.report(C.damage(empty)).count() == 0 and C.repair(C.damage(empty)).count() == 0


def test_query_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_conversation_repair"](spark, SF_DIR)) == expected(rows)
