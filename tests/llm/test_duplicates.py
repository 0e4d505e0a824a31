"""Jaccard join and suffix-array dedup against brute force."""

import hashlib

import numpy as np
import pytest
from fixtures import component_ids, cut_repeats, shingle_set

from learnloom.llm import jaccard_join, suffix_dedup
from learnloom.session import Scratch


def by_id(table):
    return {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}


@pytest.mark.parametrize("few", [16, 1])
def test_components_against_brute_force(documents, few, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", few)  # 1: every shared signature is crowded
    texts = by_id(documents)
    want = component_ids(texts)
    found = jaccard_join.near_duplicates(documents).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {k: len(shingle_set(t)) for k, t in texts.items()}


def chain(n: int) -> list[tuple]:
    """Texts in a row, each near the next one but not the ones further away, and near copies."""
    words = [f"c{i}" for i in range(400)]
    return [(i, " ".join(words[4 * i : 4 * i + 120]), "en", "a") for i in range(n)]


@pytest.mark.parametrize("few", [16, 2])
def test_links_that_only_neighbours_have(spark, few, monkeypatch):
    from fixtures import awkward_documents

    monkeypatch.setattr(jaccard_join, "FEW", few)
    rows = chain(25) + [(100 + i, " ".join(f"z{j}" if j % 50 != i else f"y{i}" for j in range(200)), "en", "a") for i in range(40)]
    table = awkward_documents(spark, rows)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(table).collect()} == component_ids({r[0]: r[1] for r in rows})


def test_sets_with_features_of_their_own_meet_no_block(spark, monkeypatch):
    from fixtures import awkward_documents

    monkeypatch.setattr(jaccard_join, "FEW", 1)
    met, real = [], jaccard_join.set_blocks
    monkeypatch.setattr(jaccard_join, "set_blocks", lambda people: met.append(people.count()) or real(people))
    common = [f"b{i}" for i in range(40)]
    own = [[f"u{i}_{j}" for j in range(30)] for i in range(40)]
    near = [[f"v{j}" if j else f"w{i}" for j in range(30)] for i in range(3)]
    rows = [(i, " ".join(common + words), "en", "a") for i, words in enumerate(own + near)]
    table = awkward_documents(spark, rows)
    want = component_ids({r[0]: r[1] for r in rows})
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(table).collect()} == want
    assert want[42] == 40 and met and met[0] <= 3


@pytest.mark.parametrize("slice_features, step, rows", [(1 << 23, 1 << 20, 1), (1 << 23, 100, 1), (400, 50, 12)])
def test_a_set_has_one_count_of_its_own_features(spark, slice_features, step, rows, monkeypatch):
    """Whatever the number of parts: further rows only for clusters larger than a slice."""
    monkeypatch.setattr(jaccard_join, "SLICE_FEATURES", slice_features)
    monkeypatch.setattr(jaccard_join, "STEP_FEATURES", step)
    rng = np.random.default_rng(11)
    common = rng.integers(0, 2**63, 20, dtype=np.uint64)
    sets, people = {}, []
    for key in range(0, 160, 2):
        sets[key] = np.unique(np.concatenate([common, rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        people.append((key, len(sets[key]), int(key < 20), True))  # clusters of 70 and of 10
    holders = lambda f, cluster: sum(f in sets[k] for k, _, c, _ in people if c == cluster)
    want = {k: sum(holders(f, c) == 1 for f in sets[k]) for k, _, c, _ in people}
    table = spark.createDataFrame(people, "key long, n_shingles long, cluster long, outside boolean")
    stored = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()] * 2, "key long, features binary")
    found = [(r.key, r.alone) for r in jaccard_join.alone_counts(table, stored, 64).collect()]
    assert len(sets) <= len(found) <= rows * len(sets)
    assert {k: sum(n for key, n in found if key == k) for k in sets} == want
    assert (rows == 1) == (len(found) == len(sets))


def test_block_links_are_those_of_whole_sets():
    """The features and sets left out of a meeting change none of its links."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))]
    for i in range(60):
        old = sets[rng.integers(len(sets))]
        fresh = rng.integers(0, 2**63, rng.integers(1, 12)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([old[len(fresh) :], fresh])))
    rows = [(side, 2 * i, True, s.tobytes()) for side in (0, 1) for i, s in enumerate(sets) if side or i % 2]
    meeting = pa.table({name: list(column) for name, column in zip(("side", "key", "own", "features"), zip(*rows))})
    links = jaccard_join.links_of_blocks(meeting)
    linked = lambda a, b: a != b and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))

    def groups(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    found = [(u // 2, v // 2) for u, v in zip(links.column("u").to_pylist(), links.column("v").to_pylist())]
    every = [(a, b) for a in range(1, len(sets), 2) for b in range(len(sets)) if linked(a, b)]
    assert found and set(found) <= set(every) and groups(found) == groups(every)


def test_awkward_components(awkward, nothing):
    found = jaccard_join.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    want = component_ids({k: t for k, t in by_id(awkward).items() if k is not None})
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert want[2] == want[3] == 1 and want[8] == 7
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_one_row_of_each_component_stays(awkward, nothing):
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    want = component_ids({k: t for k, t in by_id(awkward).items() if k is not None})
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(want.values()))
    assert all(r._id == 7 and r.size == 7 for r in rows) and len(rows) == len(set(want.values())) + 1
    assert jaccard_join.keep_one(nothing).count() == 0


def test_signatures_never_miss():
    """Random pairs of sets at and just above the threshold share a signature."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        common = int(rng.integers(1, 200 if trial % 3 else 8)) * 4
        left = int(rng.integers(0, common // 4 + 1))
        right = common // 4 - left
        pool = rng.integers(0, 2**63, common + left + right, dtype=np.uint64)
        a = np.unique(pool[: common + left])
        b = np.unique(np.concatenate([pool[:common], pool[common + left :]]))
        same = len(np.intersect1d(a, b))
        assert 5 * same >= 4 * (len(a) + len(b) - same)
        if np.array_equal(a, b):
            continue
        _, key, _ = jaccard_join.set_keys([a, b])
        sig, of = jaccard_join.signatures([a, b], key, jaccard_join.bands(max(len(a), len(b))))
        mine = {s for s, k in zip(sig.tolist(), of.tolist()) if k & ~1 == int(key[0])}
        theirs = {s for s, k in zip(sig.tolist(), of.tolist()) if k & ~1 == int(key[1])}
        assert mine & theirs, (len(a), len(b), same)


def test_blocks_against_plain_intersections():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    left, right = ([np.unique(rng.choice(pool, rng.integers(1, 3000))) for _ in range(n)] for n in (7, 5))
    counts = jaccard_join.common_counts(left, right)
    assert counts.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard_join.common_counts([pool[:3]], [pool[3:5]]).tolist() == [[0]]


def test_forest_keeps_connectivity():
    rng = np.random.default_rng(9)
    for _ in range(50):
        cells = rng.random((12, 9)) < rng.random() / 3

        def groups(edges):
            name = list(range(21))
            for r, c in edges:
                a, b = name[r], name[12 + c]
                name = [a if x == b else x for x in name]
            return {frozenset(i for i in range(21) if name[i] == x) for x in name}

        edges = jaccard_join.forest(cells)
        assert all(cells[e] for e in edges) and len(edges) <= 20
        assert groups(edges) == groups(np.argwhere(cells).tolist())


@pytest.mark.parametrize("size", [256, 4])
def test_half_shared_texts_and_hidden_links(spark, size, monkeypatch):
    """Texts that share half of their words meet, and the links between a few of them are found."""
    from fixtures import awkward_documents

    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", size)
    common = " ".join(f"s{j}" for j in range(100))
    rows = [(i, common + " " + " ".join(f"t{i // 2}_{j}" for j in range(100)) + f" end{i}", "en", "a") for i in range(40)]
    table = awkward_documents(spark, rows)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(table).collect()} == {i: i // 2 * 2 for i in range(40)}


def test_collection_transform_against_sorted_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [bytes(rng.choice([97, 98, 244], rng.integers(1, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        suffixes = [([(x + 1, 0) for x in t[i:]] + [(0, d)], d, i) for d, t in enumerate(texts) for i in range(len(t) + 1)]
        suffixes.sort(key=lambda s: s[0])
        bwt = [texts[d][i - 1] + 1 if i else 0 for _, d, i in suffixes]
        lcp = [0]
        for (x, _, _), (y, _, _) in zip(suffixes, suffixes[1:]):
            n = 0
            while x[n] == y[n] and x[n][0]:
                n += 1
            lcp.append(n)
        got_bwt, got_lcp = suffix_dedup.collection_bwt(texts)
        assert (got_bwt.tolist(), got_lcp.tolist()) == (bwt, lcp)


def removed(table, scratch=None):
    rows = suffix_dedup.remove_repeats(table, scratch).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def wanted(table):
    rows = sorted((r for r in table.select("doc_id", "text").distinct().collect()), key=lambda r: (r.doc_id is None, r.doc_id))
    cut = cut_repeats([r.text for r in rows])
    return {r.doc_id: (*c[:3], hashlib.sha256(c[3]).hexdigest()) for r, c in zip(rows, cut)}


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats_against_brute_force(documents, crowd, monkeypatch):
    places = suffix_dedup.repeated_places
    monkeypatch.setattr(suffix_dedup, "repeated_places", lambda d, s: places(d, s, crowd))
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 50)
    assert removed(documents) == wanted(documents)


def test_repeats_in_awkward_texts(awkward, nothing):
    assert removed(awkward) == wanted(awkward)
    assert set(awkward.columns) <= set(suffix_dedup.remove_repeats(awkward).columns)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_in_periodic_texts(spark):
    from fixtures import awkward_documents

    period = "".join(f"{i:03d}" for i in range(20))
    rows = [(1, period * 30, "en", "a"), (2, "x" * 500, "en", "a"), (3, "y" + "x" * 350 + period * 3, "en", "a"), (4, "ab " * 90 + "x" * 99, "en", "a")]
    table = awkward_documents(spark, rows)
    assert removed(table, Scratch(spark)) == wanted(table)


def test_hot_windows_stay_out_of_collections(spark, monkeypatch):
    """A passage in many documents with different surroundings: no collection holds all its copies."""
    from fixtures import awkward_documents, prose

    passage, largest, compare = prose(900, 40), [], suffix_dedup.compare_collections

    def spy(strings):
        largest.append(max((r["count"] for r in strings.groupBy("collection").count().collect()), default=0))
        return compare(strings)

    places = suffix_dedup.repeated_places
    monkeypatch.setattr(suffix_dedup, "compare_collections", spy)
    monkeypatch.setattr(suffix_dedup, "repeated_places", lambda d, s: places(d, s, 20))
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 20)
    rows = [(i, f"{prose(1000 + i, 20, 10**6)} {passage} {prose(2000 + i, 20, 10**6)}", "en", "a") for i in range(300)]
    rows.append((5, f"{prose(1005, 20, 10**6)} {passage} end", "en", "a"))  # the same place in another text
    table = awkward_documents(spark, rows)
    assert sorted(map(tuple, (r[:4] for r in removed_rows(table)))) == sorted(map(tuple, wanted_rows(table)))
    assert largest[0] < 150


def removed_rows(table):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(table).collect()]


def wanted_rows(table):
    """By definition: windows whose bytes start earlier (a smaller id, or earlier in the same id)."""
    rows = [(r.doc_id, r.text.encode()) for r in table.collect()]
    n = suffix_dedup.LENGTH
    first = {}
    for doc, text in rows:
        for i in range(len(text) - n + 1):
            first[text[i : i + n]] = min(first.get(text[i : i + n], (doc, i)), (doc, i))
    for doc, text in rows:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - n + 1):
            if first[text[i : i + n]] < (doc, i):
                gone[i : i + n] = True
        yield doc, len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
