"""Each stage of the corpus pipeline on its own input."""

import sys
from pathlib import Path

import pytest
from fixtures import SF_DIR, awkward_documents, component_ids, cut_repeats

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, documents):
    """Input and output rows of every stage."""
    from learnloom.session import Scratch

    scratch, docs, found = Scratch(spark), documents, {}
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, SF_DIR))
        found[name] = (docs, after)
        docs = after
    return found


def test_stages_keep_the_columns(steps, documents):
    assert list(STAGES) == ["language_id", "near_duplicates", "repeated_passages", "mix_sources", "pack"]
    for name in list(STAGES)[:-1]:
        assert steps[name][1].columns == documents.columns


def test_language_stage(steps):
    before, after = steps["language_id"]
    kept = {r.doc_id for r in after.collect()}
    assert {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")} >= kept
    assert len(kept) >= 0.95 * before.count()


def test_near_duplicate_stage(steps):
    before, after = steps["near_duplicates"]
    component = component_ids({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(component.values()))


def test_passage_stage(steps):
    before, after = steps["repeated_passages"]
    rows = sorted(before.collect())
    cut = {r.doc_id: c for r, c in zip(rows, cut_repeats([r.text for r in rows]))}
    found = {r.doc_id: r for r in after.collect()}
    for doc_id, (_, _, _, kept) in cut.items():
        text = kept.decode(errors="ignore")
        if text.strip():
            assert found[doc_id].text == text and found[doc_id].n_chars == len(text)
        else:
            assert doc_id not in found


def test_mix_and_pack_stages(steps):
    before, after = steps["mix_sources"]
    words = {}
    for table, i in ((before, 0), (after, 1)):
        for r in table.collect():
            words.setdefault(r.doc_id, [0, 0])[i] += len((r.text or "").split())
    assert all(b <= 2 * a for a, b in words.values())
    total = [sum(w[i] for w in words.values()) for i in (0, 1)]
    assert abs(total[1] - 1.5 * total[0]) < 0.05 * total[0]
    pieces = steps["pack"][1].toPandas()
    docs = pieces[pieces.start == 0].doc_id
    assert sorted(docs) == sorted(r.doc_id for r in after.collect())
    assert (pieces.groupby("sequence_id").length.sum().iloc[:-1] == 2048).all()


def test_awkward_and_empty_input(spark, awkward, nothing):
    for docs in (awkward, nothing, awkward_documents(spark, [(1, None, None, None)])):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            docs.count()
            if name == "near_duplicates":
                docs = docs.cache()
