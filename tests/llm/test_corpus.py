"""Language, mixing, packing, pages and the pipeline."""

import base64
import time
import zlib

import compare
import numpy as np
import pytest
from fixtures import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from learnloom.llm import html_text, language, mixing, packing, warc
from learnloom.llm.queries import ORACLE, QUERIES
from learnloom.session import Scratch

WEIGHTS = [3, 1, 2]


@pytest.fixture(scope="module")
def network(documents):
    return language.fit(documents)


def test_language_of_held_out_documents(documents, network):
    found = language.identify(documents, network).withColumn("held_out", language.fold(F.col("doc_id")) == 2).toPandas()
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()
    assert set(held.doc_id) == {i for i in found.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_ignores_labels_of_the_input(documents, network):
    a = language.identify(documents, network).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()
    b = language.identify(documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), network)
    assert a == b.select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()


def test_language_of_awkward_texts(awkward, nothing, network):
    found = language.identify(awkward, network)
    assert [c for c in found.columns if c not in awkward.columns] == ["lang_pred"]
    rows = {r.doc_id: r for r in found.collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (4, 5, 6, 11))
    assert all(rows[i].lang_pred in network.languages for i in (1, 7, 12, None))
    assert language.identify(nothing, network).count() == 0
    assert language.fit(nothing) is None
    assert {r.lang_pred for r in language.identify(awkward, None).collect()} == {"und"}


def expected_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in fixed)
        share = sum(weight[s] for s in order if s not in fixed)
        target = {s: 2.0 * sizes[s] if s in fixed else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s] + 1e-9} - fixed
        if not over:
            return target
        fixed |= over


def check_mix(rows):
    sizes, largest, taken = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    target = expected_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and np.isclose(r.target, target[r.source])
        if r.size:
            assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_mix(documents):
    first = sorted(map(tuple, mixing.mix(documents).collect()))
    assert first == sorted(map(tuple, mixing.mix(documents.repartition(5)).collect()))
    check_mix(mixing.mix(documents).collect())
    assert len(first) == documents.count()


def test_mix_over_several_levels(documents, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 3)
    check_mix(mixing.mix(documents.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))).collect())


def test_mix_keeps_expectations(spark):
    """Over many equal sources, documents of any size are taken equally often."""
    rows = [(i, "w " * (5 if i % 2 else 50), "en", f"s{i % 60:02d}") for i in range(1200)]
    from fixtures import awkward_documents

    found = mixing.mix(awkward_documents(spark, rows)).toPandas()
    found = found[found.target < 1.9 * found.source_size]
    found["rate"] = found.target / found.source_size
    for _, part in found.groupby(found["size"]):
        assert abs(part.copies.mean() - part.rate.mean()) < 0.08


def test_mix_of_awkward_documents(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert len({(r.taken,) for r in rows if r.doc_id == 12}) == 1
    applied = mixing.apply_mix(awkward)
    assert applied.columns == awkward.columns and applied.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.apply_mix(nothing).count() == 0


def check_packing(texts: list[tuple], rows, window=packing.WINDOW):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    wanted = sorted((str(k), tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]) for k, t in texts)
    runs, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        runs.setdefault((str(r.doc_id), r.sequence_id * window + r.offset - r.start), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    found = []
    for (doc, _), pieces in runs.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        found.append((doc, ids))
    assert sorted(found) == wanted
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
    full = [sum(n for _, n in p) for _, p in sorted(sequences.items())]
    assert all(n == window for n in full[:-1]) and (not full or full[-1] <= window)


def test_packing(documents, awkward, nothing):
    check_packing([tuple(r) for r in documents.select("doc_id", "text").collect()], packing.pack(documents, with_ids=True).collect())
    rows = packing.pack(awkward, window=64, with_ids=True).collect()
    check_packing([tuple(r) for r in awkward.select("doc_id", "text").collect()], rows, 64)
    assert packing.pack(nothing).count() == 0


def test_encoder_splits_like_the_tokenizer():
    rng = np.random.default_rng(1)
    letters = list("ab Zé1²½ªº×÷_'stre\n\t  ..,«»–€çñµĀɏ$\r日\x85\xa0") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)] + ["I'll don't 's", " \n ", ""]
    encoder, untouched = packing.Encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    for text, want in zip(texts, untouched.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids
    assert len(encoder.encode("a <|endoftext|> b")) == 4 * len(untouched.encode("a <|endoftext|> b", add_special_tokens=False).ids)


PAGE = """<html><head><title>x</title><script>if (a < b) "</p>"</script></head><body class="article-page">
<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><article class="post"><header><h1>A  title</h1></header>
<p>First &lt;p&gt; &eacute;t&#233;<p class=ad>Buy now!<p>Second <a href="a>b">link</a> end<br>here</p><!-- <p>no</p> -->
<div class="comments"><p>I disagree with this</p></div><ul><li>one<li>two</ul></article></main>
<aside>side</aside><form><label>Mail</label></form><div id="cookie-notice">We use them</div><footer>c</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title\nFirst <p> été\nSecond link end here\none\ntwo"
    assert html_text.main_text("<div id=sidebar>Links</div><div id=content><h2>T</h2><p>one two</div>") == "T\none two"
    assert html_text.main_text("<p>Some words of plain text</p><ul><li><a>x</a></li><li><a>y</a></li></ul>") == "Some words of plain text"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> \n</p>") == ""
    assert html_text.main_text("just text & more") == "just text & more"
    assert html_text.main_text("<article><p>open <b>bold") == "open bold"
    assert html_text.main_text("<p" * 2000) is not None and html_text.main_text('<a href="' * 500) is not None


ARTICLE = "<h1>A title</h1><p>" + "word " * 60 + "</p><p>" + "more text here " * 50 + "</p>"
MENU = "<nav><a href=x>Home</a><a>About us</a></nav>"
REMARKS = "<section class='comments'><p>" + "I say this too " * 30 + "</p></section>"


@pytest.mark.parametrize(
    "page",
    [
        f"{MENU}<div class='layout has-sidebar'><article>{ARTICLE}</article></div>{REMARKS}<footer>foot</footer>",
        f"{MENU}<div class='post comments-open'>{ARTICLE}</div>{REMARKS}",
        f"<form id='aspnetForm'>{MENU}<div>{ARTICLE}</div><div class='sidebar'><p>{'aside ' * 30}</p></div>{REMARKS}</form>",
        f"<a href=#>skip to content</a><div class='social-article-wrap'><main>{ARTICLE}</main></div>{REMARKS}",
        f"{MENU}{ARTICLE.replace('<h1>', '<h1 class=entry-title>')}{REMARKS}",
        f"{MENU}<div class='sidebar-left'><article>{ARTICLE}</article></div><p>A legal line with quite a few words in it</p>{REMARKS}",
        f"{MENU}<article><h1>A title</h1></article>{ARTICLE[16:]}{REMARKS}",
        f"{MENU}{ARTICLE}<div class='related'><article>{'teaser ' * 30}</article></div>",
        f"<article>{ARTICLE}</article><ol class=comment-list><li><article><p>{'reply ' * 60}</p></article></ol>",
        f"{ARTICLE}<form><label>Mail</label>{'subscribe now ' * 12}</form><!-- open",
    ],
)
def test_main_text_in_wrappers(page):
    want = "\n".join(["A title", ("word " * 60).strip(), ("more text here " * 50).strip()])
    assert html_text.main_text(f"<html><body>{page}") == want


def test_short_article_beside_a_form():
    page = f"{MENU}<p>Short article of six words.</p><form>{'subscribe now ' * 12}</form>{REMARKS}"
    assert html_text.main_text(page) == "Short article of six words."


def test_end_tags_without_a_start_cost_nothing():
    html_text.main_text("<b>x</i>")
    start = time.process_time()
    for unclosed in ("<b>x</i>", "<div><b>x</i>", "<a ", '<a "x>', "<x "):
        html_text.main_text(unclosed * (200_000 // len(unclosed)))
    assert time.process_time() - start < 10


def test_tree_fits_its_table():
    for page in html_text.LABELLED:
        for row, block in zip(html_text.features(page), page):
            assert html_text.is_main(html_text.tree(), row) == bool(block[3])


def test_pages(spark, pages):
    import html
    import re

    found = {r.page_id: r for r in QUERIES["op5_html_text"](spark, SF_DIR).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert found[row.page_id].text == "\n".join(b for b in blocks if b)
        assert found[row.page_id].n_chars == len(found[row.page_id].text)
    table = spark.createDataFrame([(1, None, 5), (None, "<p>a b c d</p>", 6), (1, None, 5)], "page_id long, html string, _main int")
    assert sorted(map(str, html_text.extract(table).collect())) == sorted(
        ["Row(page_id=1, html=None, _main=5, text='', n_chars=0)"] * 2
        + ["Row(page_id=None, html='<p>a b c d</p>', _main=6, text='a b c d', n_chars=7)"]
    )
    assert html_text.extract(table.limit(0)).count() == 0


def test_warc_query_against_sql(spark, oracle):
    assert compare.difference(QUERIES["op9_warc"](spark, SF_DIR), oracle, ORACLE["op9_warc"]) is None


AWKWARD_PAGES = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 3000),
                 (5, "u", "é" * 3000), (None, "u", "alone"), (None, "u", "same"), (8, "u", "WARC/1.1\r\n\r\nfake\x1f\x8b\x08")]


def test_warc_of_awkward_pages(spark, duck):
    table = spark.createDataFrame([(*p, 3) for p in AWKWARD_PAGES], "page_id long, url string, html string, sha1 int")
    con = duck(pages=table.select("page_id", "html"))
    assert compare.difference(warc.round_trip(table), con, warc.SQL) is None
    assert warc.round_trip(table.limit(0)).count() == 0
    least = warc.round_trip(table, least_bytes=5).collect()
    assert {r.record_type for r in least if r.payload_bytes < 5} == {"response"}


def test_warc_splits_and_pushes_filters_down(spark, pages):
    path = Scratch(spark).path()
    many = pages.withColumn("page_id", F.explode(F.array(*[F.col("page_id") + 1000 * i for i in range(6)])))
    many = many.withColumn("html", F.concat(F.col("html"), F.col("page_id").cast("string")))
    warc.archive_pages(many, path)
    whole = spark.read.format("warc").load(path)
    split = spark.read.format("warc").option("splitBytes", 20_000).load(path)
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    texts = {r.page_id: r.html for r in many.collect()}
    rows = split.where("warc_type = 'response'").select(warc.page_of("record_id").alias("p"), "payload").collect()
    assert {r.p: bytes(r.payload).decode() for r in rows} == texts
    one = split.where("warc_type = 'response' and record_id = '<urn:x-page:3>'")
    assert "Filter" not in one._jdf.queryExecution().optimizedPlan().toString().split("RelationV2")[0]
    assert [bytes(r.payload).decode() for r in one.collect()] == [texts[3]]
    spark.createDataFrame([("resource", "u1", b"abc")], "warc_type string, record_id string, payload binary").write.format("warc").mode("append").save(path)
    assert split.where("warc_type in ('resource', 'revisit')").count() == 1


def test_files_of_failed_attempts_are_no_records(spark, tmp_path):
    """A task that fails after it has written leaves a file; its second attempt counts once."""
    import gzip

    foreign = gzip.compress(warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<old>"}, b"old"))
    (tmp_path / "old.warc.gz").write_bytes(foreign)
    writer = warc.WarcWriter({"path": str(tmp_path)}, overwrite=False)
    import pyarrow as pa

    def rows(fail):
        yield pa.RecordBatch.from_pylist([{"warc_type": "response", "record_id": "<r1>", "payload": b"x" * 5000}])
        if fail:
            raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(rows(True))
    writer.commit([writer.write(rows(False))])
    assert len(list(tmp_path.glob("*.warc.gz"))) == 3
    found = warc.read_archive(spark, str(tmp_path), "record_id string, warc_type string").where("warc_type = 'response'").collect()
    assert sorted(r.record_id for r in found) == ["<old>", "<r1>"]
    more = warc.WarcWriter({"path": str(tmp_path)}, overwrite=False)
    more.commit([more.write(iter([pa.RecordBatch.from_pylist([{"warc_type": "resource", "record_id": "<r2>"}])]))])
    found = warc.read_archive(spark, str(tmp_path), "record_id string, warc_type string").where("warc_type != 'warcinfo'").collect()
    assert sorted(r.record_id for r in found) == ["<old>", "<r1>", "<r2>"]


def test_foreign_archives(spark, tmp_path):
    """Members without a length field, and an uncompressed file."""
    import gzip

    records = [warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<r{i}>", "WARC-Payload-Digest": "sha1:"
               + warc.base32_sha1(b"x" * i * 5000)}, b"x" * i * 5000) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "note.txt").write_text("not an archive")
    found = warc.read_archive(spark, str(tmp_path), verify=True).where("warc_type = 'response'").collect()
    assert sorted((r.record_id, len(r.payload)) for r in found) == sorted([(f"<r{i}>", i * 5000) for i in range(5)] * 2)
    headers = warc.read_archive(spark, str(tmp_path), "record_id string, content_length long").collect()
    assert sorted(tuple(r) for r in headers) == sorted([(f"<r{i}>", i * 5000) for i in range(5)] * 2)


def test_base32(spark):
    data = [bytes([i]) * i for i in range(20)]
    rows = spark.createDataFrame([(d,) for d in data], "d binary").withColumn("sha1", F.sha1("d")).select("d", warc.base32_column("sha1").alias("b"))
    assert all(r.b == warc.base32_sha1(bytes(r.d)) for r in rows.collect())
    assert base64.b32decode(warc.base32_sha1(b"")) == __import__("hashlib").sha1(b"").digest()
