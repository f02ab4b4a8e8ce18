"""Damaged streams, names in articles, copies with long shared texts, repeated words, clashing columns."""

from __future__ import annotations

import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelith.llm import decontaminate, html_content, mpeg_audio, neardup


def test_damaged_streams_are_rows(spark):
    whole, other = (mpeg_audio.write_audio(mpeg_audio.payload_of(t), len(t)) for t in ("some text " * 400, "other"))
    lost = other.replace(b"payload_bytes", b"payload_bites")
    assert lost != other
    rows = [(0, whole), (1, whole[:-400]), (2, lost), (3, b"no stream"), (4, None), (5, other), (6, other.replace(b"n_bytes", b"m_bytes"))]
    out = {r.doc_id: r for r in mpeg_audio.probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert {k: r.payload_ok for k, r in out.items()} == {0: True, 1: False, 2: False, 3: None, 4: None, 5: True, 6: False}
    assert [out[k].payload_sha256 is None for k in range(7)] == [False, True, True, True, True, False, True] and out[0].n_bytes == 4000 and out[1].frames < out[0].frames


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p>Alpha text.</p><h2 id="related-work">Title here</h2><p>Beta</p></article>', "Alpha text. Title here Beta"),
        ('<article><div id="search-algorithms">One</div><p id="notice">Two</p><section id="share-of-energy">Three</section><div class="social-history"><p>Four</p></div></article>', "One Two Three Four"),
        ('<main><section id="cookies"><p>Mix butter and sugar.</p></section></main>', "Mix butter and sugar."),
        ('<div><h2 id="login-flow">Login flow</h2><div id="search-algorithms">Trees</div></div>', "Login flow Trees"),
        ('<article><p>A</p><div class="ad">Buy</div><div class="related-posts">More</div><section class="comments">Hi</section><p>B</p></article>', "A B"),
        ('<a class="skip-link" href="#x">Skip</a><div class="site-footer">F</div><div id="cookie-banner">C</div><p>Text</p><div class="widget_area">W</div>', "Text"),
        ('<article><p>Read <span class="search">on</span> here</p></article>', "Read on here"),
    ],
)
def test_names_say_little_in_articles(page, text):
    assert html_content.extract(html_content.parse(page), None) == text


def test_pages_that_share_long_texts_are_no_copies(spark):
    legal = ["We keep what you send us for as long as the law allows. " * 12, "Nothing here may be copied without consent of the owner. " * 12]
    pages = [(i, f"http://one.example/{i}", f"<body><div><h1>Head {i}</h1><p>Story number {i} about {'fish' if i % 2 else 'birds'}.</p></div><p>{legal[0]}</p><p>{legal[1]}</p></body>") for i in range(12)]
    out = {r.page_id: r.text for r in html_content.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(f"Story number {i} about" in t and "law allows" not in t and "consent" not in t for i, t in out.items())
    # copies of an article count once, though an advert beside it differs
    story = "<article><h1>Same</h1><p>The same story on every page.</p></article>"
    copies = [(i, f"http://two.example/{i}", f"<body><div><p>Advert {i}</p></div>{story}</body>") for i in range(9)]
    assert {r.text for r in html_content.main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"Same The same story on every page."}


def test_repeated_words_are_verified_once(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, "no such thing here"), (3, "word " * 11), (4, "x " + "word " * 40 + "y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "word " * 1000), (8, "word " * 30 + "end")], "item_id long, text string")
    began = time.time()
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    assert time.time() - began < 60
    assert [g[:2] for g in got] == [(1, 7), (1, 8), (4, 7), (4, 8)] and got[0][4:] == (1000, 1000) and got[2][4] >= 40
    rnd = np.random.RandomState(1)
    for _ in range(50):
        own, item = rnd.randint(0, 4, 40), rnd.randint(0, 4, 15)
        shared = [{"ats": np.flatnonzero(own == v).tolist(), "item_ats": np.flatnonzero(item == v).tolist()} for v in range(4)]
        assert decontaminate.diagonals(shared, 40, 15) == sorted({int(a - b) for s in shared for a in s["ats"] for b in s["item_ats"]})


def test_clashing_columns_stay(spark, sf_dir):
    docs = spark.createDataFrame([(1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (3, None, "c"), (4, "other words that are here now", "d")], "doc_id long, text string, lang string")
    for name in ("_tid", "_head", "_head_doc", "_hit", "_predicted"):
        docs = docs.withColumn(name, F.lit(name))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r._tid, r._head) for r in kept.collect()} == {(i, "_tid", "_head") for i in (1, 3, 4)}
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert clean.columns == docs.columns and {r._hit for r in clean.collect()} == {"_hit"}
    assert corpus_pipeline.identify_language(spark, docs, sf_dir).columns == docs.columns


def test_wrappers_alone_find_the_articles(spark, sf_dir):
    """On given pages of hosts with enough pages, the wrappers keep without the marks of elements and names what they keep with them; without either, no page is right."""
    given = spark.read.parquet(str(Path(sf_dir).parent / "sf0.01" / "pages.parquet")).repartition(4)
    both, alone, none = ({r.page_id: r.text for r in html_content.main_text(given, *flags).collect()} for flags in ((True, True), (True, False), (False, False)))
    hosts = Counter(html_content.host_of(r.url) for r in given.select("url").collect())
    many = {r.page_id for r in given.collect() if hosts[html_content.host_of(r.url)] >= html_content.MIN_PAGES}
    assert many and all(alone[k] == both[k] != none[k] for k in many if both[k])
