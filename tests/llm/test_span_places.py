"""Places of words as one number: ranks of texts, and aggregations without sorting."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelith.llm import substring
from panelith.llm._words import Words


def test_ranks_follow_doc_ids(spark):
    rows = [(i * 7919 % 1009 - 300, i % 3, i) for i in range(1000)] + [(None, 5, 1000), (None, -5, 1001), (-(1 << 63), 0, 1002), ((1 << 63) - 1, 0, 1003)]
    df = spark.createDataFrame(rows, "doc_id long, tie long, n int").repartition(7)
    out = {r.n: r["rank"] for r in substring._ranked(df).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [out[r[2]] for r in want] == list(range(len(rows)))
    assert substring._ranked(df.limit(0)).count() == 0


def test_edges_are_aggregated_without_sorting(spark):
    """Nodes go through hash tables: a struct's least or greatest would sort them before and after the shuffle."""
    edges = spark.createDataFrame([(1, 2, 5, 0, 0), (2, 3, 5, 0, 1)], "p long, s long, source_doc long, source_tie long, source_at int")
    plan = substring._compacted(edges)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and not re.search("SortAggregate", plan)
    texts = spark.createDataFrame([(3, " ".join(map(str, range(30))), list(range(30)))], "rank long, text string, places array<int>")
    got = substring._windows(texts, 20, 8)
    assert got.columns == ["p", "s", "place"] and sorted(r.place for r in got.collect()) == [(3 << 31) + i for i in range(11)]
    assert got.groupBy("p", "s").agg(F.min("place"), F.max("place")).count() == 11


def test_firsts_tell_copies(spark):
    rows = [(2, "a"), (1, "a"), (None, "b"), (5, "b"), (None, "c"), (None, "c"), (7, "d"), (7, "d"), (8, None), (-3, "")]
    got = {r.id: (r.doc_id, r.many) for r in substring._firsts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = {r.text: r.id for r in substring._keyed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {ids["a"]: (1, True), ids["b"]: (None, True), ids["c"]: (None, False), ids["d"]: (7, False), ids[""]: (-3, False)}


def test_words_are_joined_without_objects():
    texts = ["  a bb\tccc  d ", "", None, "é\u00a0x y", " \n ", "one", "x" * 300 + "\r\ny z"]
    w = Words(pa.array(["left out", *texts]).slice(1), False)
    assert "hash" not in w.__dict__  # a word is hashed only where hashes are asked for
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    rng = np.random.default_rng(3)
    for keep in (np.ones(len(w.start), bool), np.zeros(len(w.start), bool), *(rng.random((50, len(w.start))) < 0.5)):
        kept = iter(keep.tolist())
        assert w.joined(keep).to_pylist() == [" ".join([x for x in own if next(kept)]) for own in words]
    assert Words(pa.array([], pa.string()), False).joined(np.zeros(0, bool)).to_pylist() == []


def test_walks_over_batches():
    """Edges of two texts, some twice: walks end where the text, the source, the path or the batch does."""
    p = lambda rank, at: (rank << 31) + at
    edges = [(p(1, 3), p(0, 0), False), (p(1, 4), p(0, 1), True), (p(1, 5), p(0, 2), False), (p(1, 5), p(0, 2), False), (p(1, 6), p(0, 3), True), (p(1, 7), p(0, 4), True), (p(2, 8), p(0, 5), True), (p(2, 9), p(0, 5), True), (p(2, 12), p(1, 0), False)]
    got = lambda *cuts: [tuple(r.values()) for b in substring._walks(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*edges[lo:hi], strict=True)], names=["place", "source", "on"]) for lo, hi in zip((0, *cuts), (*cuts, len(edges)), strict=True)])) for r in b.to_pylist()]
    assert got() == [(1, 3, 2, 1, 0, 0), (1, 5, 3, 1, 0, 2), (2, 8, 1, 2, 0, 5), (2, 12, 1, 1, 1, 0)]
    assert got(3, 4) == [(1, 3, 2, 1, 0, 0), (1, 5, 1, 1, 0, 2), (1, 6, 2, 1, 0, 3), (2, 8, 1, 2, 0, 5), (2, 12, 1, 1, 1, 0)]


def test_windows_are_hashed_once_and_joined_without_sorting(spark, monkeypatch):
    """The texts are read for windows once, and neither windows nor anchors are sorted for their joins."""
    plans, calls, keep, own = {}, [], substring.materialise, substring._windows

    def kept(df, label, by=None):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, label, by)

    monkeypatch.setattr(substring, "materialise", kept)
    monkeypatch.setattr(substring, "_windows", lambda *a: calls.append(1) or own(*a))
    text = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(1, text), (2, f"x {text} y"), (3, f"z {text}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.deduplicate(rows).collect()} == {1: 0, 2: 30, 3: 30}
    assert len(calls) == 1 and "MapInArrow" in plans["windows"] and "MapInArrow" not in plans["edges"]
    assert plans["walks"].count("ShuffledHashJoin") >= 1 and "SortMergeJoin" not in plans["walks"] and plans["walks"].count("MapInArrow") == 1
    assert "SortMergeJoin" not in plans["paths"] and "Window" not in plans["paths"]
    assert "SortAggregate" not in plans["firsts"]
