"""Filter audit, vector codes and byte-level BPE against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelith.llm import bpe, filter_audit, vector_codes


def audit_slowly(docs, labels):
    """Each order applied to all documents, filter by filter."""
    good, toxic, least = set(), set(), {}
    for doc, q, t in labels:
        if doc is not None:
            good |= {doc} if q == 1 else set()
            toxic |= {doc} if t == 1 else set()
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), any(c in text for c in "#$%&*|"), doc is not None and doc > least[text]]
        rows.append((lang or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, doc in good and doc is not None, doc in toxic and doc is not None))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                before = [r for r in own if x in r[1] and r[1] & set(order[: step - 1])]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(before), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), x]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def audited(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    assert len({tuple(r)[:3] for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit(spark):
    rnd = random.Random(3)
    many = " ".join(f"word{i}" for i in range(100))
    texts = [None, "", "few words", many, "A " * 120, many + " $", many.upper(), "é " * 60 + many, "same word\x0b" * 70, "X Y", "#", many + "\r\n\tmore", " ".join(map(str, range(99))), " ".join(["a"] * 20 + [str(i) for i in range(80)])]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += docs[:20] + [(7, many, "en")] * 30 + [(10_000_000_000, many, "x")]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(80)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("part", F.lit(2))
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    assert audited(d, la) == audit_slowly(docs, labels)
    assert audited(d.limit(0), la) == {} and len(audited(d.limit(1), la.limit(0))) == 600
    with pytest.raises(ValueError):
        filter_audit.interactions(filter_audit.cells(d, la), "ABCDEFG")
    two = filter_audit.interactions(spark.createDataFrame([("p", 1, 2, 1, 0), ("p", 3, 4, 0, 1)], "part string, mask int, n long, good long, toxic long"), "XY").orderBy("filter_order", "step").collect()
    assert [tuple(r)[1:] for r in two] == [("XY", 1, 0, 6, 0, 2, 1, 1, 8), ("XY", 2, 0, 0, 4, 0, 0, 0, 4), ("YX", 1, 2, 4, 0, 0, 0, 1, 4), ("YX", 2, 0, 2, 4, 2, 1, 0, 8)]


def lloyd_slowly(rows, parts=8, entries=16, rounds=6):
    """All distances, in Python's integers."""
    kept = [(i, lab, [int(np.floor(4096 * float(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-max((len(r[2]) for r in kept), default=0) // parts)
    cut = [[(r[2] + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    book = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, s: min((dist(s, c), e) for e, c in enumerate(book[p]))
    for _ in range(rounds):
        got = [[near(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [v[p] for v, g in zip(cut, got, strict=True) if g[p] == e]
                if own:
                    book[p][e] = [Fraction(sum(c), len(own)).__floor__() for c in zip(*own, strict=True)]
    out = [(r[0], r[1], *map(list, zip(*[near(p, v[p]) for p in range(parts)], strict=True))) for r, v in zip(kept, cut, strict=True)]
    sums = Counter()
    for _, lab, d, _ in out:
        sums[lab] += sum(d)
    digest = hashlib.sha256(",".join(str(x) for p in book for c in p for x in c).encode()).hexdigest()
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    return digest, sorted(((i, lab, "".join(f"{e:02x}" for e in code), sum(d), sums[lab]) for i, lab, d, code in out), key=key)


def coded(df):
    codes, book = vector_codes.train(df)
    rows = [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(codes).collect()]
    return book.sha256, sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["clusters", "grid", "copies", "few", "odd"])
def test_codes(spark, kind):
    rnd = np.random.RandomState(5)
    n = {"few": 5}.get(kind, 400)
    if kind == "clusters":
        x = rnd.normal(0, 1, (12, 64))[rnd.randint(12, size=n)] + rnd.normal(0, 0.05, (n, 64))
    elif kind == "grid":  # full of ties
        x = rnd.randint(-2, 3, (n, 16)) / 4096
    elif kind == "copies":
        x = np.vstack([np.ones((n - 60, 16)), rnd.normal(0, 1, (60, 16))])
    else:
        x = rnd.normal(0, 20, (n, 24))
    vectors = [[float(np.float32(v)) for v in r] for r in x]
    rows = [(int(i), lab, v) for i, lab, v in zip(rnd.permutation(n) - 10, [None if k == 3 else int(k) for k in rnd.randint(4, size=n)], vectors, strict=True)]
    if kind == "odd":  # nulls, lengths that differ, values that don't fit 32 bits
        rows += [(None, 1, vectors[0]), (1000, 2, None), (1001, 2, [None] + [1.0] * 23), (1002, 2, [float("nan")] * 24), (1003, 0, [float("inf")] * 24), (1004, None, [1.0] * 20), (1005, None, []), (1006, 9, [3e7] * 24), (1007, 9, [-3e7] * 24), (1008, 9, [70000.0] * 23)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], SCHEMA).withColumn("vec", F.lit("clash")).withColumn("code", F.lit(1))
    assert coded(df.repartition(3)) == lloyd_slowly(rows)


def test_codes_edges(spark):
    none = spark.createDataFrame([(1, None, 1)], SCHEMA)
    codes, book = vector_codes.train(none)
    assert codes.count() == 0 and vector_codes.with_label_errors(codes).count() == 0 and book.sha256 == hashlib.sha256(b"").hexdigest()
    codes, _ = vector_codes.train(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [3e38] * 8, 1)], SCHEMA), entries=1)
    assert {r.error for r in codes.collect()} == {vector_codes.MOST_LONG}
    assert [r.label_error for r in vector_codes.with_label_errors(codes).collect()] == [vector_codes.MOST_LONG] * 3


def test_bounds_hold_and_prune():
    x = np.concatenate([[0.0], np.geomspace(1e-3, 1e19, 500)])
    up, down = vector_codes.unhalf(vector_codes.half_up(x)), vector_codes.unhalf(vector_codes.half_down(x))
    assert (up >= x).all() and (down <= x).all() and (up <= x * 1.01 + 1e-30).all() and (down >= x * 0.99).all()
    rnd = np.random.RandomState(0)
    centres = rnd.randint(-9000, 9000, (2, 16, 8))
    v = (centres[:, rnd.randint(16, size=500)] + rnd.randint(-50, 50, (2, 500, 8))).transpose(1, 0, 2)
    code, upper, lower = vector_codes.assign(v, np.zeros((500, 2), np.uint8), vector_codes.half_up(np.full((500, 2), np.inf)), np.zeros((500, 2, 16), np.uint16), centres, centres)
    moved = centres + rnd.randint(-5, 5, centres.shape)
    seen = []
    plain, vector_codes.squared = vector_codes.squared, lambda a, b: seen.append(a.size) or plain(a, b)
    try:
        again = vector_codes.assign(v, code, upper, lower, centres, moved)
    finally:
        vector_codes.squared = plain
    want = ((v[:, :, None] - moved[None]) ** 2).sum(-1).argmin(-1)
    assert (again[0] == want).all() and sum(seen) < 0.2 * v.size * 16
    d = np.sqrt(((v[:, :, None] - moved[None]) ** 2).sum(-1))
    assert (vector_codes.unhalf(again[2]) <= d).all() and (vector_codes.unhalf(again[1]) >= np.take_along_axis(d, again[0][..., None].astype(int), 2)[..., 0]).all()


TEXTS = [
    None, "", "Hello world", "don't we'll I'm they've 'round '' 'll''ve", "  spaces   and\n\n lines\t \r\n" * 9, "é😀 ünïcode 漢字漢字，漢字。" * 7, "x" * 300, " " * 100 + "a", "a" + " " * 100, "\n" * 90, "12345 678,90 " * 20,
    "ab" * 20 + " " * 40 + "cd" * 40 + "!" * 50 + "e'", "<|endoftext|>" * 5, "\x00​﻿" * 30, "word " * 400, "'s" * 60, "日本語" * 60 + "'re", "ẞ\U00010ee7\U00016ea7 " * 20, "🏳️‍🌈" * 40,
]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (7, 7), (50, 3), (1 << 15, 512)])
def test_bpe_is_the_library_s(spark, chunk, overlap):
    rnd = random.Random(chunk)
    bits = ["a", "b", " ", "  ", "\n", "1", "22", "'", "'s", "'ll", "é", "漢", ".", "!?", "\t", " ", "Zz", "😀"]
    texts = TEXTS + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(5, 200))) for _ in range(150)] + [TEXTS[14]] * 5
    rows = [(i if i % 10 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("k", F.lit("clash")).repartition(3)
    encoding = bpe.codec(bpe.default_ranks())
    tokens = bpe.encode(df, chunk=chunk, overlap=overlap).cache()
    got = bpe.digests(tokens).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert Counter(map(tuple, got)) == Counter(want)
    whole = bpe.decode(tokens).toPandas().sort_values("part")
    back = Counter(b"".join(g["bytes"]).decode() for _, g in whole.groupby(whole["row"].fillna(-1 - whole.index.to_series())))
    assert back == Counter(t or "" for _, t in rows)
    tokens.unpersist()


def test_bpe_edges(spark):
    assert bpe.digests(bpe.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    space = " " * 120_000 + "a"
    encoding = bpe.codec(bpe.default_ranks())
    assert bpe.ids_of(space, encoding) == encoding.encode_ordinary(" " * 119_999) + encoding.encode_ordinary(" a")
    rows = bpe.digests(bpe.encode(spark.createDataFrame([(1, "many words, " * 30_000), (2, space)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(encoding.encode_ordinary("many words, " * 30_000)), len(bpe.ids_of(space, encoding))]
    with pytest.raises(ValueError):
        bpe.chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 4, 5)


def test_given_tables(spark, sf_dir):
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = bpe.op13_overlap_bpe(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    encoding = bpe.codec(bpe.default_ranks())
    ids = [encoding.encode_ordinary(t) for t in texts.sort_values("doc_id")["text"]]
    assert got["n_tokens"].tolist() == [len(i) for i in ids] and got["ids_sha256"].tolist() == [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]
