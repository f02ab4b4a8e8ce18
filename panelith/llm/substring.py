"""Repeated spans across documents: token k-mers as edges of a De Bruijn graph, compacted by joins and verified by source coordinates.

An edge is a window of words, from the node of its words but the last to the node of its words but the first. Only edges that occur
twice are in the graph. Edges that meet in a node with one edge in and one out, and whose first occurrences are neighbours, are one path. A text's
repeated windows are walks along paths; the words of each walk are compared with those at its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelith.llm._common import forget_since, mark, materialise, ship, table
from panelith.llm._words import Words, slices
from panelith.llm.neardup import id_start, text_id

WINDOW = 20
ANCHOR = 8  # words of an anchor; each window holds WINDOW - ANCHOR + 1 candidates for its own
#: Up to so many ids of texts that are wanted go to all executors, so that other texts aren't shuffled; beyond that all are.
BROADCAST_IDS = 500_000
#: A place is one number: a text's rank and, in this many bits, a word of it. So places are compared and aggregated as numbers.
AT_BITS = 31
SPANS = "rank long, at int, n int, times int, source long, source_at int"
SPANS_TO_REMOVE = "array<struct<at:int,n:int,times:int,digest:long>>"


def anchors(words: Words, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, anchors, hashes): the first words of all windows, and for each the place and the hash of its anchor.

    The anchor of a window is its run of `size` words with the least hash, the leftmost of equal ones: equal windows
    have equal anchors at equal distances, and neighbours mostly share one.
    """
    at = words.runs(window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    small = words.runs(size)
    h = np.full(len(words.hash), np.uint64(2**64 - 1))
    h[small] = words.combine(tuple(range(size)), small, 99)
    wide = np.lib.stride_tricks.sliding_window_view(h, window - size + 1)
    place = at + wide[at].argmin(1)
    return at, place, h[place]


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text), without null texts."""
    return docs.filter("text is not null").select(text_id(F.col("text")).alias("id"), "doc_id", "text")


def _firsts(docs: DataFrame) -> DataFrame:
    """(id, doc_id, many) of each distinct text: the smallest doc_id that has it (null is the smallest), and whether others have it too. By numbers only, which are aggregated in hash tables."""
    known, rows = F.count("doc_id"), F.count(F.lit(1))
    many = (F.min("doc_id") != F.max("doc_id")) | ((known > 0) & (known < rows))
    return _keyed(docs).select("id", "doc_id").groupBy("id").agg(F.when(known == rows, F.min("doc_id")).alias("doc_id"), F.coalesce(many, F.lit(False)).alias("many"))


def _repeated_anchors(docs: DataFrame, window: int, size: int) -> DataFrame:
    """(t, at) of the anchors that are at more than one place of the distinct texts; t: the first half of a text's id. Anchors and texts go by 64 bits here: one place too many only costs time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1)):
                w = Words(b.column(1).slice(at, n), False)
                _, place, h = anchors(w, window, size)
                place, first = np.unique(place, return_index=True)
                row = w.row[place]
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), b.column(0).slice(at, n).take(pa.array(row)), pa.array((place - w.first[row]).astype(np.int32))], names=["anchor", "t", "at"])

    rows = materialise(_keyed(docs).select(id_start(F.col("id")).alias("t"), "text").mapInArrow(run, "anchor long, t long, at int"), "places")
    place = F.xxhash64("t", "at")  # the same for copies of a text
    many = materialise(rows.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("z")).filter("a != z").select("anchor"), "anchors")
    return rows.join(many.hint("shuffle_hash"), "anchor").select("t", "at")  # many has an anchor once: it is hashed, and rows needn't be sorted


def _windows(texts: DataFrame, window: int, size: int) -> DataFrame:
    """(p, s, place): an edge, by the hashes of the nodes that it leads from and to, and the place of each window of texts (rank, text, places) whose anchor is one of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1)):
                part = b.slice(at, n)
                w = Words(part.column(1), False)
                first, place, _ = anchors(w, window, size)
                own = part.column(2)
                row = np.repeat(np.arange(n), own.value_lengths().to_numpy(zero_copy_only=False))
                wanted = own.flatten().to_numpy() + w.first[row]
                first = first[np.isin(place, wanted)]
                row = w.row[first]
                node = np.zeros(len(w.hash), np.uint64)
                used = np.unique(np.concatenate((first, first + 1)))
                node[used] = w.combine(tuple(range(window - 1)), used, 1)
                node = node.view(np.int64)
                begins = (part.column(0).to_numpy() << AT_BITS) - w.first[:-1]
                for lo in range(0, len(first), 1 << 16):
                    cut = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(node[first[cut]]), pa.array(node[first[cut] + 1]), pa.array(first[cut] + begins[row[cut]])], names=["p", "s", "place"])

    return texts.mapInArrow(run, "p long, s long, place long")


def _ranked(known: DataFrame) -> DataFrame:
    """known, materialised, with rank: 0, 1, ... by doc_id (null first) and tie. Sorted in ranges; the driver gets the number of rows of each range."""
    rows = materialise(known.orderBy("doc_id", "tie").withColumn("_m", F.monotonically_increasing_id()), "known")
    part = F.shiftright("_m", 33)
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins = np.concatenate(([0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]))).tolist()
    return rows.withColumn("rank", F.lit(begins).cast("array<long>")[part.cast("int")] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def _going_on(edges: DataFrame, text: list[str], at: str) -> DataFrame:
    """edges (p, s, ...), each distinct edge with its first occurrence (the columns text, none null, and at), with on: whether it goes on with a nonbranching path.

    An edge goes on with the path of another if they meet in a node that no other edge leads to or from, and if its source follows
    the other's. Edges meet by node in one aggregation. A node from which one edge leads is met by one edge when the nodes are joined back.
    """
    place = [*text, at]
    of = lambda side: [F.col(c).alias(f"{side}_{c}") for c in place]
    none = lambda side: [F.lit(None).cast(edges.schema[c].dataType).alias(f"{side}_{c}") for c in place]
    ends = edges.select(F.col("s").alias("node"), *of("i"), *none("o")).unionAll(edges.select("p", *none("i"), *of("o")))
    # Where one edge comes and one goes, the greatest of each number is its own; numbers are aggregated in hash tables, structs by sorting.
    nodes = ends.groupBy("node").agg(F.count(f"i_{at}").alias("n_in"), F.count(f"o_{at}").alias("n_out"), *[F.max(f"{side}_{c}").alias(f"{side}_{c}") for side in "io" for c in place])
    follows = F.col(f"i_{at}") + 1 == F.col(f"o_{at}")
    for c in text:
        follows = follows & (F.col(f"i_{c}") == F.col(f"o_{c}"))
    goes_on = nodes.filter((F.col("n_in") == 1) & (F.col("n_out") == 1) & follows).select("node", F.lit(True).alias("on"))
    return edges.join(goes_on.hint("shuffle_hash"), F.col("p") == F.col("node"), "left").drop("node").withColumn("on", F.coalesce("on", F.lit(False)))


def _compacted(edges: DataFrame) -> DataFrame:
    """edges (p, s, source_doc, source_tie, source_at), each distinct edge with its first occurrence, with head: where its nonbranching path begins in the source. See _going_on()."""
    place = {"k": F.col("source_doc").isNotNull(), "d": F.coalesce("source_doc", F.lit(0).cast("long")), "x": F.col("source_tie"), "at": F.col("source_at")}
    joined = _going_on(edges.withColumns(place), ["k", "d", "x"], "at")
    before = Window.partitionBy("k", "d", "x").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a text's own edges
    return joined.withColumn("head", F.last(F.when(~F.col("on"), F.col("at")), ignorenulls=True).over(before)).drop("k", "d", "x", "at", "on")


def repeated_spans(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, firsts: DataFrame | None = None) -> DataFrame:
    """(id, doc_id, spans) of each distinct text (id: see text_id; doc_id: the smallest that has it) with words that repeat an earlier place.

    A window is repeated if the same words start earlier: in a smaller doc_id (null is the smallest; of equal doc_ids, by tie, half
    of the text's id), or earlier in the document. spans: (at, n, times, source_doc, source_tie, source_at, digest), n neighbouring windows each, whose first occurrences
    are neighbours too and lie on one nonbranching path, and which a text that repeats itself walks so many times in a row; digest: of the words at the source.
    Long stretches may be in several spans, one after the other. firsts: see _firsts(), if they are known.

    Anchors that are unique in the corpus rule out most windows with narrow rows; the rest is counted by edges, with the first
    occurrence found by partial aggregation; distinct edges are compacted to paths, and joined back. Copies of a text are left out first, so a hot text is one text.
    """
    ship(docs.sparkSession)
    since = mark(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    firsts = _firsts(docs) if firsts is None else firsts
    places = _repeated_anchors(docs, window, size).groupBy("t").agg(F.collect_set("at").alias("places"))
    tie = id_start(F.col("id"))
    known = firsts.select("id", "doc_id", tie.alias("t"), tie.alias("tie")).join(places, "t").select("id", "doc_id", "tie", "places")
    known = _ranked(known)
    forget_since(since, known)
    edges = _windows(_texts_of(docs, known.select("id", "doc_id", "rank", "places")).select("rank", "text", "places"), window, size)
    edges = materialise(edges, "windows")  # read twice
    distinct = edges.groupBy("p", "s").agg(F.min("place").alias("source"), F.max("place").alias("last")).filter("source != last")
    distinct = materialise(distinct.select("p", "s", "source"), "edges")
    paths = materialise(_going_on(distinct, [], "source"), "paths")
    again = edges.join(paths.hint("shuffle_hash"), ["p", "s"]).filter("place != source").select("place", "source", "on")
    walks = again.repartition(F.shiftright("place", AT_BITS)).sortWithinPartitions("place").mapInArrow(_walks, SPANS)
    spans = materialise(walks, "walks")
    out = materialise(_with_digests(docs, known, spans, window), "spans")
    forget_since(since, out)
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, doc_id, ...) with the text of each. Few wanted ids are sent ahead, and texts that aren't among them stay where they are."""
    texts = _keyed(docs)
    own = wanted.withColumnsRenamed({"id": "own_id", "doc_id": "own_doc"})
    same = (F.col("id") == F.col("own_id")) & F.col("doc_id").eqNullSafe(F.col("own_doc"))
    if wanted.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(own.select("own_id", "own_doc")), same, "left_semi")
    return texts.join(own, same).drop("own_id", "own_doc")


def _digest(words: Words, data: bytes, at: int, n: int) -> int:
    """A digest of n words as they are."""
    return xxhash.xxh3_64_intdigest(b" ".join([data[s:e] for s, e in zip(words.start[at : at + n].tolist(), words.end[at : at + n].tolist(), strict=True)])) - (1 << 63)


def _with_digests(docs: DataFrame, known: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(id, doc_id, spans) of the texts of spans (rank, at, n, times, source, source_at), with the digest of the words at each span's source, from the source's text."""
    rows = spans
    asked = rows.groupBy("source").agg(F.collect_set(F.struct("source_at", "n")).alias("asked"))
    asked = asked.join(known.select("id", "doc_id", "tie", F.col("rank").alias("source")), "source").select("id", "doc_id", "tie", "source", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("source_at", pa.int32()), ("n", pa.int32()), ("digest", pa.int64())]))
        for b in batches:
            for at, n in slices(b.column(3)):
                part = b.slice(at, n)
                w = Words(part.column(3), False)
                data = w.data.tobytes()
                out = [[{"source_at": x["source_at"], "n": x["n"], "digest": _digest(w, data, int(f) + x["source_at"], x["n"] + window - 1)} for x in own] for f, own in zip(w.first[:-1], part.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, kind)], names=["d", "x", "r", "digests"])

    texts = _texts_of(docs, materialise(asked, "asked")).select("doc_id", "tie", "source", "text", "asked")
    digests = texts.mapInArrow(run, "d long, x long, r long, digests array<struct<source_at:int,n:int,digest:long>>")
    digests = digests.select(F.col("d").alias("source_doc"), F.col("x").alias("source_tie"), F.col("r").alias("source"), F.explode("digests").alias("g")).select("source_doc", "source_tie", "source", "g.*")
    met = rows.join(digests, ["source", "source_at", "n"])
    span = F.struct("at", "n", "times", "source_doc", "source_tie", "source_at", "digest")
    return met.groupBy("rank").agg(F.array_sort(F.collect_list(span)).alias("spans")).join(known.select("id", "doc_id", "rank"), "rank").select("id", "doc_id", "spans")


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated edges (place, source, on), in order of their places, as walks along paths. A walk is cut where a batch ends. Repeated rows of a document give the same edges, which count once."""
    word, last = (1 << AT_BITS) - 1, -1
    for b in batches:
        place, source, on = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        other = np.diff(place, prepend=last) != 0
        place, source, on = place[other], source[other], on[other]
        if not len(place):
            continue
        last = place[-1]
        text = place >> AT_BITS
        new = np.ones(len(place), bool)
        new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1] + 1) | ~on[1:]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(place))).astype(np.int32)
        # A text that repeats itself walks the same stretch again and again: one span.
        same = np.zeros(len(first), bool)
        same[1:] = (text[first][1:] == text[first][:-1]) & (place[first][1:] == place[first][:-1] + count[:-1]) & (source[first][1:] == source[first][:-1]) & (count[1:] == count[:-1])
        units = np.flatnonzero(~same)
        times = np.diff(np.append(units, len(first))).astype(np.int32)
        first, count = first[units], count[units]
        columns = [text[first], (place[first] & word).astype(np.int32), count, times, source[first] >> AT_BITS, (source[first] & word).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rank", "at", "n", "times", "source", "source_at"])


def deduplicate(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs (doc_id, text): words that no repeated window covers, joined by one space.

    A span counts only if its words have the digest of those at its source.

    Words are what lies between ASCII white space, unchanged. A null or empty text has no words. A row whose text
    a smaller doc_id has too loses all words if they are at least `window`, else none. Rows with equal doc_id and text are one
    document, and are all kept alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    since = mark(docs.sparkSession)
    firsts = materialise(_firsts(docs), "firsts")
    spans = repeated_spans(docs, window, size, firsts).select("id", "spans")
    bare = F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["times"].alias("times"), s["digest"].alias("digest")))
    # A text that only one document has has no copies.
    copy = F.coalesce(F.col("copies") & ~F.col("doc_id").eqNullSafe(F.col("first")), F.lit(False))
    copies = firsts.filter("many").select("id", F.col("doc_id").alias("first"), F.lit(True).alias("copies"))
    marks = materialise(copies.join(spans.select("id", bare.alias("spans")), "id", "full"), "marks")
    forget_since(since, marks)
    rows = docs.withColumn("id", text_id(F.col("text")))
    wanted = marks.select("id")
    if wanted.count() <= BROADCAST_IDS:  # texts without marks stay where they are
        plain = rows.join(F.broadcast(wanted), "id", "left_anti").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(SPANS_TO_REMOVE).alias("spans"))
        rows = rows.join(F.broadcast(wanted), "id", "left_semi").join(marks, "id").select("doc_id", "text", copy.alias("copy"), "spans").unionAll(plain)
    else:
        rows = rows.join(marks, "id", "left").select("doc_id", "text", copy.alias("copy"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n in slices(b.column(1)):
                part = b.slice(i, n)
                w = Words(part.column(1), False)
                size_of = np.diff(w.first)
                gone = np.zeros(len(w.start) + 1, np.int64)
                spans = part.column(3)
                flat = spans.flatten()
                row = np.repeat(np.arange(len(part)), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                data = w.data.tobytes() if len(flat) else b""
                lo, n, times = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n", "times"))
                lo += w.first[row]
                hi = lo + n * times + window - 1
                same = [_digest(w, data, a, m + window - 1) == x and (k == 1 or np.array_equal(w.hash[a + m : z], w.hash[a : z - m])) for a, z, m, k, x in zip(lo.tolist(), hi.tolist(), n.tolist(), times.tolist(), flat.field("digest").to_pylist(), strict=True)]
                np.add.at(gone, lo[same], 1)
                np.add.at(gone, hi[same], -1)
                whole = part.column(2).to_numpy(zero_copy_only=False).astype(bool) & (size_of >= window)
                keep = (np.cumsum(gone[:-1]) == 0) & ~whole[w.row]
                removed = size_of - np.add.reduceat(np.append(keep, False).astype(np.int64), w.first[:-1]) * (size_of > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size_of.astype(np.int64)), pa.array(removed.astype(np.int64)), w.joined(keep)], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op10_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
