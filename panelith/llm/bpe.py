"""Byte-level BPE: long texts are encoded in overlapping chunks that are stitched where their pre-tokens agree; decoding."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import materialise, ship, table

#: Characters of a chunk, and how many of the next chunk's it has too.
CHUNK, OVERLAP = 1 << 15, 512
#: How many characters beyond its end, at most, decide where a match of the pattern ends.
PEEK = 2
#: White space of this length overflows the stack of the library's pattern engine; such pieces are split by Python's.
LONG_SPACE = regex.compile(r"\s{50000}")
_old = unicodedata.ucd_3_2_0.category


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(4)
def codec(path: str, pattern: str | None = None) -> Any:
    """The encoding whose ranks are in `path`, without special tokens; once per worker. pattern: None is that of the public vocabularies."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str, encoding: Any) -> list[int]:
    if len(text) >= 50000 and LONG_SPACE.search(text):
        return encoding._encode_only_native_bpe(text)
    return encoding.encode_ordinary(text)


def boundaries(text: str, pattern: regex.Pattern, begin: int, end: int, whole: bool) -> list[int]:
    """Where pre-tokens of text start, within begin..end (exclusive); the text's own end is none. whole: nothing follows the text; else only those starts are given that no
    further text would change.

    Left out are starts where a text that ended there would be split otherwise before them (white space before a word), and those beside characters that Unicode 3.2
    didn't have: pattern engines may not agree on their classes.
    """
    out, last, before = [], len(text) - (0 if whole else PEEK), deque(maxlen=PEEK + 1)
    for m in pattern.finditer(text):
        at = m.start()
        if at > last or at >= end:
            break
        if at >= begin and all(_old(c) != "Cn" for c in text[max(at - 3, 0) : at + 1]) and all(pattern.match(text, s, at).end() == e for s, e in before if e >= at - PEEK):
            out.append(at)
        before.append(m.span())
    return out


def chunks(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, row, k, last, text) of documents longer than a chunk: characters k * chunk .. (k + 1) * chunk + overlap. row: a number for each row of docs, the same in all its chunks."""
    if not 0 < overlap <= chunk:
        raise ValueError("chunks must be at least as long as their overlap")
    rows = docs.filter(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                n = -(-len(text) // chunk)
                for lo in range(0, n, 64):
                    ks = range(lo, min(lo + 64, n))
                    same = lambda c: b.column(c).take(pa.array([i] * len(ks)))  # noqa: B023, E731
                    parts = [text[k * chunk : (k + 1) * chunk + overlap] for k in ks]
                    yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(list(ks), pa.int32()), pa.array([k == n - 1 for k in ks]), pa.array(parts, pa.string())], names=["doc_id", "row", "k", "last", "text"])

    return rows.mapInArrow(run, "doc_id long, row long, k int, last boolean, text string")


def stitched(parts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, pattern: str | None = None) -> DataFrame:
    """(row, k, lo, hi, left, right) of chunks: the characters lo..hi of its own text that each contributes.

    A chunk and the next are cut at the first pre-token that both see begin in what they share: from there on a match doesn't depend on where matching began.
    Where there is no such place (one run of letters is longer than the overlap), left and right say that the chunk's piece goes on in its neighbour.
    Only places are shuffled, by row and chunk, so that a long document is dealt over all tasks.
    """
    import public_tokenizers

    shape = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(shape)
        for b in batches:
            texts, last = b.column(3).to_pylist(), b.column(2).to_pylist()
            head = [boundaries(t, compiled, 0, overlap, z) for t, z in zip(texts, last, strict=True)]
            tail = [[] if z else [p - chunk for p in boundaries(t, compiled, chunk, chunk + overlap, False)] for t, z in zip(texts, last, strict=True)]
            size = pa.array([len(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), size, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["row", "k", "last", "size", "head", "tail"])

    found = parts.select("row", "k", "last", "text").mapInArrow(run, "row long, k int, last boolean, size int, head array<int>, tail array<int>")
    # Each chunk's row goes to the cut before it and to the cut after it.
    sides = found.select("row", "size", "last", F.explode(F.array(F.struct(F.col("k").alias("cut"), F.col("head").alias("head"), F.lit(None).cast("array<int>").alias("tail")), F.struct((F.col("k") + 1).alias("cut"), F.lit(None).cast("array<int>").alias("head"), F.col("tail").alias("tail")))).alias("c")).select("row", "size", "last", "c.*")
    side = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(c, "size", "last"))).alias(c)
    cuts = sides.groupBy("row", "cut").agg(side("head"), side("tail"))
    at = F.array_min(F.array_intersect("tail.tail", "head.head"))
    first, final = F.col("cut") == 0, F.col("head").isNull()
    cuts = cuts.select("row", "cut", F.when(first, 0).otherwise(at).alias("at"), F.col("tail.size").alias("size"), first.alias("first"), final.alias("final"))
    own = F.explode(F.array(F.struct(F.col("cut").alias("k"), F.lit(True).alias("begins")), F.struct((F.col("cut") - 1).alias("k"), F.lit(False).alias("begins")))).alias("s")
    ends = cuts.select("row", "at", "size", "final", own).select("row", "at", "size", "final", "s.*").filter("k >= 0 and not (begins and final)")
    begin, end = F.col("begins"), ~F.col("begins")
    out = ends.groupBy("row", "k").agg(
        F.max(F.when(begin, F.coalesce("at", F.lit(0)))).alias("lo"), F.max(F.when(end, F.when(F.col("final"), F.col("size")).otherwise(chunk + F.coalesce("at", F.lit(0))))).alias("hi"),
        F.bool_or(begin & F.col("at").isNull()).alias("left"), F.bool_or(end & ~F.col("final") & F.col("at").isNull()).alias("right"),
    )
    return out


IDS = "doc_id long, row long, part int, ids binary"


def _packed(doc: list, row: list, part: list, ids: Iterable[list[int]]) -> pa.RecordBatch:
    cols = [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(part, pa.int32()), pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "part", "ids"])


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, row, part, ids, whole) of documents (doc_id, text): the ids (uint32, little-endian) that the library gives for the whole text, without special tokens.

    A document within a chunk has one row, without `row` and with `whole`; longer ones have several, of one `row`, in the order of part. A null text is empty and has a row without ids;
    null and repeated doc_ids, repeated rows and other columns don't matter; an empty table gives none. Characters of one pre-token, however long, meet in one task: their merges depend on all of them.
    pattern: must not look more than PEEK characters beyond a match, and not before it.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = ranks or default_ranks()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(ranks, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                doc, row, part, text = (c.to_pylist() for c in b.slice(at, 256).columns)
                yield _packed(doc, row, part, [ids_of(t, encoding) for t in text])

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces that go over several chunks, whose texts come in order."""
        encoding, held = codec(ranks, pattern), []
        for b in batches:
            for doc, row, k, text, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((doc, row, k, text))
                if not right:
                    yield _packed([doc], [row], [held[0][2]], [ids_of("".join(h[3] for h in held), encoding)])
                    held = []

    nothing = F.lit(None).cast("long").alias("row")
    short = docs.filter(F.char_length("text") <= chunk).select("doc_id", nothing, F.lit(0).alias("part"), "text").mapInArrow(plain, IDS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise(chunks(docs, chunk, overlap).repartition(n, "row", "k"), "chunks")
    pieces = parts.drop("last").join(stitched(parts, chunk, overlap, pattern), ["row", "k"])
    piece = pieces.select("doc_id", "row", "k", F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("piece"), "left", "right")
    closed = piece.filter("not left and not right").select("doc_id", "row", F.col("k").alias("part"), F.col("piece").alias("text")).mapInArrow(plain, IDS)
    open_ = piece.filter("left or right").select("doc_id", "row", "k", "piece", "right").repartition(n, "row").sortWithinPartitions("row", "k").mapInArrow(fused, IDS)
    # Literals, so that a filter by them reads one side alone.
    return short.withColumn("whole", F.lit(True)).unionByName(closed.unionByName(open_).withColumn("whole", F.lit(False)))


def decode(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """tokens of encode() with bytes in the place of ids: a document's bytes are those of its parts in order. Parts may end within a character, as tokens do."""
    ship(tokens.sparkSession)
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(ranks)
        for b in batches:
            got = [encoding.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.binary())], names=["doc_id", "row", "part", "bytes"])

    return tokens.select("doc_id", "row", "part", "ids").mapInArrow(run, "doc_id long, row long, part int, bytes binary")


def digests(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s tokens: of the decimal ids joined by commas, and of the bytes they stand for.

    The parts of a document are read in order, one at a time, so a task holds one part whatever the document's length; documents in one part aren't shuffled.
    """
    spark = tokens.sparkSession
    ship(spark)
    ranks = ranks or default_ranks()
    names, ddl = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(ranks)
        now: tuple | None = None  # (row, doc_id)
        n, ids_hash, own_hash, out = 0, hashlib.sha256(), hashlib.sha256(), []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for doc, row, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if now is None or row is None or (row, doc) != now:
                    if now is not None:
                        out.append((now[1], n, ids_hash.hexdigest(), own_hash.hexdigest()))
                    now, n, ids_hash, own_hash = (row, doc), 0, hashlib.sha256(), hashlib.sha256()
                got = np.frombuffer(ids.as_buffer(), "<u4").tolist()
                if got:
                    ids_hash.update((("," if n else "") + ",".join(map(str, got))).encode())
                    own_hash.update(encoding.decode_bytes(got))
                    n += len(got)
            if out:
                yield batch()
                out = []
        if now is not None:
            out = [(now[1], n, ids_hash.hexdigest(), own_hash.hexdigest())]
            yield batch()

    short = tokens.filter("whole").select("doc_id", "row", "ids").mapInArrow(run, ddl)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = tokens.filter("not whole").repartition(n_parts, "row").sortWithinPartitions("row", "part").select("doc_id", "row", "ids").mapInArrow(run, ddl)
    return short.unionByName(long)


def op13_overlap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
