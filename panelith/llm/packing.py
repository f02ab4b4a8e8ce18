"""Best-fit packing of token pieces with matching of large items."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import materialise, number_rows, ship, table

CAPACITY = 2048
END_ID = 0
#: The added token of byte_bpe_50k.json, which that tokenizer takes out of texts before it splits them.
ADDED = ("<|endoftext|>", 50256)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """encode_ordinary of the byte-level BPE whose ranks are in `path`, once per worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[path]


def ids_of(text: str, encode) -> list[int]:
    """The tokenizer's ids of a text: those of the parts between added tokens, and the added tokens' own."""
    mark, own = ADDED
    first, *rest = text.split(mark)
    ids = encode(first)
    for part in rest:
        ids.append(own)
        ids += encode(part)
    return ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *((s, capacity) for s in range(head, n, capacity))]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenise(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: (doc_id, piece, start, length, ids_crc32), with keep_ids also ids (uint32, little-endian).

    The ids are those of the tokenizer in byte_bpe_50k.json, which shares its vocabulary and merge order
    with the ranks file; then END_ID. A null text counts as empty: one piece of one id.
    The added token's string in a text is that token, as by the tokenizer's default.
    """
    ship(docs.sparkSession)
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows: list[tuple] = []
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*ids_of(text or "", encode), END_ID], dtype="<u4").tobytes()
                    for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * s : 4 * (s + n)]
                        rows.append((doc, i, s, n, zlib.crc32(own), own))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                keep = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds, strict=False)], names=list(names[:keep]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Segments (length, first rank, first sequence, offset), sorted by length and rank, for counts of lengths.

    Works on runs of like bins, so its cost and its result depend on the capacity, not on how many
    items there are. Items above a third of the capacity come first: the largest is matched with the
    largest that still fits beside it, two a bin at most. The rest, longest first, go to the
    fullest bins that take them; what is left opens bins of its own.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, bins)
    order: list[int] = []  # the free spaces that have runs
    bins = 0

    def put(n: int, first: int, many: int, offset: int) -> None:
        segments.append((n, used[n], first, offset))
        used[n] += many
        left[n] -= many

    def free(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in gaps:
                gaps[space] = []
                insort(order, space)
            gaps[space].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and left[large[at]] < (2 if large[at] == n else 1):
            at -= 1
        if at < 0:
            many = left[n]
            put(n, bins, many, 0)
            free(capacity - n, bins, many)
        else:
            other = large[at]
            many = left[n] // 2 if other == n else min(left[n], left[other])
            put(n, bins, many, 0)
            put(other, bins, many, n)
            free(capacity - n - other, bins, many)
        bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at < len(order):
                space = order[at]
                first, many = gaps[space].pop()
                if not gaps[space]:
                    del gaps[space]
                    order.pop(at)
            else:
                space, first, many = capacity, bins, -(-left[n] // (capacity // n))
                bins += many
            each = min(space // n, -(-left[n] // many)) if left[n] >= many else 1
            full = min(many, left[n] // each)  # bins of this run that take `each` items
            for i in range(each):
                put(n, first, full, capacity - space + i * n)
            free(space - each * n, first, full)
            free(space, first + full, many - full)
    out = np.array(segments, dtype=np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length in 1..capacity) with sequence_id and offset; offsets are gapless from 0 in each sequence.

    Reads pieces more than once: pass a table. The driver gets one count a length. Equal rows are
    interchangeable and each is placed; an empty table gives an empty one; nulls in other columns are kept.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seg = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((seg[:, 0] << 48) + seg[:, 1], (n << 48) + r, "right") - 1
        return pd.DataFrame({"sequence_id": seg[at, 2] + r - seg[at, 1], "offset": seg[at, 3]})

    ranked = number_rows(pieces.drop("sequence_id", "offset"), ("length",), out="rank within length", rows=sum(counts.values()))
    own = [F.col(f"`{c}`") for c in ranked.columns[:-1]]
    return ranked.select(*own, place("length", "`rank within length`").alias("place of the piece")).select(*own, "`place of the piece`.*")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialise(tokenise(table(spark, sf_dir, "documents")), "pieces"))
