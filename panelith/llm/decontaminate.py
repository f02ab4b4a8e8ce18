"""Benchmark decontamination by spaced seeds: hashes that pass over some word positions find overlaps despite substitutions."""

from __future__ import annotations

from collections.abc import Container, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import bloom, filter_bits, in_bloom, materialise, ship, spread_join, table
from panelith.llm._words import Words, slices

#: Fixed masks: 1 takes a word, 0 passes over it. Each stretch of MIN_OVERLAP words or more with MIN_EQUAL equal words holds a seed of one
#: of them: one that has no shorter such stretch in it has 12, 15 or 20 words with 2, 3 or 4 unequal ones, and a test enumerates all of those.
MASKS = ("1110111", "11010010011", "110100001011")
MIN_OVERLAP = 12
MIN_EQUAL = 0.8
#: Up to so many seeds and so many bytes of items the benchmark goes to all executors; beyond that both sides are shuffled.
BROADCAST_SEEDS, BROADCAST_BYTES = 500_000, 32 << 20


def offsets(masks: tuple[str, ...] = MASKS) -> list[tuple[int, ...]]:
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in masks]


def whole_item(n: int, equal: float = MIN_EQUAL) -> list[tuple[int, ...]]:
    """The words taken by the masks for a whole item of n words: whichever may be unequal, one of the masks passes over them.

    The item is cut into blocks (words, if a mask would take few), and each mask leaves out as many as there may be unequal words.
    """
    unequal = int(n * (1 - Fraction(equal).limit_denominator(10**6)))
    blocks = np.array_split(np.arange(n), n if n - unequal <= 4 else unequal + 2)
    return [tuple(int(i) for k, own in enumerate(blocks) if k not in out for i in own) for out in combinations(range(len(blocks)), unequal)]


def seeds(words: Words, masks: tuple[str, ...], equal: float, which: np.ndarray | None = None, only: Container[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, first words, hashes) for each mask, then for those of whole items of 1 word up to MIN_OVERLAP - 1. Under five words all must be equal.

    which: rows to which whole-item masks are kept (benchmark items); None: all rows (documents). only: the masks that are wanted; None: all.
    """
    every = [(len(m), own, False) for m, own in zip(masks, offsets(masks), strict=True)]
    every += [(n, own, True) for n in range(1, MIN_OVERLAP) for own in whole_item(n, equal)]
    size = np.diff(words.first)
    for m, (n, own, whole) in enumerate(every):
        if only is not None and m not in only:
            continue
        at = words.runs(n)
        if whole and which is not None:
            at = at[size[words.row[at]] == n]
        yield m, at, words.combine(own, at, m)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, equal: float = MIN_EQUAL) -> tuple[int, int, int, int]:
    """(start in doc, start in item, words, equal words) of the longest segment with that share of equal words in which item[i] faces doc[i + diagonal].

    With whole numbers as scores, a segment has the share if its sum isn't negative. Of equally long ones the first is taken.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    share = Fraction(equal).limit_denominator(10**6)
    score = np.concatenate(([0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))))
    later = np.maximum.accumulate(score[::-1])[::-1]  # the greatest sum from here on: never rises
    ends = np.searchsorted(-later, -score, "right") - 1
    start = int(np.argmax(ends - np.arange(len(score))))
    end = int(ends[start])
    return lo + start + diagonal, lo + start, end - start, int(same[start:end].sum())


def _items(benchmark: DataFrame, masks: tuple[str, ...], equal: float) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words) and (hash, mask, item, item_at) of the benchmark."""

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(2)):
                w = Words(b.column(2).slice(at, n), True)
                own = [w.hash[a:z].tobytes() for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(own, pa.binary())], names=["item", "item_id", "words"])

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1)):
                w = Words(b.column(1).slice(at, n), True)
                item = b.column(0).slice(at, n).to_numpy()
                for m, first, h in seeds(w, masks, equal, np.arange(n)):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), m, np.int32)), pa.array(item[w.row[first]]), pa.array((first - w.first[w.row[first]]).astype(np.int32))], names=["hash", "mask", "item", "item_at"])

    rows = materialise(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "items")
    return materialise(rows.mapInArrow(word_rows, "item long, item_id long, words binary"), "item-words"), rows.select("item", "text").mapInArrow(seed_rows, "hash long, mask int, item long, item_at int")


def diagonals(shared: list[dict], n_doc: int, n_item: int) -> list[int]:
    """The differences of the places that a document and an item have of the seeds they share, in order. A seed's places are marked one row of differences at a time, so a text that repeats a word costs no memory for its pairs."""
    found = np.zeros(n_doc + n_item + 1, bool)
    for s in shared:
        a, b = np.array(s["ats"], np.int64), np.array(s["item_ats"], np.int64)
        if len(a) < len(b):
            for x in a:
                found[x - b + n_item] = True
        else:
            for y in b:
                found[a - y + n_item] = True
    return (np.flatnonzero(found) - n_item).tolist()


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_overlap: int = MIN_OVERLAP, equal: float = MIN_EQUAL) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_equal): the longest overlap of each document and item.

    Words are split at ASCII white space and compared in lower case. A document and an item overlap if, with one shift between
    them, a stretch of at least min_overlap words (a shorter item: all of it) has a share of at least `equal` equal words, found
    around a place where the words that a mask takes are all equal; with the default values, each has such a place. So an item of under five words is found wherever its words stand in a row. Documents pass a
    filter first, whose size follows the number of seeds, and only those with a hit go on, with their words' hashes; then hashes, items and documents meet
    in joins: a benchmark within the broadcast bounds goes to the documents, a larger one is shuffled, with a hot seed's places and a hot item's pairs dealt over several tasks. Rows with null or empty text overlap nothing; repeated documents give repeated rows; null ids are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    items, item_seeds = _items(benchmark, masks, equal)
    item_seeds = materialise(item_seeds, "item-seeds")
    only = {r["mask"]: r["n"] for r in item_seeds.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()}  # documents needn't look for other masks
    n_seeds = sum(only.values())
    bits = filter_bits(n_seeds)
    filled = spark.sparkContext.broadcast(bloom(item_seeds, bits))
    schema = "doc_id long, words binary, hits array<struct<hash:long,mask:int,ats:array<int>>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1)):
                w = Words(b.column(1).slice(at, n), True)
                got = []
                for m, first, h in seeds(w, masks, equal, only=only):
                    keep = in_bloom(filled.value, bits, h)
                    got.append((first[keep], h[keep], np.full(len(keep), m, np.int32)))
                if not got:
                    continue
                first, h, m = (np.concatenate(x) for x in zip(*got, strict=True))
                if not len(first):
                    continue
                order = np.lexsort((first, h, m, w.row[first]))  # places of one seed in one document come together
                first, h, m = first[order], h[order], m[order]
                row = w.row[first]
                starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (m[1:] != m[:-1]) | (h[1:] != h[:-1]))))
                ats = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array((first - w.first[row]).astype(np.int32)))
                hits = pa.StructArray.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(m[starts]), ats], names=["hash", "mask", "ats"])
                rows, begins = np.unique(row[starts], return_index=True)
                ids = b.column(0).slice(at, n).take(pa.array(rows))
                words = [w.hash[w.first[r] : w.first[r + 1]].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.binary()), pa.ListArray.from_arrays(pa.array(np.append(begins, len(starts)).astype(np.int32)), hits)], names=["doc_id", "words", "hits"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(find, schema)
    hit = materialise(found.withColumn("row", F.monotonically_increasing_id()), "hits")
    single = hit.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    small = n_seeds <= BROADCAST_SEEDS and items.agg(F.coalesce(F.sum(F.length("words") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES
    seeds_of = item_seeds.groupBy("hash", "mask", "item").agg(F.collect_list("item_at").alias("item_ats"))
    met = single.join(F.broadcast(seeds_of), ["hash", "mask"]) if small else spread_join(single, seeds_of, ["hash", "mask"], "row")
    # A row for each document and item: the places of each seed that they share, as many as the two have words; their words come once.
    pairs = met.groupBy("row", "item").agg(F.collect_list(F.struct("ats", "item_ats")).alias("shared"))
    rows = (pairs.join(F.broadcast(items), "item") if small else spread_join(pairs, items, ["item"], "row")).join(hit.select("row", "doc_id", F.col("words").alias("doc_words")), "row").select("row", "doc_id", "item_id", "shared", "words", "doc_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = ["row", "doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for row, doc, item, shared, words, own in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    words, own = np.frombuffer(words, np.uint64), np.frombuffer(own, np.uint64)
                    for diagonal in diagonals(shared, len(own), len(words)):
                        got = overlap(own, words, diagonal, equal)
                        if got[2] >= min(min_overlap, len(words)):
                            out.append((row, doc, item, *got))
                cols = zip(*out, strict=True) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "row long, doc_id long, item_id long, doc_start int, item_start int, n_words int, n_equal int"
    found = rows.mapInArrow(verify, schema)
    best = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_equal"), F.struct("n_words", "n_equal", -F.col("doc_start"), -F.col("item_start"))).alias("best")
    return found.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
