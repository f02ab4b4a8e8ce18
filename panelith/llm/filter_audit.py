"""Which filters remove what, alone and in every order: counts from a histogram of failure masks."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelith.llm._common import table

WORD = r"[^\x20\x09-\x0D]+"
#: The filters' letters; the mask's bit i is that of letter i. The last one is told by groups of equal texts, not by a text alone.
NAMES = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def failures(text: Column, words: Column) -> list[Column]:
    """Failure conditions of filters A to D: few words, repeated words (percent), capitals (percent of code points), symbols.

    A text without words fails A alone.
    """
    n = F.size(words).cast("long")
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of documents: narrow rows, all that is shuffled. mask has the bits of A to D; equal texts have equal digests (SHA-256).

    A null text is the empty one, a null language the part ''; doc_id may be null or repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures(F.col("text"), F.col("words")))]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part have each mask, and how many of them are labelled quality 1 or toxic 1; at most 32 rows a part.

    E fails for rows whose text a row with a smaller doc_id has, anywhere in the table. Texts are grouped by their digests, first with parts and labels, so
    that a group of copies shrinks to a few rows before it is shuffled; of such a row, all documents but those with the group's least doc_id fail.
    A row without doc_id neither fails E nor makes others fail. Of several labels of a document, one is enough. Empty tables give none.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = masked(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    runs = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"))
    least = F.min("first").over(Window.partitionBy("digest"))
    runs = runs.withColumn("passing", F.when(F.col("first") == least, F.col("at_first")).otherwise(0) + F.col("unnumbered"))
    both = F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << (len(NAMES) - 1))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("c")
    out = runs.select("part", "good", "toxic", both).filter("c.n > 0")
    n = F.col("c.n")
    labelled = lambda c: F.sum(F.when(F.col(c), n).otherwise(0)).alias(c)
    return out.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), labelled("good"), labelled("toxic"))


def interactions(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of all filters and step, zeros included, from cells (part, mask, n, good, toxic). len(names) letters, 6 at most (720 orders).

    kept: documents after the step; removed: by the step's filter; redundant: failing it, but removed before; unique_fails: failing it alone;
    good_lost, toxic_lost: removed ones with that label; shapley: what the filter removes, summed over all orders.
    A part's cells meet in one row of at most 2^len(names) entries, which each order and step reads.
    """
    if not 1 <= len(names) <= 6:
        raise ValueError("1 to 6 filters")
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for i, f in enumerate(order):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": i + 1, "before": before, "bit": 1 << f})
            before |= 1 << f
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, bit int>>")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(plan).alias("s")).select("part", "cells", "s.*")
    before, bit, zero = F.col("before"), F.col("bit"), F.lit(0).cast("long")

    def total(what: str, where) -> Column:
        return F.aggregate(F.filter("cells", where), zero, lambda s, c: s + c[what])

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    own = lambda c: fails(c) & ~gone(c)
    # A document that fails k filters goes to each of them in the same share of all orders.
    share = lambda c: c["n"] * (F.lit(factorial(len(names))) / F.bit_count(c["mask"])).cast("long")
    shares = F.aggregate(F.filter("cells", fails), zero, lambda s, c: s + share(c))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part have each mask, and how many of them are labelled quality 1 or toxic 1; at most 32 rows a part.

    E fails for rows whose text a row with a smaller doc_id has, anywhere in the table. Texts are grouped by their digests, first with parts and labels, so
    that a group of copies shrinks to a few rows before it is shuffled; of such a row, all documents but those with the group's least doc_id fail.
    A row without doc_id neither fails E nor makes others fail. Of several labels of a document, one is enough. Empty tables give none.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = masked(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    runs = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"))
    least = F.min("first").over(Window.partitionBy("digest"))
    runs = runs.withColumn("passing", F.when(F.col("first") == least, F.col("at_first")).otherwise(0) + F.col("unnumbered"))
    both = F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << (len(NAMES) - 1))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("c")
    out = runs.select("part", "good", "toxic", both).filter("c.n > 0")
    n = F.col("c.n")
    labelled = lambda c: F.sum(F.when(F.col(c), n).otherwise(0)).alias(c)
    return out.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), labelled("good"), labelled("toxic"))


def interactions(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of all filters and step, zeros included, from cells (part, mask, n, good, toxic). len(names) letters, 6 at most (720 orders).

    kept: documents after the step; removed: by the step's filter; redundant: failing it, but removed before; unique_fails: failing it alone;
    good_lost, toxic_lost: removed ones with that label; shapley: what the filter removes, summed over all orders.
    A part's cells meet in one row of at most 2^len(names) entries, which each order and step reads.
    """
    if not 1 <= len(names) <= 6:
        raise ValueError("1 to 6 filters")
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for i, f in enumerate(order):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": i + 1, "before": before, "bit": 1 << f})
            before |= 1 << f
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, bit int>>")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(plan).alias("s")).select("part", "cells", "s.*")
    before, bit, zero = F.col("before"), F.col("bit"), F.lit(0).cast("long")

    def total(what: str, where) -> Column:
        return F.aggregate(F.filter("cells", where), zero, lambda s, c: s + c[what])

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    own = lambda c: fails(c) & ~gone(c)
    # A document that fails k filters goes to each of them in the same share of all orders.
    shares = F.aggregate(F.filter("cells", fails), zero, lambda s, c: s + c["n"] * F.expr(f"{factorial(len(names))}L") / F.bit_count(c["mask"])) if False else F.aggregate(F.filter("cells", fails), zero, lambda s, c: s + (c["n"] * factorial(len(names)) / F.bit_count(c["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda c: ~fails(c) & ~gone(c)).alias("kept"), total("n", own).alias("removed"), total("n", lambda c: fails(c) & gone(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == bit).alias("unique_fails"), total("good", own).alias("good_lost"), total("toxic", own).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of documents (doc_id, text, lang) and labels (doc_id, quality, toxic); other columns don't matter."""
    return interactions(cells(docs, labels))


def op11_mask_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
