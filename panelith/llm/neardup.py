"""Near-duplicates by BagMinHash signatures of word-shingle multisets, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import bloom, filter_bits, forget_since, free_name, in_bloom, mark, materialise, ship, spread_join, table
from panelith.llm._words import Words, mix, slices

SHINGLE = 5
SIMILAR = 0.8
REGISTERS = 128
ROWS = 5  # registers in a band
BLOCKS = 128
STAR = 512  # pairs of a text beyond which they are dealt over several tasks
TURNS = 1  # times that large buckets are compared with further leaders before what is left is compared in full
SMALL = 16  # members of a bucket up to which pairs between its components are all compared


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each row's distinct runs of n words, by row and hash; all words of a row with fewer count as one run."""
    at = words.runs(n)
    h, row = words.combine(tuple(range(n)), at), words.row[at]
    size = np.diff(words.first)
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        h = np.concatenate((h, words.combine(tuple(range(k)), words.first[short], k)))
        row = np.concatenate((row, short))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(z: np.ndarray) -> np.ndarray:
    return ((z >> np.uint64(11)).astype(np.float64) + 1.0) / 2**53


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash of integer weights: for each row the earliest point of each of m registers; infinite for rows without elements.

    The axis of weights is cut at 1, 2, 4, 8, ...; each stretch of an element has a Poisson process whose rate is the stretch's length.
    A process brings its points in order of time, each with a register and a place on the axis, and only points
    below the element's weight count. So a register's first point is the same in two rows with the probability of their
    weighted Jaccard similarity. A process ends once its time is past all of its row's registers.
    """
    top = int(weight.max(initial=1)).bit_length() + (int(weight.max(initial=1)) & (int(weight.max(initial=1)) - 1) > 0) if len(weight) else 1
    parts = []
    for level in range(top + 1):
        low = 0 if level == 0 else 1 << (level - 1)
        own = np.flatnonzero(weight > low)
        if len(own):
            parts.append((own, np.full(len(own), level), np.full(len(own), low, np.float64), np.full(len(own), max(1, low), np.float64)))
    regs = np.full(rows * m, np.inf)
    if not parts:
        return regs.reshape(rows, m)
    own, level, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = mix(h[own] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    base, limit, most = row[own] * m, weight[own].astype(np.float64), np.full(rows, np.inf)
    time, r = np.zeros(len(own)), row[own]
    step = 0
    while len(seed):
        step += 1
        a = mix(seed + np.uint64(2 * step * 0x9E3779B97F4A7C15 % 2**64))
        b = mix(seed + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(_uniform(a)) / width
        good = low + width * _uniform(b) <= limit
        np.minimum.at(regs, (base + (b & np.uint64(m - 1)).astype(np.int64))[good], time[good])
        live = np.unique(r)
        most[live] = regs.reshape(rows, m)[live].max(1)
        keep = time < most[r]
        seed, base, limit, low, width, time, r = (x[keep] for x in (seed, base, limit, low, width, time, r))
    return regs.reshape(rows, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's registers."""
    n, m = sig.shape
    bits = sig[:, : m // rows * rows].view(np.uint64).reshape(n, m // rows, rows)
    h = np.arange(m // rows, dtype=np.uint64)[None, :] + np.zeros((n, 1), np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return h


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as sorted hashes and their counts."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum() if len(b[0]) else 0
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def text_id(text: Column) -> Column:
    """Equal texts, and only they, have equal ids."""
    return F.unhex(F.md5(text.cast("binary")))


def _fold_links(links: DataFrame) -> DataFrame:
    """(id, root) of all ids in links (a, b): the smallest id that is connected. By alternating large and small stars, each a join of narrow rows.

    One aggregation of the ids' neighbours tells whether another round is needed, serves its large star and is the result after the last, so a
    round has few shuffles: the driver keeps plans and figures of each task of each shuffle.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other")))))
        nodes = materialise(ends.groupBy("id").agg(F.min("other").alias("least"), F.max("other").alias("most")), "roots")
        # Done when each id that has a neighbour below it has no other one.
        if nodes.filter("least < id and least != most").isEmpty():
            return nodes.select("id", F.least("id", "least").alias("root"))
        large = edges.join(nodes.select(F.col("id").alias("v"), F.least("id", "least").alias("m")), "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) after further links (a, b). What was folded before goes in as its stars, so few rounds are left."""
    return _fold_links(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(links.select("a", "b")))


def _texts(docs: DataFrame) -> DataFrame:
    """(id, doc_id, bands, size) of each distinct text: the smallest doc_id, the bands (null if it has no words) and the number of shingles."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(2)):
                w = Words(b.column(2).slice(at, n), True)
                row, h, count = shingles(w)
                own = bands(signatures(row, h, count, n)).view(np.int64)
                count = np.diff(w.first)
                some = count > 0
                size = np.where(some, np.maximum(count - SHINGLE + 1, 1), 0).astype(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), flat.cast(kind), pa.array(size)], names=["id", "doc_id", "bands", "size"])

    rows = docs.filter("text is not null").select(text_id(F.col("text")).alias("id"), F.col("doc_id"), F.col("text"))
    signed = rows.mapInArrow(run, "id binary, doc_id long, bands array<long>, size long")
    return signed.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("bands", ignorenulls=True).alias("bands"), F.max("size").alias("size"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, h, n): the sorted shingle hashes and their counts (empty if all are 1) of each text in ids, and of few others.

    A filter, whose size follows the number of ids up to a bound, passes over texts that aren't wanted where they are read, so no text is shuffled.
    """
    bits = filter_bits(ids.count())
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(ids.select(id_start(F.col("id")).alias("hash")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = np.array([int.from_bytes(x[:8], "big") for x in b.column(0).to_pylist()], np.uint64)
            b = b.take(pa.array(in_bloom(wanted.value, bits, start)))
            for at, n in slices(b.column(1)):
                row, h, count = shingles(Words(b.column(1).slice(at, n), True))
                ends = np.searchsorted(row, np.arange(n + 1))
                cut = list(zip(ends[:-1], ends[1:], strict=True))
                counts = count.astype(np.uint32)
                cols = [pa.array([h[a:z].tobytes() for a, z in cut], pa.binary()), pa.array([b"" if (counts[a:z] == 1).all() else counts[a:z].tobytes() for a, z in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), *cols], names=["id", "h", "n"])

    rows = docs.filter("text is not null").select(text_id(F.col("text")).alias("id"), "text").mapInArrow(run, "id binary, h binary, n binary")
    return materialise(rows.groupBy("id").agg(F.first("h").alias("h"), F.first("n").alias("n")), "sets", by="id")


def _set(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(h, np.uint64)
    return hashes, np.frombuffer(n, np.uint32).astype(np.int64) if n else np.ones(len(hashes), np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those pairs (a, b) of text ids whose multisets' similarity is at least `similar`."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keep = [jaccard(_set(h1, n1), _set(h2, n2)) >= similar for h1, n1, h2, n2 in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("h").alias("h1"), F.col("n").alias("n1")), sets.select(F.col("id").alias("b"), F.col("h").alias("h2"), F.col("n").alias("n2"))
    # A text with many pairs: its pairs are dealt over several tasks, and its set goes to each of these.
    stars = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > STAR).select("a", F.ceil(F.col("k") / STAR).cast("int").alias("k")), "stars-of")
    if stars.isEmpty():
        met = pairs.join(left, "a")
    else:
        apart = materialise(pairs.join(stars, "a", "left"), "apart")
        few = apart.filter("k is null").select("a", "b").join(left, "a")
        many = apart.filter("k is not null").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"))
        heads = left.join(stars, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
        met = few.unionByName(many.join(heads, ["a", "part"]).drop("part"))
    return materialise(met.join(right, "b").select("a", "b", "h1", "n1", "h2", "n2").mapInArrow(check, "a binary, b binary"), "links")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, h, id, root, largest, members) of buckets whose members (band, h, id) are in several components; largest: the one with the most of them."""
    rooted = members.join(roots, "id", "left").select("band", "h", "id", F.coalesce("root", "id").alias("root"))
    sizes = rooted.groupBy("band", "h", "root").count()
    mixed = sizes.groupBy("band", "h").agg(F.count(F.lit(1)).alias("roots"), F.sum("count").alias("members"), F.max(F.struct("count", "root"))["root"].alias("largest")).filter("roots > 1").drop("roots")
    return spread_join(rooted, mixed, ["band", "h"], "id")


def _overlaps(x: str, y: str, similar: float) -> Column:
    """Whether the texts of two structs (size, shared, blocks) may be similar at all.

    Their overlap is at most what either shares with other components, and at most the sum over blocks of hashes of the smaller number of such shingles.
    """

    def near(both: Column) -> Column:
        return both >= similar * (F.col(f"{x}.size") + F.col(f"{y}.size") - both)

    blocks = F.aggregate(F.zip_with(f"{x}.blocks", f"{y}.blocks", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    return near(F.least(f"{x}.shared", f"{y}.shared")) & near(blocks)


def _across(rows: DataFrame, similar: float, bounded: bool) -> DataFrame:
    """Pairs (a, b) of members in different components of a bucket, one of them outside the largest. bounded: rows have facts (size, shared, blocks), and pairs that these rule out aren't made."""
    outside = rows.filter("root != largest").select("band", "h", F.col("id").alias("x"), F.col("root").alias("x_root"), *[F.col("facts").alias("x_facts")] * bounded)
    met = spread_join(rows, outside, ["band", "h"], "id", 4 if bounded else 1)
    met = met.filter((F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("largest")) | (F.col("x") < F.col("id"))))
    if bounded:
        met = met.filter(_overlaps("facts", "x_facts", similar))
    return met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))


def _stars(rows: DataFrame, turn: int, similar: float) -> DataFrame:
    """Pairs of some members of each bucket with all members of other components: first the member with the largest share of shared shingles, in later turns others by a hash."""
    own = F.struct("id", "root", "facts")
    turns = [F.struct(F.col("facts.shared") / F.col("facts.size"), "id")] if turn == 0 else [F.struct(F.xxhash64("id", F.lit(4 * turn + k)), "id") for k in range(4)]
    heads = rows.groupBy("band", "h").agg(*[F.max_by(own, t).alias(f"_{i}") for i, t in enumerate(turns)])
    heads = heads.select("band", "h", F.explode(F.array(*[f"_{i}" for i in range(len(turns))])).alias("_x")).withColumn("x_facts", F.col("_x.facts"))
    met = spread_join(rows, heads, ["band", "h"], "id").filter((F.col("root") != F.col("_x.root")) & _overlaps("facts", "x_facts", similar))
    return met.select(F.least("id", "_x.id").alias("a"), F.greatest("id", "_x.id").alias("b")).distinct()


def id_start(id_: Column) -> Column:
    """The first half of a text's id as a number."""
    return F.conv(F.hex(F.substring(id_, 1, 8)), 16, -10).cast("long")


def _spread(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(t, h, c): each shingle's hash and count of the texts in ids; t: see id_start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [_set(h, n) for h, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                size = [len(h) for h, _ in own]
                t = np.repeat(part.column(0).to_numpy(), size)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate([h for h, _ in own]).view(np.int64)), pa.array(np.concatenate([n for _, n in own]).astype(np.int32))], names=["t", "h", "c"])

    return sets.join(ids.select("id"), "id", "left_semi").select(id_start(F.col("id")), "h", "n").mapInArrow(run, "t long, h long, c int")


def _facts(spread: DataFrame, sized: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, facts): a struct of size, shared (how many shingles a text of another component has too) and blocks (these by a hash into BLOCKS)."""
    comp = sized.join(roots, "id", "left").select("id", "size", id_start(F.col("id")).alias("t"), F.coalesce("root", "id").alias("root"))
    rows = spread.join(comp.select("t", "root"), "t")
    common = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a != z").select("h")
    shared = rows.join(common, "h").groupBy("t", F.pmod("h", F.lit(BLOCKS)).cast("int").alias("k")).agg(F.sum("c").cast("int").alias("c"))
    shared = shared.groupBy("t").agg(F.sum("c").alias("shared"), F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    return comp.join(shared, "t", "left").select("id", F.struct("size", F.coalesce("shared", F.lit(0)).alias("shared"), blocks.alias("blocks")).alias("facts"))


def _hopeful(rows: DataFrame, facts: DataFrame, similar: float) -> DataFrame:
    """rows of buckets with facts, without those that can't be similar to any member of another component.

    A changed word gives shingles of its own, or its component's own. In a large group of changed copies this tells exactly which may be linked at all, without pairs.
    """
    sized = materialise(rows.join(facts, "id"), "sized")
    least = sized.groupBy("band", "h").agg(F.min("facts.size").alias("least"))
    size, shared = F.col("facts.size"), F.col("facts.shared")
    return spread_join(sized, least, ["band", "h"], "id").filter(shared >= similar * (size + F.greatest("least", shared) - shared)).drop("least")  # beside a partner of the best length


def text_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(id, class_id, class_text, n_links) of each distinct text of docs (doc_id, text): its class by the smallest doc_id in it (null only if all are) and the text that has that.

    Words are split at ASCII white space and compared in lower case. Texts are linked if the weighted Jaccard similarity
    of their multisets of five-word shingles is at least `similar`; classes are the components of these links. n_links is
    the number of a text's verified links that the classes rest on. Equal texts are one text: copies are never
    paired. A text without words is a class of its own; null texts have none.

    Signatures are made where the rows are; distinct texts meet by band. Each bucket's first member is compared with the others,
    which settles most buckets in one go. Those that still hold several components have the members outside the largest one compared
    with all members of other components, so no pair of a bucket stays unknown unless it is in one component anyway, or, in
    a bucket of more than SMALL, too many shingles of a text are in no other component for the pair to be similar.
    """
    spark = docs.sparkSession
    ship(spark)
    since = mark(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = materialise(_texts(docs), "texts")
    banded = texts.filter("bands is not null").select("id", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("band", "h", "first")
    members = materialise(spread_join(banded, buckets, ["band", "h"], "id", 8).select("band", "h", "first", "id"), "buckets")
    pairs = materialise(members.filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sets = _sets(docs, members.select("id").distinct())
    links = _verified(pairs, sets, similar)
    roots = _fold_links(links)
    open_ = materialise(_open(members.drop("first"), roots), "open")
    # Small buckets: what is left is few pairs a member. Large ones: first another leader, then only pairs that may be similar.
    few = _across(open_.filter(F.col("members") <= SMALL), similar, False)
    large = open_.filter(F.col("members") > SMALL)
    if not large.isEmpty():
        opened, large = large, large.select("band", "h", "id")
        sized = materialise(texts.select("id", "size").join(large.select("id").distinct(), "id"), "sized")
        spread = materialise(_spread(sized, sets), "spread")
        for turn in range(TURNS + 1):
            again = materialise(_hopeful(opened, _facts(spread, sized, roots), similar), "again")
            if turn == TURNS:
                few = few.unionAll(_across(again, similar, True))
                break
            stars = materialise(_stars(again, turn, similar).join(pairs, ["a", "b"], "left_anti"), "stars")
            if stars.isEmpty():
                few = few.unionAll(_across(again, similar, True))
                break
            pairs = pairs.unionAll(stars)
            more = _verified(stars, sets, similar)
            links, roots = links.unionAll(more), _joined(roots, more)
            opened = _open(large, roots)
    rest = materialise(few.distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _verified(rest, sets, similar)
        if not more.isEmpty():
            links, roots = links.unionAll(more), _joined(roots, more)
    degree = links.select(F.col("a").alias("id")).unionAll(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    of = texts.select("id", "doc_id").join(roots, "id", "left").join(degree, "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of = materialise(of, "of")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("k"), "doc_id", "id"))
    heads = of.groupBy("root").agg(head.alias("head")).select("root", F.col("head.doc_id").alias("class_id"), F.col("head.id").alias("class_text"))
    out = materialise(of.join(heads, "root").select("id", "class_id", "class_text", "n_links"), "classes")
    forget_since(since, out)
    return out


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of docs (doc_id, text): the class of its text and the number of the text's verified links; see text_classes.

    A null text is in a class of its own: class_id is the row's doc_id.
    """
    classes = text_classes(docs, similar).select("id", "class_id", "n_links")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text").cast("string")).alias("id"))
    return rows.join(classes, "id", "left").select("doc_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest doc_id (of rows alike in doc_id and text, any one); rows without a text stay."""
    tid, head, head_doc = (free_name(n, docs) for n in ("_tid", "_head", "_head_doc"))
    heads = text_classes(docs, similar).filter("id = class_text").select(F.col("id").alias(head), F.col("class_id").alias(head_doc))
    rows = docs.withColumn(tid, text_id(F.col("text").cast("string")))
    same = (F.col(tid) == F.col(head)) & F.col("doc_id").cast("long").eqNullSafe(F.col(head_doc))
    kept = rows.join(heads, same).drop(head_doc).dropDuplicates([head]).drop(head, tid)
    return kept.unionByName(rows.filter(F.col(tid).isNull()).drop(tid))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
