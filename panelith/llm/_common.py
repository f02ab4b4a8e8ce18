"""Shared plumbing: scratch tables, shipping of the package, numbering of rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelith import shipping

#: Rows that number_rows() puts into a bucket, on average.
BUCKET_ROWS = 250_000
#: Bits of a Bloom filter that each number sets.
PROBES = 6
_tables: dict[str, list[str]] = {}
_named: set[str] = set()  # of these, those that are in the catalogue


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs in one process (tests), a temporary one.

    On a cluster a folder of this machine wouldn't do: executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and bound what these hold at once: whole texts can be long."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    if int((spark.conf.get(key, None) or "67108864").rstrip("b")) > most:
        spark.conf.set(key, str(most))
    shipping.ship(spark)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        if path in _named:
            spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1]}`")
            _named.discard(path)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the writing query go when it ends; the table goes with the session. by: a column into whose hash
    buckets the table is split, so that joins on it needn't shuffle the table again.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        if by:
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            _named.add(path)
            df.repartition(n, by).write.option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(name)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    app = spark.sparkContext.applicationId
    if app not in _tables:
        _tables[app] = []
        atexit.register(lambda: [_forget(spark, p) for p in _tables.pop(app, [])])
    _tables[app].append(path)
    return spark.table(name) if by else spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables materialise() has written so far."""
    return len(_tables.get(spark.sparkContext.applicationId, []))


def forget_since(since: int, *keep: DataFrame) -> None:
    """Delete the tables written since mark(), but for those that are to stay: nothing may read the others any more."""
    spark = keep[0].sparkSession
    stay = {f.rsplit("/", 2)[1] for df in keep for f in df.inputFiles()}
    for path in _tables.get(spark.sparkContext.applicationId, [])[since:]:
        if path.rsplit("/", 1)[1] not in stay:
            _forget(spark, path)


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter, with PROBES bits for each number of the column hash. The driver gets 2^bits bits at most, however many there are."""
    low = F.lit((1 << bits) - 1)
    first, step = F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", bits).bitwiseAND(low).bitwiseOR(F.lit(1))
    bit = F.explode(F.array(*[(first + step * i).bitwiseAND(low) for i in range(PROBES)])).alias("bit")
    rows = hashes.select(bit).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("map")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["map"], np.uint8)[: len(out) - at]
    return out


def in_bloom(bitmap: np.ndarray, bits: int, x: np.ndarray) -> np.ndarray:
    """The places of those numbers (unsigned) that may be in the filter."""
    low, at = np.uint64((1 << bits) - 1), np.arange(len(x))
    for i in range(PROBES):  # each looks only at what the one before let through
        own = x[at]
        b = (own & low) + np.uint64(i) * (own >> np.uint64(bits) & low | np.uint64(1)) & low
        at = at[(bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def filter_bits(n: int, most: int = 28) -> int:
    """Bits of a filter for n numbers, as a power of two: 32 to 64 for each, so that it lets some 2 in 100,000 others through at most; 2^most in all (beyond that it lets more through, which costs time only)."""
    return min(most, max(16, (32 * n).bit_length()))


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """rows joined with facts, which have one narrow row for each key: a hot key's rows are dealt over `salts` tasks by a hash of the column `by`, and each fact goes to all of them."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, within: tuple[str, ...] = (), buckets: int | None = None, out: str = "row_no", rows: int | None = None) -> DataFrame:
    """Number the rows 0, 1, ... in each group of `within` (none: the whole table), in an order
    that depends on the rows' values only.

    Equal rows are counted first, so a row that is repeated any number of times moves as one; each group
    is split by a hash into buckets that are numbered on their own, and the buckets' counts
    give where each begins. So neither a hot group nor a hot row meets in a task. buckets: how many a group; None: one for each
    BUCKET_ROWS of the table's rows, 64 at least. rows: the table's number of rows, if it is known. Columns of df may have any names, but for `out`.
    """
    if buckets is None:
        buckets = max(64, -(-(df.count() if rows is None else rows) // BUCKET_ROWS))
    names, cols = df.columns, [f"_c{i}" for i in range(len(df.columns))]
    df, within = df.toDF(*cols), tuple(cols[names.index(w)] for w in within)
    hashed = F.pmod(F.xxhash64(*cols), F.lit(buckets))
    runs = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", hashed)
    keys = [*within, "_b"]
    part = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = runs.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    same: Column = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = runs.withColumn("_upto", F.sum("_n").over(part)).join(begins, same)
    first = F.col("_begin") + F.col("_upto") - F.col("_n")
    return placed.select(*cols, F.explode(F.sequence(first, first + F.col("_n") - 1))).toDF(*names, out)


def free_name(name: str, df: DataFrame) -> str:
    """name, with underscores before it until no column of df is called so (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
