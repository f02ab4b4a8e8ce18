"""Scans in blocks against windows over whole series."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelith.operators import blocks, clean, fold


@pytest.fixture(scope="module")
def panel(spark):
    """One series with most rows, a small one, one without values, and a null key; gaps that are longer than blocks, repeated and null times."""
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "a").when(F.col("id") < 5600, "b").when(F.col("id") < 5900, "none").otherwise(F.lit(None)).alias("series_id"), (F.col("id") % 5000).alias("k"), "id")
    wave = F.when((F.col("series_id") == "none") | ((F.col("id") > 1500) & (F.col("id") < 2600)) | (F.col("id") < 400) | (F.hash("id") % 3 == 0), F.lit(None)).when(F.hash("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.sin("id") * 9)
    skew = F.when(F.col("k") % 10 == 3, F.col("k") - 1).otherwise(F.col("k")) ** 3  # most rows at the beginning, some of one time
    return rows.select("series_id", "id", F.timestamp_seconds(skew).cast("timestamp_ntz").alias("ts"), wave.alias("y"))


@pytest.mark.parametrize("size", [1, 300, 10**6])
def test_blocks_are_windows(panel, size):
    own = blocks.index_series(blocks.cut(panel, "ts", size), order=["ts", "id"])
    n_blocks = own.select("block").distinct().count()
    assert n_blocks == 1 if size == 10**6 else n_blocks > 5000 / max(size, 100)
    plain = clean.index_series(panel.withColumn("at", F.struct("ts", "id")), ts="at").drop("at")
    want, got = (clean.positivity_shift(clean.interpolate(plain)), blocks.positivity_shift(blocks.interpolate(own)))
    a, b = ({(r.series_id, r.id): (r.i, r.n, round(r.y, 9), round(r.shift, 9)) for r in d.collect()} for d in (want, got))
    assert a == b and len(a) == 6000
    for most in (20, 10_000):
        x, y = fold.fold(fold.truncate(plain.fillna(1.0, ["y"]), 7, most), 7), blocks.fold(blocks.truncate(own.fillna(1.0, ["y"]), 7, most), 7)
        key = ["series_id", "period_idx", "phase"]
        assert sorted(map(str, x.select(*key, "nc", F.round("y", 6)).collect())) == sorted(map(str, y.select(*key, "nc", F.round("y", 6)).collect()))


def test_block_edges(spark, panel):
    none = blocks.interpolate(blocks.index_series(blocks.cut(panel.limit(0))))
    assert none.count() == 0
    one = blocks.interpolate(blocks.index_series(blocks.cut(spark.createDataFrame([("a", 5, None), ("a", 5, 2.0), ("b", None, 1.0)], "series_id string, ts int, y double")), order=["ts", "y"])).collect()
    assert sorted((r.series_id, r.i, r.y) for r in one) == [("a", 0, 2.0), ("a", 1, 2.0), ("b", 0, 1.0)]
    sizes = [r["count"] for r in blocks.cut(panel, "ts", 50).groupBy("block").count().collect()]
    assert sorted(sizes)[len(sizes) // 2] <= 60


def test_a_single_series_of_many_rows(spark):
    """All tasks have rows, and none a large part of them."""
    rows = spark.range(1_000_000).select(F.lit("a").alias("series_id"), F.col("id").alias("ts"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("y"))
    out = blocks.interpolate(blocks.index_series(blocks.cut(rows, rows=20_000)))
    found = out.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("y") - F.when(F.col("ts") == 0, 1).otherwise(F.col("ts")))).alias("off"), F.sum(F.abs(F.col("i") - F.col("ts"))).alias("moved")).collect()
    assert len(found) >= 50 and max(r.n for r in found) <= 20_000 and sum(r.n for r in found) == 1_000_000
    assert sum(r.moved for r in found) == 0 and max(r.off for r in found) < 1e-3
