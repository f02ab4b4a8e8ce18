"""Panels (series_id, ts, y) from raw tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def read_csv(spark: SparkSession, path: str, ts: str, ts_format: str | None = None, quote: str = '"', **options: str) -> DataFrame:
    """A CSV file with a header; ts parsed by ts_format (None: as ISO) to a timestamp without time zone."""
    df = spark.read.options(header=True, inferSchema=True, quote=quote, **options).csv(path)
    return df.withColumn(ts, (F.to_timestamp(F.col(ts).cast("string"), ts_format) if ts_format else F.col(ts)).cast("timestamp_ntz"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write results as parquet or as CSV with a header."""
    out = df.write.mode("overwrite").partitionBy(*partition_by)
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def spine(df: DataFrame, unit: str, series: str = "series_id", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(series, ts) for each unit ('hour', 'day', 'month') from start to end; without them, from each series' first to last ts."""
    own = df.groupBy(series).agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    steps = F.sequence(start if start is not None else F.col("_a"), end if end is not None else F.col("_z"), F.expr(f"interval 1 {unit}"))
    return own.select(series, F.explode(steps).alias("ts"))


def truncate_ts(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def counts(rows: DataFrame, series: str, ts: str, unit: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(series_id, ts, y): rows by unit, with 0 where there are none."""
    c = rows.groupBy(F.col(series).alias("series_id"), truncate_ts(F.col(ts), unit).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return spine(c, unit, start=start, end=end).join(c, ["series_id", "ts"], "left").select("series_id", "ts", F.coalesce("y", F.lit(0.0)).alias("y"))


def sums(rows: DataFrame, series: str, ts: str, value: str, unit: str) -> DataFrame:
    """(series_id, ts, y): sums by unit, null where there are no rows (and for a series without a name).

    Each sum is followed by the units up to the next one, so that the filled panel isn't shuffled: what is shuffled are the sums.
    """
    c = rows.groupBy(F.col(series).alias("series_id"), truncate_ts(F.col(ts), unit).alias("ts")).agg(F.sum(value).alias("y")).filter("ts is not null")
    step = F.expr(f"interval 1 {unit}")
    until = F.coalesce(F.lead("ts").over(Window.partitionBy("series_id").orderBy("ts")) - step, F.col("ts"))
    c = c.withColumn("y", F.when(F.col("series_id").isNotNull(), F.col("y"))).withColumn("_until", until)
    return c.select("series_id", F.posexplode(F.sequence("ts", "_until", step)).alias("_k", "ts"), "y").select("series_id", "ts", F.when(F.col("_k") == 0, F.col("y")).alias("y"))


def resample(rows: DataFrame, value: str, ts: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts, y): means by unit, without units that have no value."""
    return rows.groupBy(*keys, truncate_ts(F.col(ts), unit).alias("ts")).agg(F.avg(value).alias("y")).na.drop(subset=["y"])


def sentinel_to_null(x: Column, below: float) -> Column:
    return F.when(x >= below, x)


def dummy(x: Column, value: str) -> Column:
    """1.0 where x is value, else 0.0; null counts as another value."""
    return F.coalesce((x == value).cast("double"), F.lit(0.0))


def between(df: DataFrame, ts: str, first: str, before: str) -> DataFrame:
    """Rows with first <= ts < before."""
    return df.filter((F.col(ts) >= F.lit(first).cast("timestamp_ntz")) & (F.col(ts) < F.lit(before).cast("timestamp_ntz")))


def hold_out(df: DataFrame, horizon: int, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """df with part: 'test' for each series' last `horizon` rows, 'train' for the others."""
    back = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(ts)))
    return df.withColumn("part", F.when(back <= horizon, "test").otherwise("train"))


def with_noise(df: DataFrame, names: Sequence[str], seed: int = 7, series: str = "series_id", at: str = "i") -> DataFrame:
    """df with columns of standard normal noise, a control for exogenous columns: a function of seed, series, place and column, so it
    is the same on every run and on either side of a split."""

    def uniform(name: str, k: int) -> Column:
        key = F.concat_ws(":", F.lit(str(seed)), F.col(series).cast("string"), F.col(at).cast("string"), F.lit(name), F.lit(str(k)))
        return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    return df.withColumns({n: F.sqrt(-2 * F.ln(uniform(n, 0))) * F.cos(2 * math.pi * uniform(n, 1)) for n in names})
