"""Folding of series into periods, levels, and exogenous means by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import LEAST_PERIODS, MOST_PERIODS, TINY


def truncate(df: DataFrame, p: int, most: int = MOST_PERIODS, series: str = "series_id") -> DataFrame:
    """The last most * p rows of series that have more than `most` complete periods; i and n start anew."""
    w = Window.partitionBy(series)
    n = F.count(F.lit(1)).over(w)
    rows = df.withColumn("n", n).withColumn("_back", F.row_number().over(w.orderBy(F.desc("i"))))
    rows = rows.filter((F.expr(f"n div {p}") <= most) | (F.col("_back") <= most * p)).drop("_back")
    return rows.withColumn("i", F.row_number().over(w.orderBy("i")) - 1).withColumn("n", n)


def fold(df: DataFrame, p: int, series: str = "series_id") -> DataFrame:
    """(series, nc, period_idx, phase, y): the latest complete periods; the oldest n mod p rows go."""
    rows = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(series)))
    rows = rows.withColumn("nc", F.expr(f"cast(n div {p} as int)")).withColumn("_j", F.col("i") - (F.col("n") - F.col("nc") * p)).filter("_j >= 0")
    return rows.select(series, "nc", F.expr(f"cast(_j div {p} as int)").alias("period_idx"), (F.col("_j") % p).cast("int").alias("phase"), "y")


def level(folded: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, nc, period_idx, level): the sum of each period."""
    return folded.groupBy(series, "nc", "period_idx").agg(F.sum("y").alias("level"))


def route(df: DataFrame, p: int, secondary: Sequence[int], n_exog: int = 0, series: str = "series_id") -> DataFrame:
    """(series, n, nc, max_cp, start, nf, p_used, kind) for a period that was picked: too few periods, or fewer than two
    training rows for each feature, turn it to 1; under LEAST_PERIODS rows the series is degenerate."""
    s = df.groupBy(series).agg(F.count(F.lit(1)).alias("n")).withColumn("nc", F.expr(f"n div {p}"))
    lags = [F.lit(x // p if p >= 2 else x) for x in secondary]
    max_cp = F.coalesce(F.array_max(F.filter(F.array(*lags).cast("array<bigint>"), lambda c: (c >= 2) & (c <= F.expr("nc div 2")))), F.lit(0)) if lags else F.lit(0)
    s = s.withColumn("max_cp", max_cp.cast("long")).withColumn("start", F.greatest("max_cp", F.lit(1)).cast("long")).withColumn("nf", (3 + (F.col("max_cp") >= 2).cast("long") + n_exog).cast("long"))
    few = (F.col("nc") < LEAST_PERIODS) | ((F.lit(p) > 1) & (F.col("nc") - F.col("start") < 2 * F.col("nf")))
    s = s.withColumn("p_used", F.when(few, 1).otherwise(p).cast("long"))
    kind = F.when(F.col("n") < LEAST_PERIODS, "degenerate").when(F.col("p_used") == 1, "level").otherwise("periodic")
    return s.withColumn("kind", kind)


def exog_level(df: DataFrame, p: int, columns: Sequence[str], series: str = "series_id") -> DataFrame:
    """(series, period_idx, columns): the mean of each period, aligned as fold() does."""
    rows = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(series))).withColumn("nc", F.expr(f"cast(n div {p} as int)"))
    rows = rows.withColumn("_j", F.col("i") - (F.col("n") - F.col("nc") * p)).filter("_j >= 0")
    return rows.groupBy(series, F.expr(f"cast(_j div {p} as int)").alias("period_idx")).agg(*[F.avg(c).alias(c) for c in columns])


def exog_future_level(future: DataFrame, p: int, columns: Sequence[str], series: str = "series_id") -> DataFrame:
    """(series, block, columns): means of p future steps each; the last block may be shorter."""
    return future.groupBy(series, F.expr(f"cast(step div {p} as int)").alias("block")).agg(*[F.avg(c).alias(c) for c in columns])


def standardise(levels: DataFrame, columns: Sequence[str], start: int, future: DataFrame | None = None, series: str = "series_id") -> tuple[DataFrame, DataFrame | None]:
    """Both with columns as z-scores by the mean and population spread of period_idx >= start; a spread under TINY counts as 1."""
    own = F.when(F.col("period_idx") >= start, F.lit(1))
    stats = levels.groupBy(series).agg(*[x for c in columns for x in (F.avg(F.when(own == 1, F.col(c))).alias(f"_m_{c}"), F.stddev_pop(F.when(own == 1, F.col(c))).alias(f"_s_{c}"))])

    def scaled(df: DataFrame) -> DataFrame:
        z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < TINY, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in columns}
        return df.join(stats, series).withColumns(z).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])

    return scaled(levels), None if future is None else scaled(future)
