"""Validation, interpolation, shifts and exogenous columns."""

from __future__ import annotations

import numbers
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate_request(horizon: int, freq: str, n_samples: int, noise: str = "bootstrap", period: int | None = None) -> None:
    if noise not in ("bootstrap", "t"):
        raise ValueError('noise must be "bootstrap" or "t"')
    if not isinstance(freq, str):
        raise TypeError("freq must be a string")
    for name, value in (("horizon", horizon), ("n_samples", n_samples), *([] if period is None else [("period", period)])):
        if isinstance(value, bool) or not isinstance(value, numbers.Integral):
            raise TypeError(f"{name} must be an integer")
        if value < 1:
            raise ValueError(f"{name} must be >= 1")


#: Reasons why a series can't be forecast that its values show, worst first.
INFINITE, OVERFLOW, EMPTY = "infinite", "overflow", "no values"
#: The largest value whose square, summed, is still far from overflowing.
LARGEST = 1e150


def fault(largest: Column) -> Column:
    """The reason, if any, from the largest absolute value of a series that isn't missing (null: there is none)."""
    return F.when(largest.isNull(), EMPTY).when(largest == float("inf"), INFINITE).when(largest > LARGEST, OVERFLOW)


def faults(history: DataFrame, series: str | Sequence[str] = "series_id", y: str = "y") -> DataFrame:
    """(series, fault) of the series whose values show that they can't be forecast: one aggregation, combined before the shuffle."""
    known = F.when(~_missing(F.col(y)), F.abs(F.col(y).cast("double")))
    return history.groupBy(*_keys(series)).agg(fault(F.max(known)).alias("fault")).filter("fault is not null")


def index_series(df: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """df with i, the 0-based place in the series by ts, and n, the series' length."""
    w = Window.partitionBy(series)
    return df.withColumn("i", F.row_number().over(w.orderBy(ts)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def _keys(series: str | Sequence[str]) -> list[str]:
    return [series] if isinstance(series, str) else list(series)


def _missing(y: Column) -> Column:
    return y.isNull() | F.isnan(y)


def interpolate(df: DataFrame, y: str = "y", fallback: float | Column = 0.0, series: str | Sequence[str] = "series_id", order: str = "i", out: str | None = None) -> DataFrame:
    """df with y (or out) filled: linear between neighbours, constant at the edges, the fallback where a series has no value. NaN counts as missing."""
    w = Window.partitionBy(*_keys(series))
    point = F.when(~_missing(F.col(y)), F.struct(F.col(order).alias("i"), F.col(y).cast("double").alias("y")))
    # Both look back, one of them in descending order: a frame that runs to the end would read it again for each row.
    nearest = lambda by: F.last(point, ignorenulls=True).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_b", nearest(F.desc(order))).withColumn("_a", nearest(F.asc(order)))
    a, b = F.col("_a"), F.col("_b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col(order) - a["i"]) / (b["i"] - a["i"])
    value = F.when(a["i"] == b["i"], a["y"]).when(a.isNotNull() & b.isNotNull(), line).otherwise(F.coalesce(a["y"], b["y"], F.lit(fallback) if isinstance(fallback, (int, float)) else fallback))
    return df.withColumn(out or y, value).drop("_a", "_b")


def positivity_shift(df: DataFrame, series: str | Sequence[str] = "series_id") -> DataFrame:
    """df with y moved to at least 1 and shift, by how much: max(1 - min(y), 1), also for positive series."""
    shift = F.greatest(1 - F.min("y").over(Window.partitionBy(*_keys(series))), F.lit(1.0))
    return df.withColumn("shift", shift).withColumn("y", F.col("y") + F.col("shift"))


def fill_exog(history: DataFrame, future: DataFrame, columns: Sequence[str], series: str = "series_id") -> tuple[DataFrame, DataFrame]:
    """Both sides' exogenous columns interpolated; a future column without any value takes the last cleaned history value."""
    for c in columns:
        history = interpolate(history, c, 0.0, series, "i")
    last = history.groupBy(series).agg(*[F.max_by(c, "i").alias(f"_last_{c}") for c in columns])
    future = future.join(last, series, "left")
    for c in columns:
        future = interpolate(future, c, F.coalesce(F.col(f"_last_{c}"), F.lit(0.0)), series, "step")
    return history, future.drop(*[f"_last_{c}" for c in columns])


def check_exog(history: DataFrame, future: DataFrame | None, columns: Sequence[str]) -> None:
    """Raise ValueError unless exogenous columns are on both sides. Reads no rows: how many a series has ahead is checked where it is forecast."""
    if bool(columns) != (future is not None):
        raise ValueError("X_hist and X_future must be provided together")
    if not columns:
        return
    if absent := [c for c in columns if c not in future.columns]:
        raise ValueError(f"X_hist columns {absent} are not in X_future")
    if absent := [c for c in columns if c not in history.columns]:
        raise ValueError(f"X_future columns {absent} are not in X_hist")


def degenerate_sigma(df: DataFrame, series: str = "series_id", last: int = 50) -> DataFrame:
    """(series, last_y, sigma): the spread of the last differences, 1 for a single value, 1e-6 at least."""
    w = Window.partitionBy(series).orderBy("i")
    recent = df.withColumn("_r", F.row_number().over(Window.partitionBy(series).orderBy(F.desc("i")))).filter(F.col("_r") <= last)
    steps = recent.withColumn("_d", F.col("y") - F.lag("y").over(w))
    sigma = F.when(F.count(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.greatest(F.stddev_pop("_d"), F.lit(1e-6)))
    return steps.groupBy(series).agg(F.max_by("y", "i").alias("last_y"), sigma.alias("sigma"))
