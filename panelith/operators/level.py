"""The level's transforms and its regression design."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import LEAST_PERIODS, TINY
from panelith.functions.numeric import boxcox


def centre(levels: DataFrame, value: str = "level_bc", series: str = "series_id") -> DataFrame:
    """levels with last_level and innov, value less its last."""
    last = F.last(value).over(Window.partitionBy(series).orderBy("period_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("last_level", last).withColumn("innov", F.col(value) - F.col("last_level"))


def phi(levels: DataFrame, value: str = "level_bc", series: str = "series_id") -> DataFrame:
    """(series, phi): first autocorrelation of the differences, 0 at least; 0 with under five differences or no spread."""
    w = Window.partitionBy(series)
    d = levels.withColumn("_d", F.col(value) - F.lag(value).over(w.orderBy("period_idx"))).filter("_d is not null")
    d = d.withColumn("_e", F.col("_d") - F.avg("_d").over(w)).withColumn("_f", F.lag("_e").over(w.orderBy("period_idx")))
    sums = d.groupBy(series).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_e") * F.col("_e")).alias("_c0"), F.sum(F.col("_e") * F.col("_f")).alias("_c1"))
    ratio = F.greatest(F.try_divide(F.col("_c1"), F.col("_c0")), F.lit(0.0))
    return sums.select(series, F.when((F.col("_n") < 5) | (F.col("_c0") < TINY), 0.0).otherwise(ratio).alias("phi"))


def design(levels: DataFrame, max_cp: int, exog: Sequence[str] = (), series: str = "series_id") -> DataFrame:
    """(series, period_idx, b0, b1, lag1[, lag_cp], exog..., target): the regression's rows.

    With three training rows or more the target is the difference and lag1 has its sign turned; else the level itself. In a series where the cross
    lag would leave fewer than LEAST_PERIODS training rows it goes: lag_cp is null there, and training starts at the second period.
    Needs nc, period_idx and innov.
    """
    w = Window.partitionBy(series).orderBy("period_idx")
    used = (F.col("nc") - max_cp >= LEAST_PERIODS) if max_cp >= 2 else F.lit(False)
    start = F.when(used, F.lit(max_cp)).otherwise(F.lit(1))
    prev = F.lag("innov", 1).over(w)
    diff = F.col("nc") - start >= 3
    rows = levels.withColumn("b0", F.lit(1.0)).withColumn("b1", F.col("period_idx") / F.col("nc"))
    rows = rows.withColumn("lag1", F.when(diff, -prev).otherwise(prev)).withColumn("target", F.when(diff, F.col("innov") - prev).otherwise(F.col("innov")))
    lags = ["lag1"]
    if max_cp >= 2:
        rows, lags = rows.withColumn("lag_cp", F.when(used, F.lag("innov", max_cp).over(w))), ["lag1", "lag_cp"]
    return rows.filter(F.col("period_idx") >= start).select(series, "period_idx", "b0", "b1", *lags, *exog, "target")


def boxcox_loglik(levels: DataFrame, powers: Sequence[float], value: str = "level", series: str = "series_id") -> DataFrame:
    """(series, power, loglik): the profile likelihood over positive values."""
    rows = levels.filter(F.col(value) > 0).select(series, F.col(value).alias("x"), F.explode(F.array(*[F.lit(float(p)) for p in powers])).alias("power"))
    z: Column = boxcox(F.col("x"), F.col("power"))
    return rows.groupBy(series, "power").agg(((F.first("power") - 1) * F.sum(F.ln("x")) - F.count(F.lit(1)) / 2 * F.ln(F.var_pop(z))).alias("loglik"))
