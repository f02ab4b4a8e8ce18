"""Residuals of the shape, and samples put together and held to the history's range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import NOISE_PERIODS, TINY, TINY_BOXCOX, TINY_SHAPE


def phase_residuals(folded: DataFrame, shapes: DataFrame, levels: DataFrame, k: int = NOISE_PERIODS, series: str = "series_id") -> DataFrame:
    """(series, nc, period_idx, phase, resid): relative residuals of the last k periods; the denominator is a tenth of the median fit at least."""
    rows = folded.join(shapes, [series, "phase"]).join(levels.drop("nc"), [series, "period_idx"])
    rows = rows.withColumn("fit", F.col("s") * F.col("level")).filter(F.col("period_idx") >= F.col("nc") - k).withColumn("_f", F.abs("fit"))
    floors = rows.groupBy(series).agg(F.greatest(F.coalesce(0.1 * F.median(F.when(F.col("_f") > TINY, F.col("_f"))), F.lit(TINY_BOXCOX)), F.lit(TINY_BOXCOX)).alias("_floor"))
    return rows.join(floors, series).select(series, "nc", "period_idx", "phase", ((F.col("y") - F.col("fit")) / F.greatest("_f", "_floor")).alias("resid"))


def shrink_bias(residuals: DataFrame, k: int = NOISE_PERIODS, series: str = "series_id") -> DataFrame:
    """residuals less the part of each phase's mean that looks like sampling noise; with under four periods, unchanged."""
    w = Window.partitionBy(series, "phase")
    mean, err = F.avg("resid").over(w), F.var_samp("resid").over(w) / F.least(F.lit(k), F.col("nc"))
    rows = residuals.withColumn("_m", mean).withColumn("_e", err)
    part = F.least(F.greatest(F.col("_e") / (F.col("_m") * F.col("_m") + F.col("_e") + TINY), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("resid", F.when(F.least(F.lit(k), F.col("nc")) >= 4, F.col("resid") - F.col("_m") * part).otherwise(F.col("resid"))).drop("_m", "_e")


def clip_bounds(df: DataFrame, horizon: int, series: str = "series_id") -> DataFrame:
    """(series, low, high, whole) of observed histories (nulls allowed): the least value, the recent most plus the recent range, and whether all values are integers.

    low and high are null if no recent value is there: then samples aren't clipped.
    """
    back = F.row_number().over(Window.partitionBy(series).orderBy(F.desc("i")))
    recent = F.when(F.col("_back") <= max(2 * horizon, 50), F.col("y"))
    rows = df.withColumn("_back", back)
    out = rows.groupBy(series).agg(F.min("y").alias("_min"), F.max(recent).alias("_hi"), F.min(recent).alias("_lo"), F.bool_and(F.col("y") == F.rint("y")).alias("whole"))
    high = F.col("_hi") + F.greatest(F.col("_hi") - F.col("_lo"), F.lit(TINY_SHAPE))
    return out.select(series, F.when(F.col("_hi").isNotNull(), F.col("_min")).alias("low"), high.alias("high"), F.coalesce("whole", F.lit(False)).alias("whole"))


def snap(value: Column, whole: Column) -> Column:
    """value, rounded half to even where the history holds only integers."""
    return F.when(whole, F.rint(value)).otherwise(value)


def assemble(paths: DataFrame, shapes: DataFrame, noise: DataFrame, bounds: DataFrame, p: int, horizon: int, series: str = "series_id") -> DataFrame:
    """(series, sample_id, step, value) from levels (series, sample_id, block, level_hat, deflate), shapes, noise (series, sample_id, phase, eps) and bounds with shift."""
    steps = paths.withColumn("step", F.explode(F.sequence(F.col("block") * p, F.least((F.col("block") + 1) * p, F.lit(horizon)) - 1))).withColumn("phase", (F.col("step") % p).cast("int"))
    rows = steps.join(shapes, [series, "phase"]).join(noise, [series, "sample_id", "phase"]).join(bounds, series)
    raw = F.col("level_hat") * F.col("s") * (1 + F.col("eps") * F.col("deflate")) - F.col("shift")
    held = F.when(F.col("high").isNotNull(), F.least(F.greatest(raw, F.col("low")), F.col("high"))).otherwise(raw)
    return rows.select(series, "sample_id", "step", snap(held, F.col("whole")).alias("value"))


def reseason(levels: DataFrame, factors: DataFrame, cp: int, series: str = "series_id") -> DataFrame:
    """levels (series, nc, block, level_hat, ...) times the factor of their place in the cycle."""
    rows = levels.withColumn("pos", ((F.col("nc") + F.col("block")) % cp).cast("int")).join(factors, [series, "pos"], "left")
    return rows.withColumn("level_hat", F.col("level_hat") * F.coalesce("s2", F.lit(1.0))).drop("pos", "s2")


def deflate(leverage_rows: DataFrame) -> DataFrame:
    """Rows with deflate, the factor of phase noise at a step's leverage."""
    return leverage_rows.withColumn("deflate", 1 / F.sqrt(1 + F.col("leverage")))
