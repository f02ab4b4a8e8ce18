"""Shapes within a period, and seasonal factors across periods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import SHAPE_PERIODS, TINY, TINY_LOG, TINY_SHAPE


def shape(folded: DataFrame, p: int, k: int = SHAPE_PERIODS, series: str = "series_id") -> DataFrame:
    """(series, phase, s): mean share of each phase in its period's total over the last k periods, summing to 1."""
    recent = folded.filter(F.col("period_idx") >= F.col("nc") - F.least(F.lit(k), F.col("nc")))
    total = F.sum("y").over(Window.partitionBy(series, "period_idx"))
    shares = recent.withColumn("_t", total).withColumn("_s", F.when(F.col("_t") > TINY, F.try_divide(F.col("y"), F.col("_t"))).otherwise(1.0 / p))
    mean = shares.groupBy(series, "phase").agg(F.avg("_s").alias("_s"))
    return mean.select(series, "phase", (F.col("_s") / F.greatest(F.sum("_s").over(Window.partitionBy(series)), F.lit(TINY))).alias("s"))


def shape2(levels: DataFrame, cp: int, series: str = "series_id") -> DataFrame:
    """(series, pos, s2): factors of the positions in a cycle of cp periods, mean 1. Series with fewer than two cycles, or without mass, have none.

    Raw means are blended with a prior: a first harmonic if the criterion favours it over a flat one.
    """
    w = Window.partitionBy(series)
    raw = levels.groupBy(series, "nc", (F.col("period_idx") % cp).alias("pos")).agg(F.avg("level").alias("_raw")).filter(F.col("nc") >= 2 * cp)
    raw = raw.withColumn("_mean", F.avg("_raw").over(w)).filter(F.col("_mean") >= TINY).withColumn("r", F.col("_raw") / F.col("_mean"))
    angle = F.col("pos") * (2 * math.pi / cp)
    raw = raw.withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle))
    raw = raw.withColumn("_a", 2 * F.avg((F.col("r") - 1) * F.col("_c")).over(w)).withColumn("_b", 2 * F.avg((F.col("r") - 1) * F.col("_s")).over(w))
    raw = raw.withColumn("_h", 1 + F.col("_a") * F.col("_c") + F.col("_b") * F.col("_s"))
    score = lambda e: cp * F.ln(F.greatest(F.sum(e * e).over(w) / cp, F.lit(TINY_LOG)))
    raw = raw.withColumn("_flat", score(F.col("r") - 1)).withColumn("_wave", score(F.col("r") - F.col("_h")) + 2 * math.log(cp))
    share = F.expr(f"nc div {cp}") / (F.expr(f"nc div {cp}") + cp)
    prior = F.when(F.col("_wave") < F.col("_flat"), F.col("_h")).otherwise(1.0)
    mixed = raw.withColumn("_m", F.greatest(share * F.col("r") + (1 - share) * prior, F.lit(TINY_SHAPE)))
    return mixed.select(series, F.col("pos").cast("int").alias("pos"), (F.col("_m") / F.avg("_m").over(w)).alias("s2"))


def deseason(levels: DataFrame, factors: DataFrame, cp: int, series: str = "series_id") -> DataFrame:
    """levels with level divided by its position's factor; series without factors stay."""
    joined = levels.withColumn("pos", (F.col("period_idx") % cp).cast("int")).join(factors, [series, "pos"], "left")
    return joined.withColumn("level", F.col("level") / F.greatest(F.coalesce("s2", F.lit(1.0)), F.lit(TINY))).drop("pos", "s2")
