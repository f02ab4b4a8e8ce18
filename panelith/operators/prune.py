"""What is too old to matter in a forecast, found before rows are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.operators.clean import _missing

#: Buckets that the rows a series needs are cut into: so one part in so many, at most, is kept beyond need where rows come evenly.
FINE = 8
#: Series whose facts are broadcast. A panel with more of them isn't pruned.
MOST_SERIES = 200_000


def of_series(seen: str) -> dict[str, Column]:
    """Aggregates that the kernel needs of all observed values of a series, however old: they combine before a shuffle."""
    x = F.col(seen)
    return {"low": F.min(x), "whole": F.bool_and(x == F.rint(x)), "largest": F.max(F.abs(x))}


def place(order: Column, kind: str) -> Column:
    """A number that rises with order: seconds of times and dates, else the number itself."""
    return order.cast("timestamp").cast("long") if kind.startswith(("timestamp", "date")) else order.cast("double")


def histogram(rows: DataFrame, keys: Sequence[str], order: str = "_order", y: str = "y") -> DataFrame:
    """(keys, bucket, n, observed, low, whole, largest, need, narrow, wide) of rows with _need and _second: a row for each series and stretch of time, of a FINE-th of the time that its needed rows span by their frequency."""
    kind = dict(rows.dtypes)[order]
    step = F.col("_second") if kind.startswith(("timestamp", "date")) else F.lit(1)
    width = F.greatest(F.floor(F.col("_need") * step / FINE), F.lit(1))
    seen = rows.withColumn("_seen", F.when(~_missing(F.col(y)), F.col(y))).withColumn("bucket", F.floor(place(F.col(order), kind) / width))
    facts = [c.alias(name) for name, c in of_series("_seen").items()]
    return seen.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.count("_seen").alias("observed"), *facts, F.max("_need").alias("need"), F.min(width).alias("narrow"), F.max(width).alias("wide"))


def cuts(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, low, whole, largest, cut) of a histogram: facts of whole series, and the first bucket that a forecast needs; null: all of them.

    A series whose rows don't agree in their frequency isn't cut. From the cut on there are `need` rows, and before the first of these a bucket with an observed value, from which missing values at their beginning are interpolated.
    """
    later = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
    upto = later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hist.withColumn("_after", F.sum("n").over(upto)).withColumn("_enough", F.col("_after") >= F.max("need").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("_old", F.coalesce(F.lag("_enough").over(later), F.lit(False)))  # a later bucket has enough already
    cut = F.when(F.min("narrow") == F.max("wide"), F.max(F.when(F.col("_old") & (F.col("observed") > 0), F.col("bucket"))))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.bool_and("whole").alias("whole"), F.max("largest").alias("largest"), cut.alias("cut"))


def recent(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """rows without those that are too old to matter, and facts of the whole series, (_f_key..., _f_n, _f_low, _f_whole, _f_largest), to be broadcast; None if nothing is pruned.

    rows: as for PanelForecaster, with _need and _second; rows known ahead stay. The history is read once more, for counts by series and stretch of time that are
    combined before they are shuffled; then only rows from each series' cut on are shuffled. Panels of more than MOST_SERIES series are returned as they are: their cuts can't be broadcast.
    """
    past = rows.filter(~F.col("_ahead"))
    if dict(rows.dtypes)["_order"] in ("string", "boolean", "binary"):
        return rows, None
    found = cuts(histogram(past, keys), keys)
    known = found.limit(MOST_SERIES + 1).collect()
    if len(known) > MOST_SERIES:
        return rows, None
    facts = rows.sparkSession.createDataFrame(known, found.schema)  # used twice
    facts = facts.select(*[F.col(c).alias(f"_f_{c}") for c in facts.columns])
    kind = dict(rows.dtypes)["_order"]
    step = F.col("_second") if kind.startswith(("timestamp", "date")) else F.lit(1)
    bucket = F.floor(place(F.col("_order"), kind) / F.greatest(F.floor(F.col("_need") * step / FINE), F.lit(1)))
    own = rows.join(F.broadcast(facts.select(*[f"_f_{k}" for k in keys], "_f_cut")), [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys], "left")
    kept = own.filter(F.col("_ahead") | F.col("_f_cut").isNull() | F.col("_order").isNull() | (bucket >= F.col("_f_cut"))).select(*rows.columns)
    return kept, facts.drop("_f_cut")
