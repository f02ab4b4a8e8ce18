"""Scans over a series in blocks of time, so that one huge series keeps all cores busy: no window here runs over a whole series' rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import MOST_PERIODS
from panelith.operators.clean import _missing
from panelith.operators.prune import place

#: Rows of a block, about; cells of time that blocks are made of. The cells' counts are all that the driver sees.
BLOCK_ROWS, CELLS = 500_000, 4096


def cut(df: DataFrame, order: str = "ts", rows: int = BLOCK_ROWS, out: str = "block") -> DataFrame:
    """df with the block of each row, a number that rises with order (a time, a date or a number; null: block 0).

    The table's span is cut into CELLS equal cells, whose counts (one aggregation) say which neighbouring cells make a block of about `rows` rows; so a block has that many
    rows of any series at most, but for cells that hold more themselves. Rows of one time are never parted. Where a row belongs depends on its time alone, so a task that runs again gives the same.
    """
    kind = dict(df.dtypes)[order]
    x = place(F.col(order), kind)
    first, last = df.agg(F.min(x), F.max(x)).first()
    if first is None or first == last:
        return df.withColumn(out, F.lit(0))
    width = (last - first) / CELLS
    cell = F.coalesce(F.least(F.floor((x - F.lit(first)) / F.lit(width)), F.lit(CELLS - 1)), F.lit(0)).cast("int")
    counts = {r["c"]: r["n"] for r in df.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    block, held, of_cell = 0, 0, []
    for c in range(CELLS):
        n = counts.get(c, 0)
        if held and held + n > rows:
            block, held = block + 1, 0
        held += n
        of_cell.append(block)
    return df.withColumn(out, F.element_at(F.from_json(F.lit(json.dumps(of_cell)), "array<int>"), cell + 1))  # folded to one literal


def _carried(df: DataFrame, keys: list[str], facts: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """df with carries, windows over blocks (ordered, by series) of facts, aggregates by series and block. Only a row for each block of a series meets the others."""
    own = df.groupBy(*keys, "block").agg(*[c.alias(name) for name, c in facts.items()])
    own = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "block"])], *[c.alias(name) for name, c in carries.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "block"])]
    return df.join(own, same, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def _windows(keys: list[str]) -> tuple[Window, Window, Window]:
    """Over a series' blocks: those before, those after (the next one last), all."""
    w = Window.partitionBy(*keys)
    return w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), w


def index_series(df: DataFrame, series: str | Sequence[str] = "series_id", order: str | Sequence[str] = "ts") -> DataFrame:
    """df (with block) with i, the 0-based place in the series, and n, its length. order: columns, the first that of cut()."""
    keys, order = [series] if isinstance(series, str) else list(series), [order] if isinstance(order, str) else list(order)
    before, _, all_ = _windows(keys)
    rows = _carried(df, keys, {"_n": F.count(F.lit(1))}, {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(all_)})
    place_ = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order))
    return rows.withColumn("i", (F.col("_before") + place_ - 1).cast("long")).drop("_before")


def interpolate(df: DataFrame, y: str = "y", fallback: float = 0.0, series: str | Sequence[str] = "series_id", order: str = "i") -> DataFrame:
    """clean.interpolate() of rows with block: each block is scanned alone, and takes the last value before it and the first after it from one row a block."""
    keys = [series] if isinstance(series, str) else list(series)
    point = F.when(~_missing(F.col(y)), F.struct(F.col(order).alias("i"), F.col(y).cast("double").alias("y")))
    before, after, _ = _windows(keys)
    rows = _carried(df, keys, {"_first": F.min(point), "_last": F.max(point)}, {"_from": F.last("_last", ignorenulls=True).over(before), "_to": F.last("_first", ignorenulls=True).over(after)})
    w = Window.partitionBy(*keys, "block")
    nearest = lambda by: F.last(point, ignorenulls=True).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_a", F.coalesce(nearest(F.asc(order)), "_from")).withColumn("_b", F.coalesce(nearest(F.desc(order)), "_to"))
    a, b = F.col("_a"), F.col("_b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col(order) - a["i"]) / (b["i"] - a["i"])
    value = F.when(a["i"] == b["i"], a["y"]).when(a.isNotNull() & b.isNotNull(), line).otherwise(F.coalesce(a["y"], b["y"], F.lit(fallback)))
    return rows.withColumn(y, value).drop("_a", "_b", "_from", "_to")


def positivity_shift(df: DataFrame, series: str | Sequence[str] = "series_id") -> DataFrame:
    """clean.positivity_shift() with the least value from blocks' least values."""
    keys = [series] if isinstance(series, str) else list(series)
    rows = _carried(df, keys, {"_low": F.min("y")}, {"_low": F.min("_low").over(_windows(keys)[2])})
    return rows.withColumn("shift", F.greatest(1 - F.col("_low"), F.lit(1.0))).withColumn("y", F.col("y") + F.col("shift")).drop("_low")


def truncate(df: DataFrame, p: int, most: int = MOST_PERIODS) -> DataFrame:
    """fold.truncate() of rows with i and n, by arithmetic alone."""
    long, drop = F.expr(f"n div {p}") > most, F.col("n") - most * p
    rows = df.filter(~long | (F.col("i") >= drop))
    return rows.withColumn("i", F.when(long, F.col("i") - drop).otherwise(F.col("i"))).withColumn("n", F.when(long, F.lit(most * p)).otherwise(F.col("n")))


def fold(df: DataFrame, p: int, series: str | Sequence[str] = "series_id") -> DataFrame:
    """fold.fold() of rows with i and n, by arithmetic alone."""
    keys = [series] if isinstance(series, str) else list(series)
    rows = df.withColumn("nc", F.expr(f"cast(n div {p} as int)")).withColumn("_j", F.col("i") - (F.col("n") - F.col("nc") * p)).filter("_j >= 0")
    return rows.select(*keys, "nc", F.expr(f"cast(_j div {p} as int)").alias("period_idx"), (F.col("_j") % p).cast("int").alias("phase"), "y")
