"""Point forecasts, intervals, metrics, backtests and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.functions.calendar import season_of

CLAMP = 1e-12


def naive_error(history: DataFrame, season: int, series: str = "series_id") -> DataFrame:
    """(series, naive): the mean absolute error of repeating the value a season ago; null in series no longer than that."""
    w = Window.partitionBy(series).orderBy("i")
    return history.withColumn("_e", F.abs(F.col("y") - F.lag("y", season).over(w))).groupBy(series).agg(F.avg("_e").alias("naive"))


def mase(forecasts: DataFrame, naive: DataFrame, guard: str = "missing", series: str = "series_id") -> DataFrame:
    """(series, mase) of (series, step, actual, pred). guard: 'missing' gives null where naive is under CLAMP, 'clamp' holds it there, 'none' divides."""
    mae = forecasts.groupBy(series).agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("_mae")).join(naive, series)
    below = {"missing": F.when(F.col("naive") >= CLAMP, F.col("naive")), "clamp": F.greatest("naive", F.lit(CLAMP)), "none": F.col("naive")}[guard]
    return mae.select(series, F.try_divide(F.col("_mae"), below).alias("mase"))


def smape_of(actual: Column, pred: Column) -> Column:
    return 100 * F.avg(F.abs(actual - pred) / F.greatest((F.abs(actual) + F.abs(pred)) / 2, F.lit(1e-8)))


def errors(forecasts: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, mae, smape)."""
    a, p = F.col("actual"), F.col("pred")
    return forecasts.groupBy(series).agg(F.avg(F.abs(a - p)).alias("mae"), smape_of(a, p).alias("smape"))


def rolling_origins(history: DataFrame, train: int | str, horizon: int | str, n_origins: int, series: str | Sequence[str] = "series_id", keep: Sequence[str] = ()) -> DataFrame:
    """train and horizon: numbers, or columns with each series' own. Rows of each origin's training (part 'train') and test window (part 'test'), with origin, the place at in the part, y and the columns in keep.

    Origins start at train + k * step with step = (n - train - horizon) div n_origins, 1 at least. The first and the last origin whose
    window holds a row come from its place by arithmetic, so a row is made once for each of these alone.
    """
    keys = [series] if isinstance(series, str) else list(series)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    train, horizon = (F.col(x).cast("long") if isinstance(x, str) else F.lit(x) for x in (train, horizon))
    rows = history.withColumn("_n", n).withColumn("_step", F.greatest(F.floor((F.col("_n") - train - horizon) / n_origins), F.lit(1)))
    rows = rows.withColumn("_lo", F.greatest(F.lit(0), F.ceil((F.col("i") - (train + horizon - 1)) / F.col("_step"))).cast("int"))
    last = F.floor((F.col("_n") - train - horizon) / F.col("_step"))
    rows = rows.withColumn("_hi", F.least(F.lit(n_origins - 1), F.floor(F.col("i") / F.col("_step")), last).cast("int")).filter("_lo <= _hi")
    rows = rows.withColumn("origin", F.explode(F.sequence("_lo", "_hi"))).withColumn("_at", F.col("i") - F.col("origin") * F.col("_step"))
    test = F.col("_at") >= train
    return rows.select(*keys, "origin", F.when(test, "test").otherwise("train").alias("part"), F.when(test, F.col("_at") - train).otherwise(F.col("_at")).cast("long").alias("at"), "y", *keep)


def scores(forecasts: DataFrame, keys: Sequence[str], guard: str = "missing", extra: Sequence[Column] = ()) -> DataFrame:
    """(keys, mase, mae, smape) of (keys, step, actual, pred, naive) in one aggregation; naive is the same in all rows of a key. guard: as in mase(). extra: further aggregates."""
    a, p = F.col("actual"), F.col("pred")
    known = F.when(~F.isnan("naive"), F.col("naive"))
    below = {"missing": F.when(known >= CLAMP, known), "clamp": F.greatest(known, F.lit(CLAMP)), "none": known}[guard]
    out = forecasts.withColumn("actual", F.when(~F.isnan("actual"), a)).groupBy(*keys).agg(F.avg(F.abs(a - p)).alias("mae"), smape_of(a, p).alias("smape"), F.first(below).alias("_below"), *extra)
    return out.withColumn("mase", F.try_divide(F.col("mae"), F.col("_below"))).drop("_below")


def again_scores(windows: DataFrame, season: int, series: str | Sequence[str] = "series_id", guard: str = "missing") -> DataFrame:
    """(series, origin, mase, mae, smape) of the value a season ago over the windows of rolling_origins(): what a backtest is held against.

    A training window of less than a season has no such value; its scores are null, as where the scale is under the guard. Only the last season
    of each training window is joined to its test window.
    """
    own = [*([series] if isinstance(series, str) else series), "origin"]
    w = Window.partitionBy(*own, "part").orderBy("at")
    rows = windows.withColumn("_e", F.abs(F.col("y") - F.lag("y", season).over(w))).withColumn("_back", F.max("at").over(Window.partitionBy(*own, "part")) - F.col("at"))
    train = rows.filter("part = 'train'")
    scale = train.groupBy(*own).agg(F.avg("_e").alias("naive"))
    tail = train.filter(F.col("_back") < season).select(*own, (season - 1 - F.col("_back")).alias("_pos"), F.col("y").alias("pred"))
    test = windows.filter("part = 'test'").select(*own, F.col("at").alias("step"), F.col("y").alias("actual"), F.pmod("at", F.lit(season)).alias("_pos"))
    return scores(test.join(tail, [*own, "_pos"], "left").join(scale, own, "left"), own, guard).select(*own, "mase", "mae", "smape")


def report(scores: DataFrame, base: str, other: str) -> DataFrame:
    """One row: means of two columns of scores, other's change in percent, other's wins, the worst inflation and the count."""
    b, o = F.avg(base), F.avg(other)
    return scores.agg(b.alias("mean_base"), o.alias("mean_other"), (100 * (o / b - 1)).alias("delta_pct"), F.count_if(F.col(other) < F.col(base)).alias("wins"), F.max(F.col(other) / F.col(base) - 1).alias("worst"), F.count(F.lit(1)).alias("n"))


def point(samples: DataFrame, how: str = "mean", keys: Sequence[str] = ("series_id", "step")) -> DataFrame:
    """(keys, pred): the mean or the median of the sample paths."""
    return samples.groupBy(*keys).agg((F.avg("value") if how == "mean" else F.median("value")).alias("pred"))


def quantiles(samples: DataFrame, levels: Sequence[float], keys: Sequence[str] = ("series_id", "step")) -> DataFrame:
    """(keys, quantile, value): exact quantiles with linear interpolation."""
    q = F.percentile("value", F.array(*[F.lit(float(x)) for x in levels]))
    rows = samples.groupBy(*keys).agg(q.alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(x)) for x in levels]).alias("quantile"), F.col("_q").alias("value"))
    return rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.quantile", "_p.value")


def median_mase(forecasts: DataFrame, history: DataFrame, freq: str, series: str = "series_id") -> DataFrame:
    """(series, mase) of the 0.5 quantile in (series, step, quantile, value, actual), scaled by the season of the frequency."""
    middle = forecasts.filter(F.abs(F.col("quantile") - 0.5) < 1e-9).withColumnRenamed("value", "pred")
    return mase(middle, naive_error(history, season_of(freq), series), "missing", series)


def by_config(forecasts: DataFrame, history: DataFrame, freq: str, config: str = "config", series: str = "series_id") -> DataFrame:
    """(config, mase, wql): over the series of each configuration the mean of median_mase(), and the quantile loss over all their values.

    forecasts: (config, series, step, quantile, value, actual); history: (series, i, y).
    """
    own = F.struct(config, series)
    each = median_mase(forecasts.withColumn("_key", own), forecasts.select(config, series).distinct().join(history, series).withColumn("_key", own), freq, "_key")
    scores = each.groupBy(F.col(f"_key.{config}").alias(config)).agg(F.avg("mase").alias("mase"))
    return scores.join(quantile_loss(forecasts, config), config)


def leaderboard(results: DataFrame, baseline: DataFrame, metrics: Sequence[str] = ("mase", "wql"), config: str = "config") -> DataFrame:
    """One row: geometric means of each metric, and of the metric over the baseline's (relative_...), with the configurations that have all of these (matched) and all (n)."""
    base = baseline.select(config, *[F.col(m).alias(f"_{m}") for m in metrics])
    rows = results.join(base, config, "left").withColumns({f"_{m}": F.try_divide(F.col(m), F.col(f"_{m}")) for m in metrics})
    whole = [F.col(f"_{m}").isNotNull() for m in metrics]
    matched = F.count_if(reduce(and_, whole))
    return rows.agg(*[geometric_mean(F.col(m)).alias(m) for m in metrics], *[geometric_mean(F.col(f"_{m}")).alias(f"relative_{m}") for m in metrics], matched.alias("matched"), F.count(F.lit(1)).alias("n"))


def quantile_loss(forecasts: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, wql) of (series, step, quantile, value, actual): the mean over quantiles of twice the pinball loss over the actuals' absolute sum."""
    err = F.col("value") - F.col("actual")
    loss = 2 * F.sum(F.abs(err * ((F.col("actual") <= F.col("value")).cast("double") - F.col("quantile")))) / F.sum(F.abs("actual"))
    return forecasts.groupBy(series, "quantile").agg(loss.alias("_l")).groupBy(series).agg(F.avg("_l").alias("wql"))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(F.greatest(x, F.lit(1e-10)))))


def relative(scores: DataFrame, baseline: DataFrame, metric: str, key: str) -> DataFrame:
    """One row: the geometric mean of metric over the baseline's, over the keys that both have, and how many."""
    joined = scores.select(key, metric).join(baseline.select(key, F.col(metric).alias("_base")), key, "left").withColumn("_r", F.try_divide(F.col(metric), F.col("_base")))
    return joined.filter("_r is not null").agg(geometric_mean(F.col("_r")).alias("relative"), F.count(F.lit(1)).alias("matched"))


def grid_scores(steps: DataFrame, levels: Sequence[float], config: Sequence[str], series: Sequence[str] = ("series_id", "origin")) -> DataFrame:
    """(config, mase, wql, again_mase, again_wql, relative_mase, relative_wql, n, place) of PanelForecaster.backtest(output='steps', quantiles=levels).

    Each configuration (say, a data set and a term) is scored over its series: the mean MASE of the 0.5 quantile and the quantile loss over all values; the same for the value a season
    ago, which is its own quantile at all levels; their ratios; and its place by relative_wql. Steps without an actual value don't count, nor series without a naive error in the MASE.
    """
    a = F.col("actual")
    rows = steps.filter(a.isNotNull() & ~F.isnan(a))
    scale = F.when(~F.isnan("naive") & (F.col("naive") >= CLAMP), F.col("naive"))
    pinball = lambda v, q: 2 * F.abs((v - a) * ((a <= v).cast("double") - q))
    loss = sum((pinball(F.col(f"q{i + 1}"), q) for i, q in enumerate(levels)), F.lit(0.0)) / len(levels)
    flat = sum((pinball(F.col("again"), q) for q in levels), F.lit(0.0)) / len(levels)
    half = F.col(f"q{list(levels).index(0.5) + 1}") if 0.5 in levels else F.col("pred")
    each = rows.groupBy(*config, *series).agg(F.try_divide(F.avg(F.abs(a - half)), F.first(scale)).alias("m"), F.try_divide(F.avg(F.abs(a - F.col("again"))), F.first(scale)).alias("o"), F.sum(loss).alias("l"), F.sum(flat).alias("f"), F.sum(F.abs(a)).alias("t"))
    out = each.groupBy(*config).agg(F.avg("m").alias("mase"), F.try_divide(F.sum("l"), F.sum("t")).alias("wql"), F.avg("o").alias("again_mase"), F.try_divide(F.sum("f"), F.sum("t")).alias("again_wql"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("relative_mase", F.try_divide("mase", "again_mase")).withColumn("relative_wql", F.try_divide("wql", "again_wql"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.col("relative_wql").asc_nulls_last())))  # a row a configuration
