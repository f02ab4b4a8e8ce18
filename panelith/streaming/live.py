"""Counts from a stream of events, and forecasts renewed with each batch of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from panelith.operators.kernel import Tail, need, sample_paths
from panelith.plans.forecast import PanelForecaster, seed_of
from panelith.shipping import ship

#: The state store that stateful processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windowed_counts(events: DataFrame, series: str, ts: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(series_id, ts, y) of a stream (or a table) of events: counts by tumbling window; rows later than the watermark are dropped from a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    out = rows.groupBy(F.col(series).alias("series_id"), F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return out.select("series_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), "y")


def reforecast(counts: DataFrame, history: Callable[[], DataFrame], forecaster: PanelForecaster, horizon: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Forecast again, with each batch of finished windows, the series that the batch touches. history: reads the panel so far; sink: takes the quantiles and the batch's number."""

    def batch(new: DataFrame, number: int) -> None:
        touched = new.select("series_id").distinct()
        known = history().join(touched, "series_id", "left_semi").select("series_id", "ts", "y")
        rows = known.unionByName(new.select("series_id", "ts", "y")).dropDuplicates(["series_id", "ts"])
        sink(forecaster.forecast(rows, horizon, output="quantiles"), number)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


class _Renewed(StatefulProcessor):
    """Keeps the tail of each series, and forecasts it again when rows come."""

    def __init__(self, model: PanelForecaster, horizon: int, levels: list[float]) -> None:
        self._model, self._horizon, self._levels = model, horizon, levels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("tail", "n long, low double, whole boolean, place long, value double, last timestamp, tail binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        tail, last = Tail(need(self._model.freq, self._horizon, self._model.period)), None
        if self._state.exists():
            n, low, whole, place, value, last, held = self._state.get()
            tail = Tail(tail.most, np.frombuffer(held, "<f8"), n, np.nan if low is None else low, whole, None if place is None else (place, value))
            new = new[new["ts"] > pd.Timestamp(last)]
        if not len(new):
            return
        tail.extend(new["y"].to_numpy(dtype=np.float64))
        last = new["ts"].iloc[-1].to_pydatetime()
        low = None if np.isnan(tail.low) else tail.low
        self._state.update((tail.n, low, tail.whole, *(tail.before or (None, None)), last, tail.values.astype("<f8").tobytes()))
        seed = seed_of(key[0]) if self._model.seed is None else self._model.seed
        paths = sample_paths(tail.series(self._horizon), self._horizon, self._model.freq, self._model.n_samples, seed, None, self._model.noise, self._model.period)
        bands = np.quantile(paths, self._levels, axis=0)
        k, h = bands.shape
        yield pd.DataFrame({"series_id": key[0], "n": tail.n, "step": np.tile(np.arange(h, dtype=np.int32), k), "quantile": np.repeat(self._levels, h), "value": bands.ravel()})

    def close(self) -> None:
        pass


def renewed(counts: DataFrame, forecaster: PanelForecaster, horizon: int, quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(series_id, n, step, quantile, value) of a stream (series_id, ts, y): the bands of each series that a batch touches, after its n-th row.

    The state of a series is the end that a forecast looks back on, need() rows at most, and facts of what is older: no batch reads the history again, and a restarted query goes on from its
    checkpoint. Rows that aren't later than the last of their series are dropped. Needs the state store STORE.
    """
    spark = counts.sparkSession
    ship(spark)
    spark.conf.set(*STORE)
    rows = counts.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("y").cast("double").alias("y"))
    kind = dict(counts.dtypes)["series_id"]
    schema = f"series_id {kind}, n long, step int, quantile double, value double"
    return rows.groupBy("series_id").transformWithStateInPandas(_Renewed(forecaster, horizon, [float(q) for q in quantiles]), schema, "Append", "None")
