"""Forecasts that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, Row, StructType

from panelith.operators.clean import validate_request
from panelith.operators.kernel import Tail, need, sample_paths
from panelith.plans.forecast import seed_of
from panelith.shipping import ship

#: Values that are held before they join the tail of their series.
_BATCH = 4096


class Forecast:
    """forecast(TABLE(...) PARTITION BY series ORDER BY (ts), horizon, freq[, n_samples[, seed[, period]]]): (series, sample_id, step, value) of each series.

    The table's first column is the series, its last the values (null or NaN where missing); it is read a row at a time in the order of its ORDER BY, in the memory of the rows that a forecast looks
    back on. Without a seed, that of the series; without a period, the one that its values choose. A panel's DataFrame call is faster; results are the same.
    """

    def __init__(self) -> None:
        self._tail: Tail | None = None
        self._new: list[float] = []

    @staticmethod
    def analyze(panel: AnalyzeArgument, horizon: AnalyzeArgument, freq: AnalyzeArgument, n_samples: AnalyzeArgument | None = None, seed: AnalyzeArgument | None = None, period: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not panel.isTable or not isinstance(panel.dataType, StructType) or len(panel.dataType) < 2:
            raise ValueError("the first argument must be a table of series and values")
        validate_request(horizon.value, freq.value, 200 if n_samples is None else n_samples.value, period=None if period is None else period.value)
        key = panel.dataType.fields[0]
        out = StructType().add(key.name, key.dataType).add("sample_id", IntegerType()).add("step", IntegerType()).add("value", DoubleType())
        return AnalyzeResult(schema=out)

    def eval(self, panel: Row, horizon: int, freq: str, n_samples: int = 200, seed: int | None = None, period: int | None = None) -> None:
        if self._tail is None:
            self._tail = Tail(need(freq, horizon, period))
            self._key, self._asked = panel[0], (horizon, freq, n_samples, seed, period)
        value = panel[-1]
        self._new.append(np.nan if value is None else float(value))
        if len(self._new) >= _BATCH:
            self._tail.extend(np.array(self._new))
            self._new = []

    def terminate(self) -> Iterator[tuple]:
        if self._tail is None:
            return
        self._tail.extend(np.array(self._new))
        horizon, freq, n_samples, seed, period = self._asked
        paths = sample_paths(self._tail.series(horizon), horizon, freq, n_samples, seed_of(self._key) if seed is None else seed, period=period)
        for i, path in enumerate(paths.tolist()):
            for step, value in enumerate(path):
                yield self._key, i, step, value


def register(spark: SparkSession, name: str = "forecast") -> None:
    """Make the forecast callable in SQL, under a name."""
    ship(spark)
    spark.udtf.register(name, udtf(Forecast))
