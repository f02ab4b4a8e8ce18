"""Series forecast together give what each gives alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith.operators import stacked
from panelith.operators.kernel import Series, sample_paths
from panelith.operators.stacked import stacks
from panelith.plans import forecast as plans
from panelith.plans.forecast import PanelForecaster
from panelith.sources import panels


def many():
    """Values of 12 lengths, with and without a season, gaps, whole numbers and negative ones."""
    r = np.random.RandomState(0)
    out = []
    for i in range(120):
        n = [1, 5, 9, 12, 20, 37, 40, 60, 64, 80, 150, 400][i % 12]
        y = 50 * np.sin(np.arange(n) * 2 * np.pi / 12) * (i % 3) + r.normal(20, 10, n)
        y = np.rint(y) if i % 4 == 0 else y
        if i % 5 == 0:
            y[r.random(n) < 0.3] = np.nan
        out.append(np.exp(y / 40) if i % 7 == 0 else np.full(n, 3.0) if i % 29 == 1 else y)
    return out


@pytest.mark.parametrize(("freq", "period", "room"), [("M", None, 1 << 20), ("H", None, 1 << 14), ("D", None, 1 << 20), ("Q", None, 1 << 20), ("Y", None, 1 << 20), ("M", 7, 1 << 20), ("M", 1, 1 << 20)])
def test_together_as_alone(monkeypatch, freq, period, room):
    monkeypatch.setattr(stacked, "ROOM", room)
    series = [Series.of(y, 15) for y in many()]
    found = {}
    for at, paths in stacks(series, 15, freq, 20, list(range(len(series))), period=period):
        assert not found.keys() & set(at)
        found |= dict(zip(at, paths, strict=True))
    assert len(found) > 60
    for i, paths in found.items():
        assert np.allclose(paths, sample_paths(series[i], 15, freq, 20, i, period=period), rtol=1e-7, atol=1e-7), i


def test_calls_do_not_grow_with_series(monkeypatch, spark):
    """3,000 short series of a panel come from a few stacks, the very short ones from calls of their own."""
    calls = []
    monkeypatch.setattr("panelith.operators.stacked._paths", lambda *a, own=stacked._paths: calls.append(len(a[0])) or own(*a))
    series = [Series.of(np.random.RandomState(i).gamma(2, 10, 40), 6) for i in range(3000)]
    assert sum(len(at) for at, _ in stacks(series, 6, "M", 10, list(range(3000)))) == 3000 and len(calls) < 30
    rows = [(str(i), j, float((i * 7919 + j * j * 31) % 101)) for i in range(50) for j in range(1 + i)]
    panel = spark.createDataFrame(rows, "series_id string, ts int, y double")
    together = PanelForecaster("M", 10).forecast(panel, 4).orderBy("series_id", "sample_id", "step").toPandas()
    for k in ("0", "3", "12", "49"):
        alone = plans.forecast([y for s, _, y in rows if s == k], 4, "M", 10, plans.seed_of(k))
        assert np.allclose(together[together["series_id"] == k]["value"].to_numpy().reshape(10, 4), alone, rtol=1e-7, atol=1e-7)


def test_missing_at_the_cut(spark):
    """Of what is older than a forecast looks back, only the last observed row comes along: missing values at the beginning are interpolated from it."""
    r = np.random.RandomState(3)
    y = r.gamma(3, 10, 640)
    y[120:150] = np.nan  # "A" looks back on 500 rows, from 140 on
    own = PanelForecaster("A", 10, seed=1).forecast(spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "series_id string, ts int, y double"), 4)
    got = own.orderBy("sample_id", "step").toPandas()["value"].to_numpy().reshape(10, 4)
    assert np.allclose(got, plans.forecast(y, 4, "A", 10, seed=1), rtol=1e-9)


def test_sums_fill_without_a_join(spark):
    """The filled panel is what the sums joined to each series' units give; but it isn't shuffled, and nothing is joined."""
    rows = spark.createDataFrame(
        [("a", "2024-01-31 10:00:00", 1.0), ("a", "2024-01-01 00:00:00", 2.0), ("a", "2024-05-02 00:00:00", None), ("a", "2024-06-02 00:00:00", 4.0), ("b", "2023-12-31 23:59:59", 5.0), ("a", None, 9.0), ("c", None, 9.0), (None, "2024-01-05 00:00:00", 7.0), (None, "2024-03-05 00:00:00", 7.0)],
        "k string, t string, v double",
    ).selectExpr("k", "t::timestamp_ntz AS t", "v")
    for unit in ("month", "day", "hour"):
        c = rows.groupBy(F.col("k").alias("series_id"), panels.truncate_ts(F.col("t"), unit).alias("ts")).agg(F.sum("v").alias("y"))
        want = panels.spine(c, unit).join(c, ["series_id", "ts"], "left")
        own = panels.sums(rows, "k", "t", "v", unit)
        assert own.columns == want.columns and own.exceptAll(want).count() == want.exceptAll(own).count() == 0
        assert "Join" not in own._jdf.queryExecution().executedPlan().toString()
