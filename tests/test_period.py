"""A held period: busy tables, whose noise hides the season, give what the SQL says."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelith import catalogue
from panelith.operators.kernel import choose_period, need
from panelith.plans.forecast import PanelForecaster, forecast


@pytest.fixture(scope="module")
def busy(tmp_path_factory):
    """The events of sf0.01, each 20 times."""
    out = str(tmp_path_factory.mktemp("busy"))
    duckdb.sql(f"COPY (SELECT event_id + k * 1000000 AS event_id, * EXCLUDE (event_id) FROM '/root/testdata/sf0.01/events.parquet', (SELECT unnest(range(20)) AS k)) TO '{out}/events.parquet'")
    return out


@pytest.mark.parametrize("name", ["forecast_samples", "forecast_quantiles", "forecast_sql"])
def test_busy_tables(spark, busy, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{busy}/events.parquet'")
    own, want = catalogue.queries()[name](spark, busy).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    key = [c for c in own.columns if c != "value"]
    pd.testing.assert_frame_equal(own.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False, rtol=0, atol=1e-9)


def test_held_period(histories):
    noise = 100 + np.random.RandomState(0).normal(0, 5, 720)
    assert choose_period(noise, 720, "H").p == 1 and choose_period(noise, 720, "H", 24).p == 24
    assert choose_period(noise[:40], 40, "H", 24).p == 1  # under three periods
    y, h, freq = histories["hourly"]
    assert np.array_equal(forecast(y, h, freq, 5, seed=1), forecast(y, h, freq, 5, seed=1, period=24))
    assert np.isfinite(forecast(noise, 48, "H", 5, seed=1, period=1)).all()
    assert need("M", 6, 100) == 50000 and need("M", 6) == 6000
    for wrong in (0, 1.5, True):
        with pytest.raises((ValueError, TypeError), match="period must be"):
            PanelForecaster("H", period=wrong)
