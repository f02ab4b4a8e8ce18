"""Forecasts called from SQL, and streams that keep the ends of their series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelith.operators.kernel import Series, Tail
from panelith.plans import sql
from panelith.plans.forecast import PanelForecaster
from panelith.streaming import live


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-100, 100)), min_size=1, max_size=60), st.integers(1, 30), st.integers(1, 12))
def test_tail_is_the_end_of_the_series(values, most, step):
    raw = np.array([np.nan if v is None else float(v) for v in values])
    tail = Tail(most)
    for i in range(0, len(raw), step):
        tail.extend(raw[i : i + step])
    own, whole = tail.series(3), Series.of(raw, 3)
    k = min(most, len(raw))
    assert (own.n, own.low, own.whole, own.shift) == (whole.n, whole.low, whole.whole, whole.shift) and len(own.y) == k
    assert np.allclose(own.y, whole.y[-k:]) and (k < 50 or np.array_equal(own.recent, whole.recent))


@pytest.fixture(scope="module")
def panel(spark, histories):
    rows = [(k, i, None if np.isnan(v) else float(v)) for k in ("daily", "gaps", "short", "negative", "missing", "one") for i, v in enumerate(histories[k][0])]
    return spark.createDataFrame(rows, "series_id string, d int, y double").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400).cast("timestamp_ntz")).select("series_id", "ts", "y")


def test_sql_call(spark, panel):
    sql.register(spark)
    panel.repartition(5).createOrReplaceTempView("panel")
    own = spark.sql("SELECT * FROM forecast(TABLE(panel) PARTITION BY series_id ORDER BY (ts), 7, 'D', 10)")
    key = ["series_id", "sample_id", "step"]
    want = PanelForecaster("D", 10).forecast(panel, 7)
    assert own.columns == want.columns
    pd.testing.assert_frame_equal(own.orderBy(*key).toPandas(), want.orderBy(*key).toPandas(), rtol=1e-9, atol=1e-9)
    named = spark.sql("SELECT max(value) - min(value) AS d, count(*) AS n FROM forecast(TABLE(SELECT * FROM panel WHERE series_id = 'daily') PARTITION BY series_id ORDER BY (ts), horizon => 3, freq => 'D', n_samples => 5, seed => 1)").first()
    assert named.n == 15 and named.d > 0
    assert spark.sql("SELECT * FROM forecast(TABLE(SELECT * FROM panel WHERE false) PARTITION BY series_id ORDER BY (ts), 7, 'D')").count() == 0
    with pytest.raises(Exception, match="horizon must be >= 1"):
        spark.sql("SELECT * FROM forecast(TABLE(panel) PARTITION BY series_id ORDER BY (ts), 0, 'D')").count()


def test_stream_keeps_ends(spark, sf_dir, tmp_path):
    """Three batches give, after each, what a call over all rows so far gives; counts of a stream of events, through a watermark, go on without reading history."""
    counts = live.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts"), "event_type", "ts", "12 hours").orderBy("ts").toPandas()
    cuts = [0, len(counts) // 2, len(counts) - 40, len(counts)]
    model = PanelForecaster("A", 5)
    (tmp_path / "in").mkdir()
    schema = "series_id string, ts timestamp_ntz, y double"
    seen = None
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = counts.iloc[a:b]
        if i:
            batch = pd.concat([counts.iloc[:7], batch])  # late rows, which are in the state already
        batch.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "in" / f"{i}.parquet", index=False)
        out = live.renewed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), model, 3, [0.5])
        got: list = []
        out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start().awaitTermination(200)
        want = model.forecast(spark.createDataFrame(counts.iloc[:b], schema), 3, output="quantiles", quantiles=[0.5]).collect()
        touched = set(counts.iloc[a:b]["series_id"])
        key = lambda r: (r.series_id, r.step)
        own, other = sorted(got, key=key), sorted((r for r in want if r.series_id in touched), key=key)
        assert [key(r) for r in own] == [key(r) for r in other] and np.allclose([r.value for r in own], [r.value for r in other])
        seen = {r.series_id: r.n for r in own}
    assert seen == {k: int(v) for k, v in counts.groupby("series_id").size().items() if k in seen}
