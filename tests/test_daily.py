"""What exogenous columns do over panels: known causes help, noise hardly matters; and scores over yearly windows of days."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith import catalogue
from panelith.operators import evaluate
from panelith.plans.forecast import PanelForecaster


def frames(spark, series: dict):
    """history and future of {name: (y, x, ahead)}, x and ahead with a column for each variable."""
    k = next(iter(series.values()))[1].shape[1]
    cols = [f"x{j}" for j in range(k)]
    kinds = ", ".join(f"{c} double" for c in cols)
    past = [(name, i, float(v), *map(float, x[i])) for name, (y, x, _) in series.items() for i, v in enumerate(y)]
    ahead = [(name, i, *map(float, row)) for name, (_, _, a) in series.items() for i, row in enumerate(a)]
    return spark.createDataFrame(past, f"series_id string, ts int, y double, {kinds}"), spark.createDataFrame(ahead, f"series_id string, step int, {kinds}"), cols


def shifts(spark, series: dict, h: int, n: int) -> dict[str, float]:
    """The mean over steps of how far exogenous columns move each series' mean path."""
    past, ahead, cols = frames(spark, series)
    model = PanelForecaster("D", n, seed=42)
    plain = evaluate.point(model.forecast(past.drop(*cols), h))
    known = evaluate.point(model.forecast(past, h, exog=cols, future=ahead)).withColumnRenamed("pred", "known")
    out = plain.join(known, ["series_id", "step"]).groupBy("series_id").agg(F.avg(F.abs(F.col("pred") - F.col("known"))).alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert len(out) == len(series) and all(r.n == h for r in out)
    return {r.series_id: r.d for r in out}


def test_a_cause_moves_its_own_series_alone(spark):
    series = {}
    for s, effect in enumerate((0.0, 4.0, 8.0)):
        r = np.random.RandomState(s)
        x, ahead = np.cumsum(r.normal(0, 1, (300, 1)), axis=0), r.normal(5, 1, (14, 1))
        series[f"e{effect:g}"] = (200 + 10 * np.sin(2 * np.pi * np.arange(300) / 7) + effect * x[:, 0] + r.normal(0, 1, 300), x, ahead)
    moved = shifts(spark, series, 14, 200)
    assert moved["e4"] > 1.0 and moved["e8"] > 1.0 and moved["e0"] < 0.15 * series["e0"][0].std(), moved


def test_noise_moves_little(spark):
    series = {}
    for s in range(20):
        r = np.random.RandomState(s)
        series[f"s{s}"] = (100 + 10 * np.sin(2 * np.pi * np.arange(200) / 7) + r.randn(200), r.randn(200, 3), r.randn(14, 3))
    moved = shifts(spark, series, 14, 100)
    drift = [moved[s] / series[s][0].std() for s in series]
    assert max(drift) < 0.15 and np.mean(drift) < 0.05, drift


def test_daily_backtest(spark, sf_dir):
    scores = catalogue.backtest_daily(spark, sf_dir).toPandas()
    assert len(scores) == 5 * catalogue.DAYS_ORIGINS and np.isfinite(scores.select_dtypes("number").to_numpy()).all()
    mean = scores.filter(like="mae").mean()
    assert mean["mae_exog"] < mean["mae"] and abs(mean["mae_noise"] / mean["mae"] - 1) < 0.05 and mean["mae"] < mean["mae_again"], mean
    assert (scores["mae_exog"] < scores["mae"]).mean() > 0.8
    rep = evaluate.report(spark.createDataFrame(scores[["mase", "mase_exog"]]), "mase", "mase_exog").first()
    assert rep.n == len(scores) and rep.delta_pct < 0


@pytest.mark.parametrize("season", [1, 7, 40])
def test_again_scores(spark, season):
    """Against loops, with a training window of less than a season, a constant series and a null."""
    r = np.random.RandomState(3)
    series = {"a": r.normal(0, 5, 80).tolist(), "flat": [2.0] * 60, "null": [1.0, None, *map(float, range(60))]}
    rows = spark.createDataFrame([(s, i, v) for s, y in series.items() for i, v in enumerate(y)], "series_id string, i int, y double")
    got = {(x.series_id, x.origin): x for x in evaluate.again_scores(evaluate.rolling_origins(rows, 30, 9, 3), season).collect()}
    want = 0
    for s, y in series.items():
        gap = max((len(y) - 39) // 3, 1)
        for k in range(3):
            if k * gap + 39 > len(y):
                continue
            want += 1
            past, ahead = y[k * gap : k * gap + 30], y[k * gap + 30 : k * gap + 39]
            known = [(a, past[30 - season + h % season]) for h, a in enumerate(ahead)] if season <= 30 else [(a, past[h % season - season + 30]) for h, a in enumerate(ahead) if h % season - season + 30 >= 0]
            off = [abs(a - b) for a, b in known if a is not None and b is not None]
            scale = [abs(past[i] - past[i - season]) for i in range(season, 30) if past[i] is not None and past[i - season] is not None]
            x = got[s, k]
            assert x.mae == pytest.approx(np.mean(off)) if off else x.mae is None
            assert x.mase == pytest.approx(np.mean(off) / np.mean(scale)) if off and scale and np.mean(scale) >= evaluate.CLAMP else x.mase is None
    assert want == len(got)
