"""Files of arrays, the ten golden inputs as such files, and scores over a grid of configurations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith.operators import evaluate
from panelith.plans.forecast import forecast
from panelith.sources import npz

GOLDEN = "hourly daily monthly weekly quarterly short two negative constant gaps".split()


def rows(name, arrays):
    return [(name, k, np.asarray(a).dtype.str, list(np.asarray(a).shape), np.ascontiguousarray(a).tobytes()) for k, a in arrays.items()]


def test_golden_inputs_as_files(spark, histories, tmp_path):
    """The inputs and outputs of single calls go to files and come back bit by bit; what numpy writes reads the same, and the files' values give the stored forecasts."""
    stored = []
    for name in GOLDEN:
        y, h, freq = histories[name]
        stored += rows(f"golden/{name} ü%", {"y": y, "horizon": np.array(h), "freq": np.array(freq), "samples": forecast(y, h, freq, 50, seed=42)})
    df = spark.createDataFrame(stored, npz.SCHEMA).withColumn("extra", F.lit(1))
    path = str(tmp_path / "golden")
    npz.write(df, path)
    assert len(list((tmp_path / "golden").glob("*.npz"))) == 10
    back = npz.read(spark, path)
    key = lambda r: (r[0], r[1])
    assert sorted(((*r[:4], bytes(r[4])) for r in back.collect()), key=key) == sorted(stored, key=key)
    for f in (tmp_path / "golden").glob("*.npz"):
        with np.load(f) as a:
            assert np.array_equal(forecast(a["y"], int(a["horizon"]), str(a["freq"]), 50, seed=42), a["samples"])
    values = {name: [r.y for r in npz.panel(back).filter(F.col("series_id") == f"golden/{name} ü%").orderBy("i").collect()] for name in ("gaps", "short")}
    assert values["short"] == [10, 12, 11, 13, 12.5] and sum(v is None for v in values["gaps"]) == 43
    npz.write(df.filter("name = 'y'").limit(3), path)
    assert npz.read(spark, path).count() == 3
    with pytest.raises(Exception, match="series and a name"):
        npz.write(spark.createDataFrame([(None, *stored[0][1:])], npz.SCHEMA), path)


def test_panel_round_trip(spark, tmp_path):
    panel = spark.range(3000).select((F.col("id") % 7).cast("string").alias("series_id"), F.col("id").alias("i"), F.when(F.col("id") % 5 > 0, F.sin("id")).alias("y"))
    npz.write(npz.packed(panel), str(tmp_path / "p"))
    back = npz.panel(npz.read(spark, f"file://{tmp_path}/p"))
    want = [tuple(r) for r in panel.orderBy("series_id", "i").select("series_id", "y").collect()]
    assert [tuple(r) for r in back.orderBy("series_id", "i").select("series_id", "y").collect()] == want


def test_grid_scores(spark):
    rnd = np.random.RandomState(0)
    steps = [(c, s, 0, t, float(a), float(p), n, float(g), *(float(p + d) for d in (-1, 0, 1))) for c in ("x", "y") for s, n in (("a", 2.0), ("b", 0.0), ("c", 1.0)) for t, (a, p, g) in enumerate(rnd.randint(1, 9, (4, 3)))]
    steps += [("x", "a", 0, 4, None, 1.0, 2.0, 1.0, 0.0, 1.0, 2.0), ("x", "a", 0, 5, float("nan"), 1.0, 2.0, 1.0, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(steps, "config string, series_id string, origin int, step int, actual double, pred double, naive double, again double, q1 double, q2 double, q3 double")
    for r in evaluate.grid_scores(df, [0.1, 0.5, 0.9], ["config"]).collect():
        own = [s for s in steps if s[0] == r.config and s[4] is not None and s[4] == s[4]]
        loss = lambda v, a, q: 2 * abs((v - a) * ((a <= v) - q))
        total = sum(abs(s[4]) for s in own)
        for name, at in (("", (8, 9, 10)), ("again_", (7, 7, 7))):
            wql = sum(loss(s[i], s[4], q) for s in own for i, q in zip(at, (0.1, 0.5, 0.9), strict=True)) / 3 / total
            mase = np.mean([np.mean([abs(s[4] - s[at[1]]) for s in own if s[1] == k]) / n for k, n in (("a", 2.0), ("c", 1.0))])
            assert abs(r[f"{name}wql"] - wql) < 1e-12 and abs(r[f"{name}mase"] - mase) < 1e-12
        assert r.n == 3 and r.place in (1, 2)
