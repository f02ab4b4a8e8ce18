"""Every query that has SQL against DuckDB on the same tables; the others for rows and finite values. And streams."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelith import catalogue
from panelith.plans.forecast import PanelForecaster
from panelith.sources import panels
from panelith.streaming import live

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(df):
    df = df[sorted(df.columns)]
    return df.apply(lambda c: c.astype(str)).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    own, other = text(catalogue.queries()[name](spark, sf_dir).toPandas()), text(duck.sql(catalogue.oracle_sql()[name]).df())
    assert list(own.columns) == list(other.columns) and len(own) == len(other) > 0
    odd = (own != other).any(axis=1)
    assert not odd.any(), f"{own[odd].head()}\n{other[odd].head()}"


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, sf_dir, name):
    rows = catalogue.queries()[name](spark, sf_dir).toPandas()
    assert len(rows) and np.isfinite(rows.select_dtypes("number").to_numpy()).all()


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.5), ("2024-01-01 01:00:00", None)], "at string, y double")
    panels.write_table(df, str(tmp_path / "x"), "csv")
    back = panels.read_csv(spark, str(tmp_path / "x"), "at", "yyyy-MM-dd HH:mm:ss").orderBy("at").toPandas()
    assert back["y"].isna().tolist() == [False, True] and back["at"].iloc[1].hour == 1
    noise = panels.with_noise(spark.range(20000).selectExpr("'a' AS series_id", "id AS i"), ["n1", "n2"]).agg(F.avg("n1"), F.stddev("n1"), F.corr("n1", "n2")).first()
    assert np.allclose(noise, [0, 1, 0], atol=0.03)


def test_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = live.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", "ts")
    counts = live.windowed_counts(events, "event_type", "ts")
    got = []
    run = live.reforecast(stream, lambda: counts.limit(0), PanelForecaster("H", 10), 3, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    run.awaitTermination(120)
    assert {r["series_id"] for r in got} == {r[0] for r in counts.select("series_id").distinct().collect()} and counts.agg(F.sum("y")).first()[0] == events.count()
