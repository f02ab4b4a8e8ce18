"""A Spark session for all tests."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def histories():
    """Named histories: (values, horizon, frequency)."""
    r = lambda s: np.random.RandomState(s)
    t = lambda n: np.arange(n, dtype=float)
    wave = lambda n, p: np.sin(2 * np.pi * t(n) / p)
    holes = r(6)
    gaps = 50 + 10 * wave(100, 7) + holes.normal(0, 2, 100)
    gaps[holes.random(100) < 0.3] = np.nan
    return {
        "hourly": (100 + 20 * wave(500, 24) + r(0).normal(0, 3, 500), 48, "H"),
        "daily": (50 + 10 * wave(200, 7) + r(1).normal(0, 2, 200), 14, "D"),
        "monthly": (1000 + 200 * wave(120, 12) + r(2).normal(0, 30, 120), 12, "M"),
        "weekly": (500 + 100 * wave(156, 52) + r(3).normal(0, 15, 156), 26, "W"),
        "quarterly": (2000 + 300 * wave(40, 4) + r(4).normal(0, 50, 40), 4, "Q"),
        "short": (np.array([10, 12, 11, 13, 12.5]), 7, "D"),
        "two": (np.array([100.0, 110]), 3, "M"),
        "one": (np.array([5.0]), 3, "D"),
        "negative": (-30 + r(5).normal(0, 5, 100), 7, "D"),
        "constant": (np.full(100, 42.0), 24, "H"),
        "gaps": (gaps, 7, "D"),
        "missing": (np.full(100, np.nan), 7, "D"),
        "large": (1e12 + r(42).normal(0, 1e10, 100), 7, "D"),
        "mixed": (5 * wave(100, 7) + r(42).normal(0, 1, 100), 14, "D"),
        "far": (100 + r(42).normal(0, 5, 50), 200, "D"),
        "three": (np.array([10.0, 20, 15]), 5, "Y"),
    }
