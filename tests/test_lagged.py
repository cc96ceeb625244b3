"""Lagged correlation by blocks against plain correlation of the shifted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import lagged
from trajspark.functions.layout import Layout
from trajspark.operators import timeseries as ts


def plain(x, y, lag):
    a, b = max(0, -lag), min(len(x), len(y) - lag)
    return np.corrcoef(x[a:b], y[a + lag : b + lag])[0, 1]


@pytest.mark.parametrize("few", [0, 10_000])
def test_moments(monkeypatch, few):
    monkeypatch.setattr(lagged, "FEW_LAGS", few)
    rng = np.random.default_rng(few)
    for n, m in ((40, 40), (7, 30), (30, 1)):
        x, y = rng.normal(size=n), rng.normal(size=m)
        for holes in (False, True):
            if holes:
                x[::5], y[::4] = np.nan, np.inf
            lags = np.arange(-50, 45)
            got = lagged.moments(x, y, lags)
            for lag, row in zip(lags, got, strict=True):
                pairs = [(x[p], y[p + lag]) for p in range(n) if 0 <= p + lag < m and np.isfinite(x[p]) and np.isfinite(y[p + lag])]
                a, b = (np.array(v) for v in zip(*pairs, strict=True)) if pairs else (np.zeros(0), np.zeros(0))
                assert np.allclose(row, [len(pairs), a.sum(), (a * a).sum(), b.sum(), (b * b).sum(), a @ b], atol=1e-9)


@pytest.mark.parametrize("chunk", [None, 1000, 70, 16])
def test_correlations_of_blocks(spark, chunk):
    """Also with lags longer than a block, a constant signal and lags on one side."""
    rng = np.random.default_rng(2)
    signals = {"a": (rng.normal(size=333).cumsum(), rng.normal(size=333).cumsum(), -40, 40), "b": (rng.normal(size=90), rng.normal(size=90), 0, 12), "c": (np.full(80, 0.1), rng.normal(size=80), -5, 5)}
    rows = [(e, k, float(x[k]), float(y[k]), low, high) for e, (x, y, low, high) in signals.items() for k in range(len(x))]
    df = spark.createDataFrame(rows, "episode_id string, seq long, x double, y double, low int, high int")
    found = lagged.lag_correlations(df, Layout(chunk_rows=chunk), "x", "y", F.col("low"), F.col("high"), (F.lit(0.5), F.lit(0.25))).collect()
    got = {(r["episode_id"], r["lag"]): r for r in found}
    assert len(found) == len(got) == 81 + 13 + 11
    for (e, lag), r in got.items():
        x, y, _, _ = signals[e]
        assert r["pairs"] == len(x) - abs(lag)
        assert r["r"] is None if e == "c" else r["r"] == pytest.approx(plain(x, y, lag), abs=1e-9)


def test_fast_and_long_episode(spark):
    """100,000 rows a second: lags of up to 50,000 rows, over blocks shorter than that and in one piece."""
    n, lag = 160_000, 20_011
    rng = np.random.default_rng(8)
    signal = rng.normal(size=n + lag)
    import pandas as pd

    table = pd.DataFrame({"episode_id": "fast", "seq": np.arange(n), "timestamp": np.arange(n) / 1e5, "speed": signal[lag:], "camera": signal[:n], "median_dt": 1e-5})
    steps = spark.createDataFrame(table).repartition(8)
    for layout in (Layout(), Layout(chunk_rows=1 << 15)):
        found = ts.sync_offset(steps, layout, "speed", "camera", 0.5).first()
        assert found["lag"] == lag and found["confidence"] == pytest.approx(1.0)
