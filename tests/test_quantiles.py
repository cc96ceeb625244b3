"""Quantiles of long groups by brackets against ``percentile``."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trajspark.functions import quantile


@pytest.mark.parametrize("accuracy", [15, 200, 10_000])
def test_long_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantile, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = []
    for group, n in (("a", 900), ("b", 333), ("c", 40), ("d", 500), ("none", 300)):
        for k in range(n):
            x = rng.choice([None, math.nan, math.inf, rng.gauss(0, 5), float(rng.randint(-3, 3)), 1e-300 * k]) if group != "none" else None
            rows.append((group, x, 2.5 if group == "d" else rng.random(), float(k)))
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(6)
    want = {"med": (F.col("x"), 0.5), "top": (F.col("x"), 0.95), "least": (F.col("y"), 0.0), "most": (F.col("y"), 1.0), "odd": (F.abs(F.col("z") - 7), 0.123)}
    got = {r["g"]: r for r in quantile.grouped_quantiles(df, ["g"], want, 100).collect()}
    plain = df.groupBy("g").agg(*[F.percentile(quantile.finite(c), p).alias(n) for n, (c, p) in want.items()]).collect()
    assert len(got) == len(plain) == 5
    for r in plain:
        for n in want:
            assert got[r["g"]][n] == (r[n] if r[n] is None else pytest.approx(r[n], abs=1e-12)), (r["g"], n)


def test_plan_has_no_checkpoint_and_two_passes(spark, tmp_path):
    spark.range(1000).selectExpr("id % 2 AS g", "rand(3) AS x", "rand(4) AS y").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = quantile._large_groups(df, ["g"], {"a": (F.col("x"), 0.5), "b": (F.col("y"), 0.9), "c": (F.col("x"), 0.25)})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Existing" not in plan and plan.count("Relation [") <= 3
