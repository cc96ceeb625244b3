"""Sampled ranges of rows instead of buckets of time or value."""

import pytest
from pyspark.sql import functions as F

from trajspark.functions.layout import Layout, dense_positions, range_buckets
from trajspark.operators import timeseries as ts
from trajspark.sources import messages as ms


def sizes(df):
    return [r["count"] for r in df.groupBy("_bucket").count().collect()]


def test_samples_of_one_second_spread_over_ranges(spark):
    rows = spark.range(20_000).selectExpr("'one' AS episode_id", "0.5 + (id * 7919 % 20000) / 1e9 AS timestamp", "id")
    bucketed = range_buckets(rows, ["episode_id", "timestamp"])
    counts = sizes(bucketed)
    assert len(counts) == 4 and max(counts) < 0.5 * sum(counts)
    ends = bucketed.groupBy("_bucket").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("_bucket").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(ends, ends[1:], strict=False))


def test_merge_of_a_log_within_one_second(spark):
    stream = lambda n, shift, c: spark.range(n).selectExpr("'log' AS episode_id", f"0.1 + (id * 7919 % {n}) * 1e-6 + {shift} AS timestamp", "id AS seq", f"double(id) AS {c}")
    streams = {"joint": stream(3000, 0, "joint_1"), "wrench": stream(1500, 3e-7, "force_z")}
    whole = ms.asof_merge_streams(streams).collect()
    ranged = ms.asof_merge_streams(streams, limit=200).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, ranged)) and len(whole) == 3000
    assert all(r["force_z"] is not None for r in whole)


def test_sampling_with_a_stalled_clock(spark):
    """The clock stands still for most of the episode and leaps at its end."""
    rows = [("e", k, 1.0 if 50 <= k < 950 else (k / 50 if k < 50 else 1.0 + (k - 949) * 10.0), float(k % 17)) for k in range(1000)]
    steps = spark.createDataFrame(rows, "episode_id string, seq long, timestamp double, x double").withColumn("median_dt", F.lit(0.02))
    one, many = (ts.sample_at(steps, layout, "x", F.lit(0.013)).select("seq", "x__shifted").orderBy("seq").collect() for layout in (Layout(), Layout(chunk_rows=64)))
    assert [r["seq"] for r in one] == list(range(1000))
    assert [r["x__shifted"] for r in many] == pytest.approx([r["x__shifted"] for r in one])


def test_positions_of_a_hot_key_by_ranges(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "5.0 AS t", "id")
    got, layout = dense_positions(rows, "k", ["t", "id"], limit=50)
    assert not layout.whole
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r["k"], r["id"])):
        assert r["seq"] == seen.get(r["k"], 0)
        seen[r["k"]] = r["seq"] + 1
