"""Whole and chunked layouts give the same rows, whatever the chunk size."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from trajspark.functions.layout import Layout, dense_positions
from trajspark.operators import detect, readiness, reasoning, repair, score
from trajspark.operators import timeseries as ts
from trajspark.operators.steps import resolve_roles
from trajspark.plans.telemetry import TELEMETRY_PROFILE as P
from trajspark.plans.telemetry import TELEMETRY_SQL, telemetry
from trajspark.sources import messages as ms

WHOLE, CHUNKED = Layout(), Layout(16)
slow = pytest.mark.skipif(not os.environ.get("RUN_SLOW"), reason="set RUN_SLOW=1")


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    rows, _ = telemetry(spark, sf_dir)
    # Stored, so that comparisons do not build the view again.
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/steps"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(a.columns))
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    left, right = rounded(a), rounded(b)
    assert left.count() == right.count()
    assert left.exceptAll(right).limit(3).collect() == []


def test_view_matches_sql(spark, sf_dir, steps):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    expected = duck.sql(f"select count(*), sum(timestamp), sum(ee_x), count(joint_1) from ({TELEMETRY_SQL})").fetchall()[0]
    got = steps.agg(F.count(F.lit(1)), F.sum("timestamp"), F.sum("ee_x"), F.count("joint_1")).first()
    assert [round(float(x), 6) for x in got] == [round(float(x), 6) for x in expected]


def test_view_with_long_keys(spark, sf_dir, steps):
    chunked, layout = telemetry(spark, sf_dir, limit=16)
    assert not layout.whole
    same(steps, chunked)


@pytest.mark.parametrize("p", [0.5, 0.95])
def test_quantiles(steps, p):
    want = {"q": (F.col("force_z"), p), "z": (F.col("joint_1") - 2.0, p), "flat": (F.col("ee_y"), p)}
    same(WHOLE.quantiles(steps, want), CHUNKED.quantiles(steps, want))


def test_local_running_anchors(steps):
    base = steps.select("episode_id", "seq", "timestamp", "joint_1", "joint_2")
    for run in (
        lambda l: l.local(base, lambda w: {"a": F.lag("timestamp", 40).over(w), "b": F.lead("joint_2", 3).over(w)}, 40, 3),
        lambda l: l.running(base, {"s": F.when(F.col("joint_1").isNull(), 1)}),
        lambda l: ts.interpolate_positional(base, l, ["joint_1", "joint_2"]),
        lambda l: ts.downsample(base, l, 7),
        lambda l: l.with_figures(base, {"m": F.max("joint_1")}),
    ):
        same(run(WHOLE), run(CHUNKED))


def test_diagnosis(steps):
    keep = ["episode_id", "quality_score", "grade", "issue_codes", "offset", "confidence", "stuck_seconds", "drop_segment_start", "jump_rows", "primary_cause"]
    same(score.diagnose(steps, P, WHOLE).select(*keep), score.diagnose(steps, P, CHUNKED).select(*keep))


@slow
def test_repair(steps):
    a, b = (repair.repair_steps(steps, P, l) for l in (WHOLE, CHUNKED))
    same(a.cleaned, b.cleaned)
    same(repair.repair_actions(a), repair.repair_actions(b))


def test_readiness_and_evidence(steps):
    rows = steps.withColumn("action_1", F.col("camera_motion"))
    keep = ["episode_id", "score", "status", "alignment", "response_lag", "phase_transitions", "contact_ratio"]
    same(readiness.readiness(rows, WHOLE).select(*keep), readiness.readiness(rows, CHUNKED).select(*keep))
    roles = resolve_roles(steps)
    same(reasoning.phase_evidence(steps, WHOLE, roles, P), reasoning.phase_evidence(steps, CHUNKED, roles, P))


def test_asof_merge(steps):
    cut = lambda every, at, c: steps.filter(F.col("seq") % every == at).select("episode_id", "timestamp", "seq", c)
    streams = {"joint": cut(2, 0, "joint_1"), "wrench": cut(3, 1, "force_z"), "scalar": cut(7, 3, "gripper")}
    same(ms.asof_merge_streams(streams), ms.asof_merge_streams(streams, limit=8))


def test_asof_merge_matches_pandas(steps):
    import pandas as pd

    one = steps.filter("episode_id = 'EP-00001'").filter("timestamp IS NOT NULL")
    left, right = one.filter("seq % 2 = 0").select("episode_id", "timestamp", "seq", "joint_1"), one.filter("seq % 3 = 1").select("episode_id", "timestamp", "seq", "force_z")
    got = ms.asof_merge_streams({"joint": left, "wrench": right}).toPandas().sort_values("timestamp").reset_index(drop=True)
    a = left.toPandas().sort_values(["timestamp", "seq"]).groupby("timestamp", as_index=False).last()
    b = right.toPandas().sort_values(["timestamp", "seq"]).groupby("timestamp", as_index=False).last()
    periods = b["timestamp"].diff().dropna()
    tol = max(0.1, periods[periods > 0].median() * 3)
    want = pd.merge_asof(a, b[["timestamp", "force_z"]], on="timestamp", direction="nearest", tolerance=tol)
    pd.testing.assert_series_equal(got["force_z"], want["force_z"], check_names=False)


def test_dense_positions_with_hot_key(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "(id * 7919) % 1000 AS t", "id")
    a, _ = dense_positions(rows, "k", ["t", "id"])
    b, layout = dense_positions(rows, "k", ["t", "id"], limit=100)
    assert not layout.whole
    same(a, b)


def test_event_rows(steps):
    d = [detect.inspect_steps(steps, P, l) for l in (WHOLE, CHUNKED)]
    same(*[detect.event_rows(x) for x in d])
    same(*[detect.fixed_threshold_codes(x) for x in d])


def test_sync_recovers_known_delay(steps):
    rows = ts.with_speed(steps, WHOLE, resolve_roles(steps))
    found = ts.sync_offset(rows, WHOLE, "speed", "camera_motion", 0.5, 10)
    assert {x["lag"] for x in found.select("lag").distinct().collect()} == {3}
