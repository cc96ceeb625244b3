"""How often the samples of a benchmark are worked out, and what is worked out for them."""

from pyspark.sql import functions as F

from trajspark.functions.layout import Layout
from trajspark.functions.lineage import materialise
from trajspark.operators import evaluation as ev
from trajspark.operators import repair as rp
from trajspark.operators import timeseries as ts
from trajspark.plans import benchmark_queries as bq


def test_samples_are_detected_in_two_passes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ev, "materialise", lambda df: df, raising=False)
    plan = bq._detections(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    grids = [x for x in plan.splitlines() if "BroadcastNestedLoopJoin" in x]
    assert len(grids) == 2  # one for the figures, the fixed rules and the facts, one for the lag search


def test_only_the_facts_of_a_diagnosis_are_worked_out(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(rp, "materialise", lambda df: seen.append(df) or materialise(df))
    bq._repairs(spark, sf_dir)
    assert [set(df.columns) for df in seen] == [{"meta_base_id", "episode_id", *rp.FACTS}]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "joint_1__limit" not in plan and "force_z__limit" not in plan


def test_only_moved_episodes_get_their_samples_among_the_targets(spark):
    rows = spark.range(60).selectExpr("cast(id % 3 AS STRING) AS episode_id", "id div 3 AS seq", "(id div 3) / 10 AS timestamp", "sin(id / 5) AS camera", "id % 3 = 1 AS move")
    for layout in (Layout(), Layout(chunk_rows=7)):
        every = ts.sample_at(rows, layout, "camera", F.lit(0.15))
        some = ts.sample_at(rows, layout, "camera", F.lit(0.15), "move")
        want = every.withColumn("camera__shifted", F.when(F.col("move"), F.col("camera__shifted")))
        assert some.exceptAll(want).isEmpty() and some.count() == 60
        assert some.filter("camera__shifted IS NOT NULL").count() == 18
    plan = ts.sample_at(rows, Layout(), "camera", F.lit(0.15), "move")._jdf.queryExecution().optimizedPlan().toString()
    assert "if (move" in plan
