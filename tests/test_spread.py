"""Where rows lie: samples stay with their base, repaired episodes are dealt by a bounded number of rows."""

from pyspark.sql import functions as F

from trajspark.functions import layout as lay
from trajspark.functions.layout import Layout
from trajspark.functions.lineage import materialise
from trajspark.operators import evaluation as ev
from trajspark.operators import perturb as pt
from trajspark.operators import reasoning as rs
from trajspark.operators import repair as rp
from trajspark.operators import timeseries as ts
from trajspark.plans import benchmark_queries as bq
from trajspark.plans import reasoning_queries as why
from trajspark.plans import repair_queries as rq


def test_samples_are_not_shuffled(spark, sf_dir):
    rows, layout, _ = bq.samples(spark, sf_dir, pt.DETECTION_FAULTS, 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert layout.keys == pt.SAMPLE_KEYS
    assert len([d for d in dealt if d.startswith("base_id")]) == 1 and "REPARTITION_BY_NUM" in plan
    assert len([d for d in dealt if d.startswith("episode_id")]) == 1  # the bases' own running sums


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lay, "ROWS_PER_TASK", 50)
    rows = spark.range(1000).selectExpr("cast(id div 10 AS STRING) AS episode_id", "id AS seq")
    dealt = Layout().spread(rows, "episode_id")
    assert dealt.rdd.getNumPartitions() == 20
    assert Layout().spread(rows, "episode_id", 3).rdd.getNumPartitions() == 60


def test_repaired_samples_are_neither_stored_nor_shuffled(spark, sf_dir, monkeypatch):
    stored = []

    def recorded(df):
        out = materialise(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(rp, "materialise", recorded)
    monkeypatch.setattr(ev, "materialise", recorded)
    records = bq._repairs(spark, sf_dir)
    assert stored == [records.count()]  # the diagnosis before the repair, one row for each sample
    plan = records._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert {d.split("#")[0] for d in dealt} <= {"user_id", "episode_id", "base_id", "meta_base_id"}, [d[:80] for d in dealt]
    assert len([d for d in dealt if d.startswith("meta_base_id")]) <= 1, [d[:80] for d in dealt]  # of that diagnosis, to the rows


def test_residuals_of_samples(spark, sf_dir):
    _, layout, clean = bq.samples(spark, sf_dir, pt.REPAIR_FAULTS[2:3], 1)
    rows = pt.inject(ev.with_truth(clean.filter("base_no < 3"), ["joint_1", "joint_2", "camera_motion"]), layout)
    found = {(r.fault, r.sync_residual_ms is None) for r in ev.repair_records(ev.run_repair(rows, layout, bq.P)).collect()}
    assert found == {("nominal", True), ("sensor-delay", False)}


def test_numbered_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lay, "ROWS_PER_TASK", 50)
    rows = spark.range(1000).selectExpr("id div 10 AS user_id", "id AS ts")
    numbered, layout = lay.dense_positions(rows, "user_id", ["ts"])
    assert layout.whole and numbered.rdd.getNumPartitions() == 20
    assert numbered.filter("seq != ts % 10").isEmpty()


def test_repaired_rows_are_dealt_again(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lay, "ROWS_PER_TASK", 100)
    done = rq.run(spark, sf_dir)
    rows = done.rows.count()
    assert done.dealt.rdd.getNumPartitions() == -(-rows // 100) > 4
    seen = []
    monkeypatch.setattr(rp, "materialise", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    assert done.after.count() == done.before.count()
    assert f"{-(-rows // 100)}), REPARTITION_BY_NUM" in seen[0]


def test_rows_are_repaired_where_they_were_dealt(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lay, "ROWS_PER_TASK", 100)
    done = rq.run(spark, sf_dir)
    tasks = -(-done.rows.count() // 100)
    assert tasks > 4 and done.rows.rdd.getNumPartitions() == tasks
    homes = done.rows.select("episode_id", F.spark_partition_id().alias("task")).distinct()
    assert homes.count() == done.before.count()  # an episode lies in one task
    assert homes.select("task").distinct().count() > 4


def test_reasoned_rows_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lay, "ROWS_PER_TASK", 100)
    found = why.reasoned(spark, sf_dir)
    rows = found.steps.count()
    assert found.steps.rdd.getNumPartitions() == -(-rows // 100) > 4


def test_rows_are_not_copied_for_their_points(spark):
    steps = spark.createDataFrame(
        [("a", 0, 0.0, "reach"), ("a", 1, 1.0, None), ("a", 2, 3.0, "grasp"), ("b", 0, 0.0, "place"), ("c", 0, 0.0, "place")],
        "episode_id string, seq long, timestamp double, phase string",
    )
    points = spark.createDataFrame(
        [("a", "FRAME_DROP", 2.0), ("a", "JOINT_JUMP", 2.5), ("a", "GRASP_SLIP", -9.0), ("b", "GRASP_SLIP", 7.0)], "episode_id string, code string, start_time double"
    )
    for layout in (Layout(), Layout(chunk_rows=2)):
        near = rs.nearest_phase(steps, points, layout)
        assert {tuple(r) for r in near.select("episode_id", "code", "phase").collect()} == {
            ("a", "FRAME_DROP", "nan"), ("a", "JOINT_JUMP", "grasp"), ("a", "GRASP_SLIP", "reach"), ("b", "GRASP_SLIP", "place")
        }
    plan = rs.nearest_phase(steps, points, Layout())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")  # of the found phases, none below


def test_the_search_fills_gaps_without_sorting_backwards(spark):
    rows = spark.range(200).selectExpr(
        "cast(id div 100 AS STRING) AS episode_id", "id % 100 AS seq", "(id % 100) / 10 AS timestamp", "0.1D AS median_dt",
        "if(id % 9 = 4 OR id % 100 < 2, NULL, sin(id / 3)) AS speed", "if(id % 13 IN (5, 6) OR id % 100 > 97, NULL, sin((id - 2) / 3)) AS camera",
    )
    found = ts.sync_offset(rows, Layout(), "speed", "camera", 0.5)
    assert "DESC" not in found._jdf.queryExecution().executedPlan().toString()
    chunked = ts.sync_offset(rows, Layout(chunk_rows=30), "speed", "camera", 0.5)
    pick = lambda df: sorted((r.episode_id, r.lag, round(r.confidence, 9)) for r in df.collect())
    assert pick(found) == pick(chunked) and {lag for _, lag, _ in pick(found)} == {2}
