"""Queries that read all rows of their tables, against DuckDB on the small tables."""

import pytest
from test_queries import test_query_matches_sql as matches_sql

import __spark_entry__ as entry

STREAMS = ["asof_merge_streams", "media_segments", "verify_checksums"]
VECTORS = ["path_length", "expand_vector", "explode_trajectory_arrays", "object_distance"]
SCORES = ["quality_score", "dataset_overview", "grade_distribution", "score_histogram", "audit_order"]


@pytest.mark.parametrize("name", STREAMS + SCORES + VECTORS)
def test_whole_query_matches_sql(spark, sf_dir, name):
    matches_sql(spark, sf_dir, name)


def test_no_rows_are_left_out(spark, sf_dir):
    from trajspark.plans.telemetry import telemetry

    run = lambda name: entry.queries()[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    checked = run("verify_checksums")
    assert checked.filter("actual is not null").count() == docs.filter("doc_id % 7 = 0").count()
    assert checked.filter("actual is null").count() == docs.filter("doc_id % 20 = 0").count() > 0
    number = "(cast(regexp_extract(path, 'chunk-([0-9]+)', 1) as int) * 100 + cast(regexp_extract(path, 'file-([0-9]+)', 1) as int))"
    assert run("media_segments").filter(f"{number} % 3 = 0").count() > 0
    merged = run("asof_merge_streams")
    steps, _ = telemetry(spark, sf_dir)
    assert merged.filter("timestamp < 500000").count() == steps.select("episode_id", "timestamp").distinct().count()
    assert merged.filter("timestamp >= 500000 and force_z is null and gripper is null").count() > 0


def test_scores_count_the_faults_of_all_channels(spark, sf_dir):
    run = lambda name: entry.queries()[name](spark, sf_dir)
    faults = {r["episode_id"]: r["n"] for r in run("issues_by_severity").filter("severity = 'critical'").groupBy("episode_id").count().toDF("episode_id", "n").collect()}
    scored = {r["episode_id"]: r["critical_count"] for r in run("quality_score").collect()}
    assert scored and scored == {e: faults.get(e, 0) for e in scored}


def test_no_values_are_left_out(spark, sf_dir):
    run = lambda name: entry.queries()[name](spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert run("explode_trajectory_arrays").count() == run("object_distance").count() == 64 * vectors
    assert len(run("expand_vector").columns) == 65


def test_paths_with_one_prefix_are_numbered_in_several_ranges(spark):
    from trajspark.sources import tables as tb

    prefix = "videos/" + "x" * 80
    files = spark.range(4000).selectExpr(f"concat('{prefix}/', (id * 7919) % 4000) AS path")
    rows = tb.numbered_paths(files).collect()
    assert [r["path"] for r in sorted(rows, key=lambda r: r["_no"])] == sorted(f"{prefix}/{k}" for k in range(4000))
    assert sorted(r["_no"] for r in rows) == list(range(4000))
    assert len({r["_range"] for r in rows}) > 1
