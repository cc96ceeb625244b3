"""Queries: online monitors run over files as streams; their batch versions are checked as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions.layout import dense_positions
from trajspark.plans.recovery_queries import RPARTS
from trajspark.plans.diagnosis_queries import r
from trajspark.plans.oracle import statement
from trajspark.plans.registry import query, scratch_path
from trajspark.plans.replays import replays
from trajspark.plans.source_queries import MOTION_SQL
from trajspark.plans.telemetry import read_table
from trajspark.streaming import monitors as mo

W = "PARTITION BY u, variant ORDER BY seq"
PARTS = RPARTS | {
    "watched": f"SELECT *, sum(is_grasped::INT) OVER ({W}) AS grasps, sum((gripper_command < -0.5 AND gripper > 0.75)::INT) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ignored, "
    f"max(force) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS peak, lead(seq, 2) OVER ({W}) IS NOT NULL AS full3 FROM frames",
    "viol": "SELECT scenario, seed, variant, min(seq) AS violated FROM watched WHERE CASE scenario WHEN 'collision' THEN force > 36 WHEN 'gripper-failure' THEN ignored = 4 ELSE grasps > 0 AND NOT is_grasped END GROUP BY 1, 2, 3",
    "mon": "SELECT scenario, seed, variant, 'predicate-violated' AS type, violated AS step FROM viol UNION ALL "
    "SELECT scenario, seed, variant, 'predicate-restored', min(seq) FROM watched JOIN viol USING (scenario, seed, variant) WHERE seq >= violated + 1 AND CASE scenario WHEN 'collision' THEN starts_with(phase, 'recovery_') AND full3 AND peak <= 36 ELSE is_grasped END GROUP BY 1, 2, 3 UNION ALL "
    "SELECT scenario, seed, variant, 'recovery-success', min(seq) FROM watched JOIN viol USING (scenario, seed, variant) WHERE seq >= violated + 1 AND success_now GROUP BY 1, 2, 3",
}


def check(final: str) -> str:
    return statement(PARTS, final)


ANY_TIME = "36500 days"  # files of a run may come long after those of others; nothing is too late here


def stream_of(spark, frame, keys: list[str], name: str, slices: int = 3):
    """Write a table in slices, one after the other, and open the files as a stream of several micro-batches.

    A slice holds frames from everywhere in a run, so most frames come before their turn.
    """
    path = scratch_path(spark, name)
    timed = frame.withColumn("event_time", F.timestamp_millis(F.lit(946_684_800_000) + F.col("seq") * 50))
    for k in range(slices):
        timed.filter(F.pmod(F.xxhash64("seq"), F.lit(slices)) == k).repartition(*keys).write.mode("append").parquet(path)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 4).parquet(path)


FRAME_COLUMNS = [*mo.KEYS, "seq", "force", "gripper", "gripper_command", "is_grasped", "success_now", "phase"]


def monitored(spark, sf):
    mo.use_rocksdb(spark)
    frames = replays(spark, sf).frames.select(*FRAME_COLUMNS)
    out = scratch_path(spark, "monitor-events")
    mo.run_to_files(mo.monitor_runs(stream_of(spark, frames, mo.KEYS, "frames"), ANY_TIME), out)
    return spark.read.schema(mo.EVENTS).parquet(out).select(*mo.KEYS, "type", "step")


@query("online_violation_monitor", check("SELECT * FROM mon WHERE type = 'predicate-violated'"))
def online_violation_monitor(spark, sf):
    return monitored(spark, sf).filter("type = 'predicate-violated'")


@query("restoration_monitor", check("SELECT * FROM mon WHERE type <> 'predicate-violated'"))
def restoration_monitor(spark, sf):
    return monitored(spark, sf).filter("type IN ('predicate-restored', 'recovery-success')")


@query("violation_monitor_batch", check("SELECT * FROM mon"))
def violation_monitor_batch(spark, sf):
    rep = replays(spark, sf)
    return mo.batch_events(rep.frames.select(*FRAME_COLUMNS), rep.layout)


@query("falling_edge", check("SELECT scenario, seed, variant, seq FROM (SELECT *, lag(is_grasped) OVER (PARTITION BY u, variant ORDER BY seq) AS before FROM frames) WHERE before AND NOT is_grasped AND gripper < 0.3"))
def falling_edge(spark, sf):
    """Frames where the grasp is lost while the gripper stays closed."""
    rep = replays(spark, sf)
    rows = rep.layout.local(rep.frames, lambda w: {"_before": F.lag("is_grasped").over(w)}, before=1)
    return rows.filter("_before AND NOT is_grasped AND gripper < 0.3").select(*mo.KEYS, "seq")


@query("stream_frame_motion", MOTION_SQL)
def stream_frame_motion(spark, sf):
    mo.use_rocksdb(spark)
    frames = read_table(spark, sf, "embeddings").selectExpr("int(label) AS topic", "vec_id", "transform(embedding, x -> cast(x AS DOUBLE)) AS pixels")
    frames, _ = dense_positions(frames, "topic", ["vec_id"])
    out = scratch_path(spark, "motion")
    mo.run_to_files(mo.stream_frame_motion(stream_of(spark, frames.select("topic", "seq", "pixels"), ["topic"], "grey-frames"), ANY_TIME), out)
    moved = spark.read.schema("topic int, seq bigint, camera_motion double").parquet(out)
    return moved.join(frames.select("topic", "seq", "vec_id"), ["topic", "seq"]).select("topic", "vec_id", r("camera_motion", 9).alias("camera_motion"))
