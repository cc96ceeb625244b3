"""A step table derived from the ``events`` table: users are episodes, their events are time steps.

Only integer arithmetic and one division per value are used, so other SQL engines give the same numbers.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.layout import DEFAULT_CHUNK_ROWS, Layout, dense_positions
from trajspark.profiles import Profile

# Thresholds that fit these 20 Hz episodes of 50 to 90 steps.
TELEMETRY_PROFILE = Profile(
    "telemetry", "Event-derived episodes", stuck_min_duration=0.4, force_mad_scale=2.0, gap_extra_seconds=0.04
)

JOINTS = ["joint_1", "joint_2"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(
    spark: SparkSession, sf_dir: str, limit: int = DEFAULT_CHUNK_ROWS, events: DataFrame | None = None
) -> tuple[DataFrame, Layout]:
    """The step table and the layout that fits its longest episode."""
    events = read_table(spark, sf_dir, "events") if events is None else events
    rows = events.select("user_id", "event_id", "ts", "value")
    rows, layout = dense_positions(rows, "user_id", ["ts", "event_id"], limit=limit)
    by_user = replace(layout, keys=("user_id",))
    seq, user, event = F.col("seq"), F.col("user_id"), F.col("event_id")
    rows = by_user.with_figures(rows, {"n": F.count(F.lit(1))})
    rows = rows.withColumn("ph", F.floor(5 * seq / F.col("n")).cast("int")).withColumn("u", (event * 7919) % 1000)
    ph = F.col("ph")
    moving = F.when((ph == 3) & (user % 2 == 0), 0).otherwise(F.col("u"))
    rows = by_user.running(rows, {"gaps": F.when(event % 37 == 0, 1).otherwise(0), "travel": moving})
    rows = by_user.local(rows, lambda w: {"u3": F.coalesce(F.lag("u", 3).over(w), F.lit(0))}, before=3)
    phase = F.element_at(
        F.array(*[F.lit(p) for p in ("approach", "reach", "grasp", "transport", "place")]), ph + 1
    )
    slipped = (ph == 3) & (user % 5 == 0)
    gap_2 = (seq % 40).between(20, 22) | ((user % 7 == 0) & (seq % 60).between(50, 55))
    distance = (
        F.when(ph == 0, F.lit(16) / 100)
        .when(ph == 1, F.lit(9) / 100)
        .when(slipped, F.lit(1) / 10 + seq / 100)
        .when(ph.isin(2, 3), F.lit(25) / 1000)
        .otherwise(F.lit(14) / 100)
    )
    steps = rows.select(
        F.concat(F.lit("EP-"), F.lpad(user.cast("string"), 5, "0")).alias("episode_id"),
        "seq",
        ((50 * seq + 200 * F.col("gaps") - F.when(event % 101 == 0, 70).otherwise(0)) / 1000).alias("timestamp"),
        phase.alias("phase"),
        F.when(
            event % 29 != 0, F.col("u") / 10000 + seq / 50 + F.when(event % 41 == 0, 3).otherwise(0)
        ).alias("joint_1"),
        F.when(~gap_2, F.col("u") / 20000 - seq / 80).alias("joint_2"),
        (F.col("travel") / 20000).alias("ee_x"),
        (F.when((ph == 3) & (user % 2 == 0), 0).otherwise(1) / 10).alias("ee_y"),
        (F.col("u3") / 1000).alias("camera_motion"),
        F.col("value").alias("force_z"),
        F.when((seq % 31).between(10, 12), 0).otherwise(1).alias("frame_valid"),
        F.when(ph.isin(2, 3) & (user % 11 != 0), F.lit(18) / 100).otherwise(F.lit(92) / 100).alias("gripper"),
        F.when(ph.isin(2, 3), -1).otherwise(1).alias("gripper_command"),
        distance.alias("object_distance"),
        (ph.isin(2, 3) & ~slipped).alias("is_grasped"),
        (user % 3 != 0).alias("success"),
    )
    return steps, replace(layout, keys=("episode_id",))


TELEMETRY_SQL = """
  SELECT concat('EP-', lpad(cast(user_id AS VARCHAR), 5, '0')) AS episode_id,
    cast(seq AS BIGINT) AS seq,
    (50 * seq + 200 * (sum(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) OVER w)
       - CASE WHEN event_id % 101 = 0 THEN 70 ELSE 0 END) / 1000 AS timestamp,
    CASE ph WHEN 0 THEN 'approach' WHEN 1 THEN 'reach' WHEN 2 THEN 'grasp'
            WHEN 3 THEN 'transport' ELSE 'place' END AS phase,
    CASE WHEN event_id % 29 = 0 THEN NULL
         ELSE u / 10000 + seq / 50 + CASE WHEN event_id % 41 = 0 THEN 3 ELSE 0 END END AS joint_1,
    CASE WHEN seq % 40 BETWEEN 20 AND 22 OR (user_id % 7 = 0 AND seq % 60 BETWEEN 50 AND 55) THEN NULL
         ELSE u / 20000 - seq / 80 END AS joint_2,
    (sum(CASE WHEN ph = 3 AND user_id % 2 = 0 THEN 0 ELSE u END) OVER w) / 20000 AS ee_x,
    CASE WHEN ph = 3 AND user_id % 2 = 0 THEN 0 ELSE 1 END / 10 AS ee_y,
    coalesce(lag(u, 3) OVER w, 0) / 1000 AS camera_motion,
    value AS force_z,
    cast(CASE WHEN seq % 31 BETWEEN 10 AND 12 THEN 0 ELSE 1 END AS INT) AS frame_valid,
    CASE WHEN ph IN (2, 3) AND user_id % 11 <> 0 THEN 18 / 100 ELSE 92 / 100 END AS gripper,
    CASE WHEN ph IN (2, 3) THEN -1 ELSE 1 END AS gripper_command,
    CASE ph WHEN 0 THEN 16 / 100 WHEN 1 THEN 9 / 100 WHEN 2 THEN 25 / 1000
         WHEN 3 THEN CASE WHEN user_id % 5 = 0 THEN 1 / 10 + seq / 100 ELSE 25 / 1000 END
         ELSE 14 / 100 END AS object_distance,
    (ph IN (2, 3) AND NOT (ph = 3 AND user_id % 5 = 0)) AS is_grasped,
    user_id % 3 <> 0 AS success
  FROM (SELECT *, cast(floor(5 * seq / n) AS INT) AS ph, (event_id * 7919) % 1000 AS u
        FROM (SELECT user_id, event_id, value,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
                count(*) OVER (PARTITION BY user_id) AS n
              FROM events))
  WINDOW w AS (PARTITION BY user_id ORDER BY seq)
"""
