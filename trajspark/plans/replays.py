"""Paired replay runs derived from the telemetry view: user u gives scenario u % 3 and seed u div 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.layout import Layout
from trajspark.operators.recovery import FAULTS, KEYS, Replays
from trajspark.plans.telemetry import telemetry

# Expressions that mean the same in Spark and in DuckDB (``//`` differs, so floor is used).
SCENARIO = "CASE u % 3 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(FAULTS)) + " END"
RECOVERY_PHASE = (
    "CASE cast(floor((seq - s) * 8 / n) AS INT) WHEN 0 THEN 'recovery_hold' WHEN 1 THEN 'recovery_retreat' "
    "WHEN 2 THEN CASE WHEN u % 10 = 9 THEN 'recovery_hold' ELSE 'recovery_reobserve' END WHEN 3 THEN 'recovery_reach' ELSE 'transport' END"
)
FRAME = {
    # column: (failure, recovered)
    "tcp_x": ("ee_x * 0.913713e0", "CASE WHEN seq < s THEN ee_x * 0.913713e0 ELSE ee_x END"),
    "tcp_y": ("ee_y", "ee_y"),
    "tcp_z": ("0e0", "0e0"),
    "object_x": ("object_distance", "object_distance"),
    "object_y": ("0e0", "0e0"),
    "object_z": ("0e0", "0e0"),
    "goal_x": ("0e0", "0e0"),
    "goal_y": ("0e0", "0e0"),
    "goal_z": ("0e0", "0e0"),
    "force": ("load", "CASE WHEN seq >= s AND u % 4 <> 0 THEN least(load, 30e0) ELSE load END"),
    "gripper": ("gripper", "CASE WHEN seq >= s + 3 * n / 8 THEN 0.18e0 ELSE gripper END"),
    "gripper_command": ("gripper_command", "CASE WHEN seq >= s + 3 * n / 8 THEN -1 ELSE gripper_command END"),
    "is_grasped": ("is_grasped", "CASE WHEN seq >= back THEN u % 13 <> 0 ELSE is_grasped END"),
    "success_now": ("(u % 17 = 0 AND seq >= n - 2)", "(u % 7 <> 0 AND seq >= n - 3)"),
    "phase": ("phase", f"CASE WHEN seq < s THEN phase ELSE {RECOVERY_PHASE} END"),
}
BASE = "cast(floor(n / 2) AS BIGINT) AS s, cast(floor(n / 2) + floor(7 * n / 16) AS BIGINT) AS back"
RUN = (
    "20 AS fps, n AS rows, (n - 1) / 20 AS duration, 'PickCube' AS env_id, 140 AS steps, 320 AS width, 240 AS height, "
    "CASE WHEN variant = 'recovered' THEN 'online-predicate-monitor' END AS trigger_source, "
    "CASE WHEN variant = 'recovered' THEN CASE u % 3 WHEN 0 THEN 'force-threshold' WHEN 1 THEN 'gripper-command-response-mismatch' ELSE 'grasp-state-transition' END END AS trigger_type, "
    "CASE WHEN variant = 'recovered' AND u % 6 <> 5 THEN s END AS trigger_step, "
    "CASE WHEN variant = 'failure' THEN u % 17 = 0 ELSE u % 7 <> 0 END AS success"
)


def replays(spark: SparkSession, sf_dir: str) -> Replays:
    rows, layout = telemetry(spark, sf_dir)
    rows = layout.with_figures(rows, {"n": F.count(F.lit(1))})
    rows = rows.selectExpr("*", "cast(substring(episode_id, 4) AS BIGINT) AS u", "least(force_z, 90e0) / 2 AS load", BASE.split(", cast")[0], "cast" + BASE.split(", cast")[1])
    sides = [
        rows.selectExpr(
            f"{SCENARIO} AS scenario", "cast(floor(u / 3) AS BIGINT) AS seed", f"'{name}' AS variant", "seq", "seq / 20 AS timestamp",
            *[f"{exprs[i]} AS {c}" for c, exprs in FRAME.items()],
        )
        for i, name in enumerate(("failure", "recovered"))
    ]
    frames = sides[0].unionByName(sides[1])
    sizes = rows.groupBy("u").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.max("back").alias("back"))
    both = sizes.selectExpr("*", "explode(array('failure', 'recovered')) AS variant")
    named = both.selectExpr("*", f"{SCENARIO} AS scenario", "cast(floor(u / 3) AS BIGINT) AS seed")
    runs = named.selectExpr(*KEYS, *_split(RUN))
    kind = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in FAULTS.items())
    event = lambda o, t, typ, src, cond: f"if({cond}, named_struct('ord', {o}, 'time', {t}, 'type', {typ}, 'source', '{src}', 'label', 'x'), NULL)"
    recovered = "variant = 'recovered'"
    entries = ", ".join(
        [
            event(0, "if(variant = 'recovered' AND u % 19 = 5, 1.05D, 1D)", f"CASE scenario {kind} END", "injection", "u % 11 <> 0"),
            event(1, "(s - 1) / 20", "'predicate-violated'", "recovery-monitor", recovered),
            event(2, "s / 20", "'recovery-start'", "recovery-monitor", recovered),
            event(3, "back / 20", "'predicate-restored'", "recovery-monitor", recovered),
        ]
    )
    events = named.selectExpr(*KEYS, f"inline(array_compact(array({entries})))")
    return Replays(runs, frames, events, Layout(layout.chunk_rows, KEYS))


def _split(text: str) -> list[str]:
    """Split a select list at commas outside CASE and brackets."""
    parts, depth, current = [], 0, ""
    for word in text.split(", "):
        current = f"{current}, {word}" if current else word
        depth = current.count("(") - current.count(")") + current.count("CASE") - current.count(" END")
        if depth == 0:
            parts.append(current)
            current = ""
    return parts


REPLAY_PARTS = {
    "rbase": f"SELECT *, {BASE} FROM (SELECT *, cast(substring(episode_id, 4) AS BIGINT) AS u, least(force_z, 90) / 2 AS load, count(*) OVER (PARTITION BY episode_id) AS n FROM tele)",
    "frames": " UNION ALL ".join(
        f"SELECT u, {SCENARIO} AS scenario, u // 3 AS seed, '{name}' AS variant, seq, seq / 20 AS timestamp, n, s, back, " + ", ".join(f"{exprs[i]} AS {c}" for c, exprs in FRAME.items()) + " FROM rbase"
        for i, name in enumerate(("failure", "recovered"))
    ),
    "runs_r": f"SELECT u, scenario, seed, variant, s, back, {RUN} FROM (SELECT DISTINCT u, scenario, seed, variant, n, s, back FROM frames)",
}
