"""Queries: repair of the telemetry view and its audit trail."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trajspark.operators import repair as rp
from trajspark.operators import sinks, steps
from trajspark.plans.diagnosis_queries import GAP_SQL, P, PARTS, r
from trajspark.plans.oracle import EP, diagnosis_parts, fill_sql, limit_sql, statement
from trajspark.plans.registry import query, scratch_path
from trajspark.plans.telemetry import telemetry


def run(spark, sf) -> rp.Repair:
    rows, layout = telemetry(spark, sf)
    rows = layout.spread(rows, "episode_id")
    return rp.repair_steps(rows, P, layout)


# ---- the same repair in SQL -----------------------------------------------------------------------

CLEAN = "SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY episode_id, timestamp ORDER BY seq {}) = 1"
SPIKE = "coalesce(f0_{j} IS NOT NULL AND f2_{j} IS NOT NULL AND abs(came_{j}) > g_{j} AND abs(went_{j}) > g_{j} AND came_{j} * went_{j} < 0, false)"
REPAIR_PARTS = PARTS | {f"gap_{c}": sql for c, sql in GAP_SQL.items()} | {
    "patched": "SELECT stp.* EXCLUDE (joint_1, joint_2), a.joint_1, a.filled AS filled_1, a.open AS open_1, b.joint_2, b.filled AS filled_2, b.open AS open_2, "
    "stp.joint_1 AS old_1, stp.joint_2 AS old_2 FROM stp JOIN gap_joint_1 a USING (episode_id, seq) JOIN gap_joint_2 b USING (episode_id, seq)",
    "patched_fill": fill_sql("patched", ["joint_1", "joint_2"]),
    "nearby": "SELECT *, lag(timestamp) OVER w AS t0, lead(timestamp) OVER w AS t2, "
    + ", ".join(f"lag(f_{j}) OVER w AS f0_{j}, lead(f_{j}) OVER w AS f2_{j}, coalesce((f_{j} - lag(f_{j}) OVER w) / safe_dt, 0) AS came_{j}" for j in ("joint_1", "joint_2"))
    + f" FROM patched_fill WINDOW w AS ({EP})",
    "jmed": "SELECT episode_id, " + ", ".join(f"quantile_cont(abs(came_{j}), 0.5) AS m_{j}" for j in ("joint_1", "joint_2")) + " FROM nearby GROUP BY 1",
    "jlim": "SELECT episode_id, "
    + ", ".join(limit_sql(f"any_value(m_{j})", f"quantile_cont(abs(abs(came_{j}) - m_{j}), 0.5)", P.joint_velocity_mad_scale, P.joint_velocity_floor) + f" AS g_{j}" for j in ("joint_1", "joint_2"))
    + " FROM nearby JOIN jmed USING (episode_id) GROUP BY 1",
    "judged": "SELECT *, " + ", ".join(f"(f2_{j} - f_{j}) / CASE WHEN t2 > timestamp THEN t2 - timestamp ELSE median_dt END AS went_{j}" for j in ("joint_1", "joint_2"))
    + " FROM nearby JOIN jlim USING (episode_id)",
    "spiked": "SELECT *, " + ", ".join(f"{SPIKE.format(j=j)} AS spike_{i}, f0_{j} + CASE WHEN t2 > t0 THEN (timestamp - t0) / (t2 - t0) ELSE 0.5 END * (f2_{j} - f0_{j}) AS bridge_{i}" for i, j in ((1, "joint_1"), (2, "joint_2")))
    + " FROM judged",
    "facts": f"SELECT episode_id, round_even(sync_offset * 1000, 1) / 1000 AS off, abs(round_even(sync_offset * 1000, 1) / 1000) >= {P.sync_warning_seconds} AND round_even(confidence, 3) >= {P.sync_min_confidence} AS move, "
    "stuck_segment_start AS sa, stuck_segment_end AS sb, CASE WHEN slipped THEN evidence_start END AS la, evidence_end AS lb FROM figs",
    "aimed": "SELECT spiked.*, off, move, sa, sb, la, lb, timestamp + off AS target FROM spiked JOIN facts USING (episode_id)",
    "shifted": "SELECT t.*, CASE WHEN a.timestamp = t.target THEN a.camera_motion WHEN a.timestamp IS NOT NULL AND b.timestamp IS NOT NULL THEN "
    "a.camera_motion + (b.camera_motion - a.camera_motion) * (t.target - a.timestamp) / (b.timestamp - a.timestamp) END AS cam FROM aimed t "
    f"ASOF LEFT JOIN ({CLEAN.format('DESC')}) a ON t.episode_id = a.episode_id AND t.target >= a.timestamp "
    f"ASOF LEFT JOIN ({CLEAN.format('')}) b ON t.episode_id = b.episode_id AND t.target <= b.timestamp",
    "done": "SELECT s.*, (filled_1 OR filled_2) AS MISSING_VALUES, (spike_1 OR spike_2) AS JOINT_JUMP, (move AND cam IS NOT NULL) AS SENSOR_DESYNC, (move AND cam IS NULL) AS SENSOR_DESYNC_EDGE, "
    "(backwards OR gap) AS TIMESTAMP_SEGMENT, backwards AS NON_MONOTONIC_TIME, dropped AS FRAME_DROP, "
    f"max(spike) OVER (PARTITION BY s.episode_id ORDER BY s.seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS FORCE_SPIKE, "
    "coalesce(s.timestamp BETWEEN sa AND sb, false) AS ROBOT_STUCK, coalesce(s.timestamp BETWEEN la AND lb, false) AS GRASP_SLIP, outside > 0 AS WORKSPACE_OUTLIER, "
    "(open_1 OR open_2) AS MISSING_VALUES_UNRESOLVED, cast(sum(CASE WHEN backwards OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY s.episode_id ORDER BY s.seq) AS INT) AS segment_id, "
    "CASE WHEN spike_1 THEN bridge_1 ELSE s.joint_1 END AS new_1, CASE WHEN spike_2 THEN bridge_2 ELSE s.joint_2 END AS new_2, CASE WHEN move AND cam IS NOT NULL THEN cam ELSE s.camera_motion END AS new_cam "
    "FROM shifted s JOIN (SELECT episode_id, seq, backwards, gap, dropped, spike, outside FROM flags) USING (episode_id, seq)",
    "audited": "SELECT *, NOT (" + " OR ".join(c for c, (_, out, _) in rp.ACTIONS.items() if out) + ") AS quality_valid, "
    "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in sorted(rp.ACTIONS)) + ") AS repair_actions FROM done",
    "acts": " UNION ALL ".join(
        f"SELECT episode_id, '{c}' AS code, '{kind}' AS kind, count(*) AS row_count, round_even(arg_min(timestamp, seq), 4) AS start_time, round_even(arg_max(timestamp, seq), 4) AS end_time FROM done WHERE {c} GROUP BY 1"
        for c, (kind, _, _) in rp.ACTIONS.items()
    ),
}
CLEAN_VIEW = (
    "SELECT episode_id, seq, timestamp, phase, new_1 AS joint_1, new_2 AS joint_2, ee_x, ee_y, new_cam AS camera_motion, force_z, frame_valid, gripper, gripper_command, object_distance, is_grasped, success FROM done"
)


def _after_parts() -> dict[str, str]:
    """The diagnosis over the cleaned rows under other names."""
    parts = diagnosis_parts(P, CLEAN_VIEW)
    names = "|".join(sorted(parts, key=len, reverse=True))

    def renamed(text: str) -> str:
        return re.sub(rf"\b({names})\b", r"after_\1", text)

    return {f"after_{n}": (sql if n == "tele" else renamed(sql)) for n, sql in parts.items()}


ALL_PARTS = REPAIR_PARTS | _after_parts()


def check(final: str) -> str:
    return statement(ALL_PARTS, final)


CODES_AFTER = "(SELECT episode_id, issue_codes AS after_codes, issue_count AS after_count, after_eps.quality_score AS after_score FROM after_eps)"
RESOLVED = "array_to_string(list_sort([x FOR x IN string_split(eps.issue_codes, ';') IF x <> '' AND NOT list_contains(string_split(after_codes, ';'), x)]), ';')"

SUMMARY_SQL = check(
    "SELECT episode_id, CASE WHEN quarantined_rows > 0 OR after_count > 0 THEN 'review_required' ELSE 'ready' END AS status, source_rows, modified_rows, interpolated_cells, joint_jump_cells, "
    "sync_corrected_rows, segment_count, quarantined_rows, retained_rows, round_even(retained_rows / source_rows * 100, 2) AS retained_rate, cast(eps.issue_count AS INT) AS before_issue_count, cast(after_count AS INT) AS after_issue_count, "
    f"eps.quality_score AS before_quality_score, after_score AS after_quality_score, {RESOLVED} AS resolved_issues, after_codes AS unresolved_issues FROM "
    "(SELECT episode_id, count(*) AS source_rows, count(*) FILTER (WHERE repair_actions <> '') AS modified_rows, cast(sum(filled_1::INT + filled_2::INT) AS BIGINT) AS interpolated_cells, "
    "cast(sum(spike_1::INT + spike_2::INT) AS BIGINT) AS joint_jump_cells, count(*) FILTER (WHERE SENSOR_DESYNC) AS sync_corrected_rows, max(segment_id) + 1 AS segment_count, "
    "count(*) FILTER (WHERE NOT quality_valid) AS quarantined_rows, count(*) FILTER (WHERE quality_valid) AS retained_rows FROM audited GROUP BY 1) "
    f"JOIN eps USING (episode_id) JOIN {CODES_AFTER} USING (episode_id)"
)


@query(
    "repair_episode",
    check(
        "SELECT episode_id, seq, round(new_1, 8) AS joint_1, round(new_2, 8) AS joint_2, round(old_1, 8) AS joint_1_before, round(old_2, 8) AS joint_2_before, round(new_cam, 8) AS camera_motion, "
        "quality_valid, repair_actions, segment_id FROM audited"
    ),
)
def repair_episode(spark, sf):
    """Every episode repaired: corrected channels, their originals and the audit columns."""
    return run(spark, sf).cleaned.select(
        "episode_id", "seq", r("joint_1", 8).alias("joint_1"), r("joint_2", 8).alias("joint_2"), r("joint_1__original", 8).alias("joint_1_before"),
        r("joint_2__original", 8).alias("joint_2_before"), r("camera_motion", 8).alias("camera_motion"), "quality_valid", "repair_actions", "segment_id",
    )


@query("row_audit_columns", check("SELECT episode_id, seq AS source_row, quality_valid, repair_actions, repair_actions AS repair_reason, segment_id FROM audited"))
def row_audit_columns(spark, sf):
    return rp.row_audit(run(spark, sf))


@query("training_gate", check("SELECT episode_id, count(*) AS rows FROM audited WHERE quality_valid GROUP BY 1"))
def training_gate(spark, sf):
    return steps.training_rows(run(spark, sf).cleaned).groupBy("episode_id").agg(F.count(F.lit(1)).alias("rows"))


@query("interval_mask_join", check("SELECT episode_id, seq, ROBOT_STUCK AS in_stuck, GRASP_SLIP AS in_slip FROM done WHERE ROBOT_STUCK OR GRASP_SLIP"))
def interval_mask_join(spark, sf):
    rows = run(spark, sf).rows.filter("did_robot_stuck OR did_grasp_slip")
    return rows.select("episode_id", "seq", F.col("did_robot_stuck").alias("in_stuck"), F.col("did_grasp_slip").alias("in_slip"))


@query("repair_actions", check("SELECT episode_id, code, kind, row_count, start_time, end_time FROM acts"))
def repair_actions(spark, sf):
    return rp.repair_actions(run(spark, sf)).select("episode_id", "code", "kind", "row_count", "start_time", "end_time")


@query("repair_summary", SUMMARY_SQL)
def repair_summary(spark, sf):
    return rp.repair_summary(run(spark, sf))


@query(
    "issue_resolution",
    check(
        f"SELECT episode_id, eps.issue_codes AS before, {RESOLVED} AS resolved, after_codes AS unresolved, "
        "(SELECT coalesce(string_agg(code, ';' ORDER BY code), '') FROM acts a WHERE a.episode_id = eps.episode_id AND kind = 'correction') AS corrected, "
        "(SELECT coalesce(string_agg(code, ';' ORDER BY code), '') FROM acts a WHERE a.episode_id = eps.episode_id AND kind = 'quarantine') AS quarantined "
        f"FROM eps JOIN {CODES_AFTER} USING (episode_id)"
    ),
)
def issue_resolution(spark, sf):
    out = rp.issue_resolution(run(spark, sf))
    return out.select("episode_id", *[F.array_join(c, ";").alias(c) for c in ("before", "resolved", "unresolved", "corrected", "quarantined")])


@query(
    "resolved_codes",
    check(f"SELECT episode_id, x AS code FROM (SELECT episode_id, unnest(string_split({RESOLVED}, ';')) AS x FROM eps JOIN {CODES_AFTER} USING (episode_id)) WHERE x <> ''"),
)
def resolved_codes(spark, sf):
    """Set difference of the issue codes before and after, as rows."""
    r_ = run(spark, sf)
    return r_.before.select("episode_id", F.explode("issue_codes").alias("code")).exceptAll(
        r_.after.select("episode_id", F.explode("issue_codes").alias("code"))
    )


@query(
    "repair_preview",
    check(
        "SELECT episode_id, seq AS source_row, round_even(timestamp, 4) AS timestamp, quality_valid, repair_actions, "
        "cast((NOT (round(new_1, 8) IS NOT DISTINCT FROM round(old_1, 8)))::INT + (NOT (round(new_2, 8) IS NOT DISTINCT FROM round(old_2, 8)))::INT + (NOT (round(new_cam, 8) IS NOT DISTINCT FROM round(camera_motion, 8)))::INT AS INT) AS changed "
        f"FROM audited WHERE repair_actions <> '' QUALIFY row_number() OVER ({EP}) <= 30"
    ),
)
def repair_preview(spark, sf):
    return rp.repair_preview(run(spark, sf)).withColumn("changed", F.size("changes")).drop("changes")


OUTCOMES = (
    f"SELECT 'resolved' AS outcome, unnest(string_split({RESOLVED}, ';')) AS code FROM eps JOIN {CODES_AFTER} USING (episode_id) UNION ALL "
    f"SELECT 'unresolved', unnest(string_split(after_codes, ';')) FROM eps JOIN {CODES_AFTER} USING (episode_id)"
)
COUNTED = "(SELECT coalesce(string_agg(concat(code, ' ', n), ';' ORDER BY code), '') FROM (SELECT code, count(*) AS n FROM outcomes WHERE outcome = '{0}' AND code <> '' GROUP BY 1)) AS {0}"


@query(
    "batch_repair_summary",
    f"WITH acts AS ({check('SELECT * FROM acts')}), outcomes AS ({check(OUTCOMES)}) "
    "SELECT count(*) AS episode_count, " + "".join(f"cast(coalesce(sum({c}), 0) AS BIGINT) AS {c}, " for c in ("source_rows", "modified_rows", "quarantined_rows", "retained_rows"))
    + "coalesce(round_even(sum(retained_rows) / sum(source_rows) * 100, 2), 0) AS retained_rate, "
    "CASE WHEN sum(quarantined_rows) > 0 OR sum(after_issue_count) > 0 THEN 'review_required' ELSE 'ready' END AS status, "
    "(SELECT coalesce(string_agg(concat(code, ' ', episodes, ' ', n), ';' ORDER BY n DESC, code), '') FROM (SELECT code, count(*) AS episodes, sum(row_count) AS n FROM acts GROUP BY 1)) AS actions, "
    f"{COUNTED.format('resolved')}, {COUNTED.format('unresolved')} FROM ({SUMMARY_SQL})",
)
def batch_repair_summary(spark, sf):
    """The dataset's totals, its actions with their episodes and rows, most rows first, and its issue codes, resolved and not, with their episodes."""
    r_ = run(spark, sf)
    out = rp.batch_summary(rp.repair_summary(r_), rp.repair_actions(r_), rp.issue_resolution(r_))
    joined = "array_join(transform({0}, x -> concat_ws(' ', {1})), ';') AS {0}"
    lists = [("actions", "x.code, x.episode_count, x.row_count"), ("resolved", "x.code, x.episode_count"), ("unresolved", "x.code, x.episode_count")]
    return out.selectExpr(*[c for c in out.columns if c not in dict(lists)], *[joined.format(*x) for x in lists])


@query("batch_repair_actions", check("SELECT code, count(*) AS episode_count, cast(sum(row_count) AS BIGINT) AS row_count FROM acts GROUP BY 1"))
def batch_repair_actions(spark, sf):
    return rp.batch_actions(rp.repair_actions(run(spark, sf)))


@query(
    "batch_repair_resolution",
    check(
        "SELECT outcome, code, count(*) AS episode_count FROM ("
        f"SELECT 'resolved' AS outcome, unnest(string_split({RESOLVED}, ';')) AS code FROM eps JOIN {CODES_AFTER} USING (episode_id) UNION ALL "
        f"SELECT 'unresolved', unnest(string_split(after_codes, ';')) FROM eps JOIN {CODES_AFTER} USING (episode_id)) WHERE code <> '' GROUP BY 1, 2"
    ),
)
def batch_repair_resolution(spark, sf):
    """In how many episodes each issue code was resolved, and in how many it stayed."""
    return rp.batch_resolution(rp.issue_resolution(run(spark, sf)))


# ---- sinks ----------------------------------------------------------------------------------------


@query("write_cleaned_parquet", check("SELECT episode_id, count(*) AS rows, count(*) FILTER (WHERE quality_valid) AS retained FROM audited GROUP BY 1"))
def write_cleaned_parquet(spark, sf):
    """Write the cleaned rows, read them back and count."""
    path = scratch_path(spark, "cleaned")
    sinks.write_cleaned_parquet(run(spark, sf).cleaned, path)
    back = spark.read.parquet(path)
    return back.groupBy("episode_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("quality_valid").alias("retained"))


@query(
    "write_episode_summary",
    f"SELECT episode_id, status, source_rows, modified_rows, quarantined_rows, retained_rows, retained_rate, segment_count, before_issue_count, after_issue_count, before_quality_score, after_quality_score, "
    f"nullif(resolved_issues, '') AS resolved_issues, nullif(unresolved_issues, '') AS unresolved_issues FROM ({SUMMARY_SQL})",
)
def write_episode_summary(spark, sf):
    path = scratch_path(spark, "episode-summary")
    table = sinks.episode_summary(rp.repair_summary(run(spark, sf)))
    sinks.write_csv(table, path)
    return spark.read.csv(path, header=True, schema=table.schema)


CSV_SIGNALS = {"joint_1": "old_1", "joint_2": "old_2"} | {c: c for c in ("ee_x", "ee_y", "camera_motion", "force_z", "gripper", "object_distance")}
CSV_COLUMNS = {c: f"{c}::VARCHAR" for c in ("episode_id", "seq", "timestamp", "phase")} | {
    "joint_1": "new_1::VARCHAR", "joint_2": "new_2::VARCHAR", "ee_x": "ee_x::VARCHAR", "ee_y": "ee_y::VARCHAR", "camera_motion": "new_cam::VARCHAR",
    **{c: f"{c}::VARCHAR" for c in ("force_z", "frame_valid", "gripper", "gripper_command", "object_distance")},
    **{c: f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END" for c in ("is_grasped", "success")},
    **{f"{c}__original": f"{e}::VARCHAR" for c, e in CSV_SIGNALS.items()},
    "source_row": "seq::VARCHAR", "quality_valid": "CASE WHEN quality_valid THEN 'True' ELSE 'False' END",
    "repair_actions": "repair_actions", "repair_reason": "repair_actions", "segment_id": "segment_id::VARCHAR",
}
# The bytes are compared, so the camera's line between two samples is worked out in the order of repair_steps.
CSV_PARTS = ALL_PARTS | {
    "shifted": ALL_PARTS["shifted"].replace(
        "(b.camera_motion - a.camera_motion) * (t.target - a.timestamp) / (b.timestamp - a.timestamp)",
        "(t.target - a.timestamp) / (b.timestamp - a.timestamp) * (b.camera_motion - a.camera_motion)",
    ),
    "csv_lines": "SELECT episode_id, seq, new_1, new_cam, " + " || ',' || ".join(f"coalesce({e}, '')" for e in CSV_COLUMNS.values()) + " || chr(10) AS line FROM audited",
    "csv_texts": "SELECT episode_id, count(*) AS rows, round(sum(new_1), 7) AS joint_1_sum, round(sum(new_cam), 7) AS camera_sum, "
    f"concat(chr(65279), '{','.join(CSV_COLUMNS)}', chr(10), string_agg(line, '' ORDER BY seq)) AS text FROM csv_lines GROUP BY 1",
}


@query("repair_csv", statement(CSV_PARTS, "SELECT episode_id, rows, joint_1_sum, camera_sum, cast(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM csv_texts"))
def repair_csv(spark, sf):
    """Every cleaned episode as a CSV document with a hash of its bytes; the documents are read back and counted."""
    path = scratch_path(spark, "repair-csv")
    r_ = run(spark, sf)
    sinks.write_episode_csv(r_, path)
    back = sinks.read_episode_csv(r_, path).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("rows"), r(F.sum("joint_1"), 7).alias("joint_1_sum"), r(F.sum("camera_motion"), 7).alias("camera_sum")
    )
    return back.join(sinks.episode_csv_sha256(r_), "episode_id")


@query("write_manifest", f"SELECT count(*) AS episode_count, cast(sum(source_rows) AS BIGINT) AS source_rows, cast(sum(retained_rows) AS BIGINT) AS retained_rows, 'review_required' AS status FROM ({SUMMARY_SQL})")
def write_manifest(spark, sf):
    """Write the dataset manifest with hashes of the written files; read its totals back."""
    r_ = run(spark, sf)
    data, out = scratch_path(spark, "manifest-data"), scratch_path(spark, "manifest")
    sinks.write_cleaned_parquet(r_.cleaned, data)
    sinks.write_json(sinks.manifest(r_, "telemetry", data), out)
    back = spark.read.json(out)
    return back.select("summary.episode_count", "summary.source_rows", "summary.retained_rows", "status")


@query("artifact_hashes")
def artifact_hashes(spark, sf):
    path = scratch_path(spark, "artifacts")
    sinks.write_cleaned_parquet(run(spark, sf).cleaned, path)
    return sinks.artifact_hashes(spark, path)
