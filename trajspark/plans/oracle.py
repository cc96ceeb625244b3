"""DuckDB statements for checking: named common table expressions, joined to a statement as needed."""

from __future__ import annotations

import re

from trajspark.plans.telemetry import TELEMETRY_PROFILE, TELEMETRY_SQL
from trajspark.profiles import Profile

EP = "PARTITION BY episode_id ORDER BY seq"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
AHEAD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def statement(parts: dict[str, str], final: str) -> str:
    """``WITH`` the parts that the final select needs, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(parts[name])

    visit(final)
    chosen = [f"{name} AS ({parts[name]})" for name in parts if name in needed]
    return (f"WITH {', '.join(chosen)} " if chosen else "") + final


def fill_sql(source: str, channels: list[str]) -> str:
    """Linear by row position, nearest value at the edges: adds ``f_<channel>``."""
    inner = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER ({EP} {PAST}) AS ps_{c}, "
        f"last_value({c} IGNORE NULLS) OVER ({EP} {PAST}) AS pv_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER ({EP} {AHEAD}) AS ns_{c}, "
        f"first_value({c} IGNORE NULLS) OVER ({EP} {AHEAD}) AS nv_{c}"
        for c in channels
    )
    outer = ", ".join(
        f"CASE WHEN ps_{c} IS NULL THEN nv_{c} WHEN ns_{c} IS NULL OR ns_{c} = ps_{c} THEN pv_{c} "
        f"ELSE pv_{c} + (nv_{c} - pv_{c}) * ((seq - ps_{c}) / (ns_{c} - ps_{c})) END AS f_{c}"
        for c in channels
    )
    return f"SELECT *, {outer} FROM (SELECT *, {inner} FROM {source})"


def limit_sql(med: str, mad: str, scale: float, floor: float) -> str:
    return f"greatest({floor}, {med} + {scale} * 1.4826 * greatest({mad}, 1e-9))"


def runs_sql(source: str, mask: str) -> str:
    """Runs of true rows of any length."""
    return (
        "SELECT episode_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS rows, arg_min(timestamp, seq) AS start_time, "
        "arg_max(timestamp, seq) AS end_time, max(median_dt) AS median_dt FROM (SELECT *, seq - row_number() OVER "
        f"({EP}) AS island FROM {source} WHERE {mask}) GROUP BY episode_id, island"
    )


def diagnosis_parts(p: Profile = TELEMETRY_PROFILE, view: str = TELEMETRY_SQL, full: bool = True) -> dict[str, str]:
    """Tables of the diagnosis over a step view. ``full`` is the telemetry view, otherwise only its
    time, phase, ``ee_x``, ``ee_y``, ``force_z`` and ``success`` are used (other rules are absent)."""
    joints = ["joint_1", "joint_2"] if full else []
    limits = "".join(
        f", {limit_sql(f'm_{j}', f'd_{j}', p.joint_velocity_mad_scale, p.joint_velocity_floor)} AS l_{j}" for j in joints
    )
    numeric = ["ee_x", "ee_y", "force_z"] + (
        ["joint_1", "joint_2", "camera_motion", "frame_valid", "gripper", "gripper_command", "object_distance"] if full else []
    )
    false = "false"
    rules = {
        "jump": " OR ".join(f"coalesce(v_{j} > l_{j}, false)" for j in joints) or false,
        "dropped": "coalesce(frame_valid, 0) < 0.5" if full else false,
        "mismatch": "coalesce(gripper_command < -0.5 AND gripper > 0.65, false)" if full else false,
        "slip": f"coalesce(gripper < {p.slip_gripper_closed} AND object_distance > {p.slip_distance_threshold} "
        f"AND object_distance - prev_distance > {p.slip_step_threshold}, false)" if full else false,
        "loss": f"coalesce(gripper < {p.slip_gripper_closed} AND prev_grasped AND NOT is_grasped, false)" if full else false,
    }
    ox = " + ".join(
        f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END" for c, (lo, hi) in p.workspace.items() if c != "ee_z"
    )
    parts = {
        "tele": view,
        "st": f"SELECT *, timestamp - lag(timestamp) OVER w AS dt, count(*) OVER (PARTITION BY episode_id) AS n, "
        f"lag(object_distance) OVER w AS prev_distance, lag(is_grasped) OVER w AS prev_grasped FROM tele WINDOW w AS ({EP})",
        "per": "SELECT episode_id, coalesce(quantile_cont(dt, 0.5) FILTER (WHERE dt > 0), 0.02) AS median_dt FROM st GROUP BY 1",
        "stp": "SELECT st.*, median_dt, CASE WHEN dt > 0 THEN dt ELSE median_dt END AS safe_dt FROM st JOIN per USING (episode_id)",
        "filled": fill_sql("stp", ["joint_1", "joint_2", "ee_x", "ee_y", "camera_motion"]),
        "rates": "SELECT *, "
        + ", ".join(
            f"abs(CASE WHEN dt IS NULL THEN 0 ELSE (f_{j} - lag(f_{j}) OVER w) / safe_dt END) AS v_{j}" for j in ("joint_1", "joint_2", "ee_x", "ee_y")
        )
        + f" FROM filled WINDOW w AS ({EP})",
        "moved": "SELECT *, sqrt(v_ee_x * v_ee_x + v_ee_y * v_ee_y) AS speed FROM rates",
        "meds": "SELECT episode_id, quantile_cont(v_joint_1, 0.5) AS m_joint_1, quantile_cont(v_joint_2, 0.5) AS m_joint_2, "
        "quantile_cont(abs(force_z), 0.5) AS m_force FROM moved GROUP BY 1",
        "mads": "SELECT episode_id, any_value(m_joint_1) AS m_joint_1, any_value(m_joint_2) AS m_joint_2, any_value(m_force) AS m_force, "
        "quantile_cont(abs(v_joint_1 - m_joint_1), 0.5) AS d_joint_1, quantile_cont(abs(v_joint_2 - m_joint_2), 0.5) AS d_joint_2, "
        "quantile_cont(abs(abs(force_z) - m_force), 0.5) AS d_force FROM moved JOIN meds USING (episode_id) GROUP BY 1",
        "limits": f"SELECT episode_id, {limit_sql('m_force', 'd_force', p.force_mad_scale, p.force_floor)} AS l_force{limits} FROM mads",
        "flags": f"SELECT moved.*, l_force, {', '.join(f'l_{j}' for j in joints) or '1 AS l_none'}, "
        "coalesce(dt <= 0, false) AS backwards, "
        f"coalesce(dt > greatest(median_dt * {p.gap_period_multiplier}, median_dt + {p.gap_extra_seconds}), false) AS gap, "
        f"coalesce(abs(force_z) > l_force, false) AS spike, "
        f"coalesce(speed < {p.stuck_speed_threshold} AND lower(phase) NOT IN ('idle', 'reset'), false) AS stuck, "
        + ", ".join(f"({r}) AS {n}" for n, r in rules.items())
        + f", {ox} AS outside FROM moved JOIN limits USING (episode_id)",
        "runs": " UNION ALL ".join(
            f"SELECT '{k}' AS kind, * FROM ({runs_sql('flags', m)})" for k, m in (("drop", "dropped"), ("stuck", "stuck"), ("mismatch", "mismatch"))
        ),
        "segs": "SELECT * FROM runs WHERE rows >= 2 AND end_time - start_time >= CASE kind "
        f"WHEN 'drop' THEN greatest(median_dt, {p.frame_drop_min_duration}) WHEN 'stuck' THEN {p.stuck_min_duration} ELSE 0.5 END",
        "sums": "SELECT episode_id, count(*) AS rows, arg_min(timestamp, seq) AS first_time, arg_max(timestamp, seq) AS last_time, "
        "any_value(median_dt) AS median_dt, coalesce(stddev_pop(dt) FILTER (WHERE dt > 0) / (avg(dt) FILTER (WHERE dt > 0) + 1e-9), 0) AS jitter, "
        + "sum(" + " + ".join(f"({c} IS NULL)::INT" for c in numeric) + ") AS missing_cells, "
        + f"count(*) * {len(numeric)} AS total_cells, "
        "count(*) FILTER (WHERE backwards) AS backwards_rows, count(*) FILTER (WHERE gap) AS gap_rows, "
        "arg_min(timestamp - dt, seq) FILTER (WHERE gap) AS gap_start, arg_max(timestamp, seq) FILTER (WHERE gap) AS gap_end, max(dt) FILTER (WHERE gap) AS largest_gap, "
        + ", ".join(
            f"count(*) FILTER (WHERE {f}) AS {a}_rows, arg_min(timestamp, seq) FILTER (WHERE {f}) AS {a}_start, arg_max(timestamp, seq) FILTER (WHERE {f}) AS {a}_end"
            for f, a in (("dropped", "drop"), ("jump", "jump"), ("spike", "spike"), ("slip", "slip"), ("loss", "loss"))
        )
        + ", sum(outside) AS outside_samples, max(l_force) AS force_limit, max(abs(force_z)) FILTER (WHERE spike) AS peak_force, arg_max(success, seq) AS success FROM flags GROUP BY 1",
        "segsums": "SELECT episode_id, "
        + ", ".join(
            f"count(*) FILTER (WHERE kind = '{k}') AS {k}_segments, coalesce(sum(rows) FILTER (WHERE kind = '{k}'), 0) AS {k}_segment_rows, "
            f"arg_min(start_time, start_seq) FILTER (WHERE kind = '{k}') AS {k}_segment_start, arg_max(end_time, end_seq) FILTER (WHERE kind = '{k}') AS {k}_segment_end"
            for k in ("drop", "stuck", "mismatch")
        )
        + " FROM segs GROUP BY 1",
        "lags": "SELECT a.episode_id, b.seq - a.seq AS lag, corr(a.speed, b.f_camera_motion) AS r, count(*) AS pairs FROM moved a "
        "JOIN moved b ON a.episode_id = b.episode_id AND abs(b.seq - a.seq) <= "
        f"least(cast(floor({p.sync_max_lag_seconds} / a.median_dt) AS INT), cast(floor(a.n / 3) AS INT)) "
        "WHERE a.n >= 20 GROUP BY 1, 2 HAVING count(*) >= 10",
        "sync": "SELECT episode_id, lag, greatest(0, r) AS confidence FROM lags WHERE r IS NOT NULL AND NOT isnan(r) "
        "QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY r DESC, lag) = 1" if full
        else "SELECT episode_id, 0 AS lag, 0.0 AS confidence FROM per",
        "figs0": "SELECT sums.*, segsums.* EXCLUDE (episode_id, drop_segments, stuck_segments, mismatch_segments, mismatch_segment_rows), "
        "coalesce(drop_segments, 0) AS drop_segments, coalesce(stuck_segments, 0) AS stuck_segments, coalesce(mismatch_segments, 0) AS mismatch_segments, "
        "coalesce(mismatch_segment_rows, 0) AS mismatch_segment_rows, coalesce(lag * median_dt, 0) AS sync_offset, coalesce(confidence, 0) AS confidence, "
        "missing_cells / greatest(1, total_cells) AS missing_rate, (slip_rows >= 3 OR loss_rows > 0) AS slipped "
        "FROM sums LEFT JOIN segsums USING (episode_id) LEFT JOIN sync USING (episode_id)",
        "figs": "SELECT *, "
        f"(abs(sync_offset) >= {p.sync_warning_seconds} AND confidence >= {p.sync_min_confidence}) AS desynced, "
        "CASE WHEN slip_rows >= 3 THEN slip_rows ELSE loss_rows END AS evidence_rows, "
        "CASE WHEN slip_rows >= 3 THEN slip_start ELSE loss_start END AS evidence_start, "
        "CASE WHEN slip_rows >= 3 THEN slip_end ELSE loss_end END AS evidence_end, "
        "round_even(greatest(0, 100 - least(100, missing_rate * 1200)), 1) AS completeness, "
        "round_even(greatest(0, 100 - least(100, backwards_rows * 20.0 + gap_rows * 12.0 + greatest(0, jitter - 0.08) * 80)), 1) AS temporal, "
        "round_even(greatest(0, 100 - least(100, jump_rows * 9e0 + stuck_segments * 42e0 + mismatch_segments * 35e0)), 1) AS motion, "
        "CASE WHEN confidence >= 0.25 THEN round_even(greatest(0, 100 - least(100, abs(sync_offset) * 350)), 1) ELSE 80.0 END AS sync, "
        "round_even(greatest(0, 100 - least(100, outside_samples * 8e0 + CASE WHEN spike_rows > 0 THEN 55 + least(30, spike_rows * 5e0) ELSE 0 END "
        "+ CASE WHEN slipped THEN 62 ELSE 0 END)), 1) AS safety FROM figs0",
        "issues": " UNION ALL ".join(
            f"SELECT episode_id, {i} AS rule, '{code}' AS code, {sev} AS severity, cast({cnt} AS BIGINT) AS count, {s} AS start_time, {e} AS end_time FROM figs WHERE {cond}"
            for i, (code, sev, cnt, s, e, cond) in enumerate(
                [
                    ("MISSING_VALUES", "CASE WHEN missing_rate < 0.02 THEN 'warning' ELSE 'critical' END", "missing_cells", "NULL::DOUBLE", "NULL::DOUBLE", "missing_cells > 0"),
                    ("FRAME_DROP", "'critical'", "drop_rows", "drop_start", "drop_end", "drop_rows > 0"),
                    ("NON_MONOTONIC_TIME", "'critical'", "backwards_rows", "NULL::DOUBLE", "NULL::DOUBLE", "backwards_rows > 0"),
                    ("TIMESTAMP_GAP", "'warning'", "gap_rows", "gap_start", "gap_end", "gap_rows > 0"),
                    ("JOINT_JUMP", "'critical'", "jump_rows", "jump_start", "jump_end", "jump_rows > 0"),
                    ("ROBOT_STUCK", "'critical'", "stuck_segments", "stuck_segment_start", "stuck_segment_end", "stuck_segments > 0"),
                    ("SENSOR_DESYNC", f"CASE WHEN abs(sync_offset) >= {p.sync_critical_seconds} THEN 'critical' ELSE 'warning' END", "1", "NULL::DOUBLE", "NULL::DOUBLE", "desynced"),
                    ("FORCE_SPIKE", "'critical'", "spike_rows", "spike_start", "spike_end", "spike_rows > 0"),
                    ("GRIPPER_RESPONSE_FAILURE", "'critical'", "mismatch_segment_rows", "mismatch_segment_start", "mismatch_segment_end", "mismatch_segments > 0"),
                    ("GRASP_SLIP", "'critical'", "evidence_rows", "evidence_start", "evidence_end", "slipped"),
                    ("WORKSPACE_OUTLIER", "'critical'", "outside_samples", "NULL::DOUBLE", "NULL::DOUBLE", "outside_samples > 0"),
                ]
            )
        ),
        "placed": "SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY severity <> 'critical', rule) - 1 AS place FROM issues",
        "crit": "SELECT episode_id, count(*) AS issue_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count, "
        "string_agg(code, ';' ORDER BY place) AS issue_codes, arg_min(code, place) AS primary_issue_code FROM placed GROUP BY 1",
        "raw0": "SELECT figs.*, coalesce(issue_count, 0) AS issue_count, coalesce(critical_count, 0) AS critical_count, coalesce(issue_codes, '') AS issue_codes, primary_issue_code, "
        "completeness * 0.22 + temporal * 0.20 + motion * 0.20 + sync * 0.18 + safety * 0.20 - coalesce(critical_count, 0) * 6.0 AS r0 FROM figs LEFT JOIN crit USING (episode_id)",
        "raw1": "SELECT *, CASE WHEN critical_count > 0 THEN least(r0, 79.0) ELSE r0 END AS r1 FROM raw0",
        "raw2": "SELECT *, greatest(0, CASE WHEN least(completeness, temporal, motion, sync, safety) < 40 THEN least(r1, 69.0) ELSE r1 END) AS raw_score FROM raw1",
        "causes": " UNION ALL ".join(
            f"SELECT episode_id, {i} AS place, '{label}' AS label FROM figs WHERE {cond}"
            for i, (label, cond) in enumerate(
                [("frames lost in capture", "drop_rows > 0"), ("collision or contact", "spike_rows > 0"), ("execution stalled", "stuck_segments > 0"),
                 ("gripper did not act", "mismatch_segments > 0"), ("object slipped", "slipped"), ("sensors out of step", "desynced"), ("unstable control", "jump_rows > 0")]
            )
        ),
        "eps": "SELECT raw2.*, round_even(raw_score, 1) AS quality_score, CASE WHEN raw_score >= 90 THEN 'A' WHEN raw_score >= 78 THEN 'B' WHEN raw_score >= 65 THEN 'C' ELSE 'D' END AS grade, "
        "round_even(greatest(0, last_time - first_time), 3) AS duration, round_even(1 / median_dt, 2) AS sample_rate, "
        "coalesce(labels, CASE WHEN success THEN '' ELSE 'task failed' END) AS causes_list, coalesce(first_label, CASE WHEN success THEN 'nothing found' ELSE 'task failed' END) AS primary_cause "
        "FROM raw2 LEFT JOIN (SELECT episode_id, string_agg(label, ';' ORDER BY place) AS labels, arg_min(label, place) AS first_label FROM causes GROUP BY 1) USING (episode_id)",
    }
    return parts
