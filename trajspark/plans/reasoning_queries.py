"""Queries: training readiness and task reasoning over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import detect
from trajspark.operators import readiness as rd
from trajspark.operators import reasoning as rs
from trajspark.operators import score, steps
from trajspark.operators import timeseries as ts
from trajspark.plans.diagnosis_queries import P, PARTS, diagnosed, r
from trajspark.plans.oracle import EP, fill_sql, statement
from trajspark.plans.registry import query
from trajspark.plans.telemetry import read_table, telemetry


def action_steps(spark, sf):
    """The telemetry view with two action channels."""
    rows, layout = telemetry(spark, sf)
    return rows.withColumns({"action_1": F.col("camera_motion"), "action_2": F.col("joint_2")}), layout


READY_PARTS = PARTS | {
    "acts": "SELECT *, camera_motion AS action_1, joint_2 AS action_2 FROM stp",
    "actfill": fill_sql("acts", ["joint_1", "joint_2", "action_1", "action_2"]),
    "motion": "SELECT *, sqrt(action_a * action_a + action_b * action_b) AS action_size, (abs(action_a) > 1.05 OR abs(action_b) > 1.05) AS wide, "
    "CASE WHEN dt IS NULL THEN 0 ELSE sqrt(((s1 - lag(s1) OVER w) / safe_dt) ** 2 + ((s2 - lag(s2) OVER w) / safe_dt) ** 2) END AS state_rate FROM "
    "(SELECT *, coalesce(f_action_1, 0) AS action_a, coalesce(f_action_2, 0) AS action_b, coalesce(f_joint_1, 0) AS s1, coalesce(f_joint_2, 0) AS s2 FROM actfill) "
    f"WINDOW w AS ({EP})",
    "resp": "SELECT a.episode_id, b.seq - a.seq AS lag, CASE WHEN count(*) < 8 OR stddev_pop(a.action_size) < 1e-9 OR stddev_pop(b.state_rate) < 1e-9 THEN 0 ELSE corr(a.action_size, b.state_rate) END AS r "
    "FROM motion a JOIN motion b ON a.episode_id = b.episode_id AND b.seq - a.seq BETWEEN 0 AND least(12, a.n // 5) WHERE a.n >= 16 GROUP BY 1, 2",
    "align": "SELECT episode_id, lag AS response_lag, r AS alignment FROM resp QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY r DESC, lag) = 1",
    "phases": f"SELECT episode_id, count(DISTINCT phase) AS phase_count, count(*) FILTER (WHERE phase <> pp) AS phase_transitions FROM (SELECT *, lag(phase) OVER ({EP}) AS pp FROM tele) GROUP BY 1",
    "p65": "SELECT episode_id, quantile_cont(abs(force_z), 0.65) AS q FROM tele GROUP BY 1",
    "contact": "SELECT episode_id, avg((coalesce(gripper, 1) < 0.35 AND coalesce(object_distance, 1) < 0.08)::INT) AS contact_ratio, avg((abs(coalesce(force_z, 0)) > greatest(2, q))::INT) AS force_activity "
    "FROM tele JOIN p65 USING (episode_id) GROUP BY 1",
    "rbase": "SELECT episode_id, count(*) AS rows, count(*) FILTER (WHERE dt <= 0) = 0 AS monotonic, coalesce(stddev_pop(dt) FILTER (WHERE dt > 0) / (avg(dt) FILTER (WHERE dt > 0) + 1e-9), 0) AS jitter, "
    "stddev_pop(action_size) / (avg(action_size) + 1e-9) AS variation, avg(wide::INT) AS oob, any_value(median_dt) AS median_dt, arg_max(success, seq) AS task_success FROM motion GROUP BY 1",
    "rdims": "SELECT rbase.*, alignment, response_lag, 100.0::DOUBLE AS observability, round_even(greatest(0, least(100, 50 + greatest(0, coalesce(alignment, 0)) * 42 - least(20, oob * 200))), 1) AS controllability, "
    "round_even(100 * (0.55::DOUBLE * monotonic::INT + 0.25::DOUBLE * greatest(0, 1 - least(1, jitter / 0.25::DOUBLE)) + 0.20::DOUBLE * (0.6::DOUBLE * least(1, phase_count / 4) + 0.4::DOUBLE * least(1, phase_transitions / 4))), 1) AS temporal_grounding, "
    "round_even(greatest(0, least(100, 20 + CASE WHEN contact_ratio > 0 THEN 45 ELSE 0 END + least(35, force_activity * 120))), 1) AS contact_grounding, "
    "round_even(greatest(0, least(100, 35 + least(1, variation) * 65)), 1) AS behavior_diversity, phase_count, phase_transitions FROM rbase JOIN contact USING (episode_id) JOIN phases USING (episode_id) LEFT JOIN align USING (episode_id)",
    "rscore": "SELECT *, observability * 0.22 + controllability * 0.25 + temporal_grounding * 0.18 + contact_grounding * 0.20 + behavior_diversity * 0.15 AS raw FROM rdims",
    "ready": "SELECT *, round_even(raw, 1) AS score, CASE WHEN NOT monotonic OR raw < 55 THEN 'blocked' WHEN raw < 78 THEN 'review' ELSE 'ready' END AS status FROM rscore",
}


def check(final: str) -> str:
    return statement(READY_PARTS, final)


@query("response_alignment", check("SELECT episode_id, round(alignment, 6) AS alignment, cast(response_lag AS INT) AS response_lag FROM align"))
def response_alignment(spark, sf):
    rows, layout = action_steps(spark, sf)
    moving = rd.with_motion(rows, layout, steps.resolve_roles(rows))
    return rd.response_alignment(moving, layout, "action_size", "state_rate").select("episode_id", r("alignment").alias("alignment"), "response_lag")


@query(
    "phase_transitions",
    "SELECT conv_id AS episode_id, count(DISTINCT role) AS phase_count, count(*) FILTER (WHERE role <> before) AS phase_transitions, "
    "round(0.6 * least(1, count(DISTINCT role) / 4) + 0.4 * least(1, count(*) FILTER (WHERE role <> before) / 4), 6) AS phase_coverage "
    "FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1",
)
def phase_transitions(spark, sf):
    """Conversations as episodes, roles as phases."""
    rows, layout = conversation_steps(spark, sf)
    out = rd.phase_transitions(rows, layout)
    return out.select("episode_id", "phase_count", "phase_transitions", r("phase_coverage").alias("phase_coverage"))


def conversation_steps(spark, sf):
    from dataclasses import replace

    from trajspark.functions.layout import dense_positions

    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("phase"))
    rows, layout = dense_positions(turns, "conv_id", ["turn"])
    return rows.withColumnRenamed("conv_id", "episode_id"), replace(layout, keys=("episode_id",))


@query("first_seen_phases", "SELECT conv_id AS episode_id, role AS phase, cast(min(seq) AS BIGINT) AS first_seq, count(*) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations) GROUP BY 1, 2")
def first_seen_phases(spark, sf):
    rows, layout = conversation_steps(spark, sf)
    return rd.phase_first_seen(rows, layout).orderBy("episode_id", "first_seq")


@query("action_bounds_rate", check("SELECT episode_id, round(oob, 6) AS action_out_of_bounds FROM rbase"))
def action_bounds_rate(spark, sf):
    rows, layout = action_steps(spark, sf)
    moving = rd.with_motion(rows, layout, steps.resolve_roles(rows))
    return rd.action_bounds_rate(moving, layout).select("episode_id", r("action_out_of_bounds").alias("action_out_of_bounds"))


@query("contact_ratio", check("SELECT episode_id, round(contact_ratio, 6) AS contact_ratio, round(force_activity, 6) AS force_activity FROM contact"))
def contact_ratio(spark, sf):
    rows, layout = telemetry(spark, sf)
    out = rd.contact_figures(rows, layout, steps.resolve_roles(rows))
    return out.select("episode_id", r("contact_ratio").alias("contact_ratio"), r("force_activity").alias("force_activity"))


@query(
    "readiness_scores",
    check("SELECT episode_id, observability, controllability, temporal_grounding, contact_grounding, behavior_diversity, score FROM ready"),
)
def readiness_scores(spark, sf):
    return rd.readiness(*action_steps(spark, sf)).select("episode_id", *rd.WEIGHTS, "score")


@query("readiness_blockers", check("SELECT episode_id, status, CASE WHEN monotonic THEN '' ELSE 'TIME_INVALID' END AS blockers, round_even(response_lag * median_dt * 1000, 1) AS response_lag_ms, task_success FROM ready"))
def readiness_blockers(spark, sf):
    out = rd.readiness(*action_steps(spark, sf))
    return out.select("episode_id", "status", F.array_join("blockers", ";").alias("blockers"), "response_lag_ms", "task_success")


@query(
    "readiness_overview",
    check(
        "SELECT count(*) AS episode_count, cast(sum(rows) AS BIGINT) AS row_count, round_even(avg(score), 1) AS score, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'review') AS review, "
        "count(*) FILTER (WHERE status = 'blocked') AS blocked, " + ", ".join(f"round_even(avg({d}), 1) AS {d}" for d in rd.WEIGHTS)
        + ", round_even(count(*) FILTER (WHERE status = 'ready') / count(*) * 100, 1) AS ready_rate, CASE WHEN count(*) FILTER (WHERE status <> 'ready') = 0 AND avg(score) >= 78 THEN 'ready' WHEN avg(score) >= 55 THEN 'review' ELSE 'blocked' END AS status FROM ready"
    ),
)
def readiness_overview(spark, sf):
    return rd.readiness_overview(rd.readiness(*action_steps(spark, sf)))


@query("blocker_counts", check("SELECT 'TIME_INVALID' AS code, count(*) AS episode_count FROM ready WHERE NOT monotonic"))
def blocker_counts(spark, sf):
    return rd.blocker_counts(rd.readiness(*action_steps(spark, sf)))


# ---- task reasoning -------------------------------------------------------------------------------

PHASE_OF = " ".join(f"WHEN '{c}' THEN '{ph}'" for c, (_, ph) in rs.ISSUE_MEANING.items())
MEANS = " ".join(f"WHEN '{c}' THEN '{pr}'" for c, (pr, _) in rs.ISSUE_MEANING.items())
SK = "PARTITION BY episode_id, phase ORDER BY seq"


def _lists() -> str:
    rows = []
    for no, (skill, pre, post) in enumerate(rs.SKILLS):
        for place, key in enumerate((*pre, *post)):
            rows.append(f"SELECT episode_id, {no} AS skill_no, '{skill}' AS skill, {place} AS place, '{key}' AS predicate, '{'precondition' if place < len(pre) else 'effect'}' AS role, {key} AS state, start_time FROM grounded WHERE skill = '{skill}' AND observed")
    return " UNION ALL ".join(rows)


def has(code: str) -> str:
    return f"list_contains(codes, '{code}')"


REASON_PARTS = PARTS | {
    "near": "SELECT placed.episode_id, code, arg_min(phase, (abs(timestamp - start_time), seq)) AS near_phase FROM placed JOIN tele USING (episode_id) WHERE start_time IS NOT NULL GROUP BY 1, 2",
    "located": f"SELECT placed.*, coalesce(near_phase, CASE code {PHASE_OF} ELSE 'approach' END) AS at_phase, CASE code {MEANS} ELSE 'task_complete' END AS violated FROM placed LEFT JOIN near USING (episode_id, code)",
    "sl0": f"SELECT episode_id, seq, phase, timestamp, ee_x, ee_y, force_z, gripper, object_distance, frame_valid, row_number() OVER ({SK}) - 1 AS k, count(*) OVER (PARTITION BY episode_id, phase) AS m, "
    f"timestamp - lag(timestamp) OVER ({SK}) AS pdt, ee_x - lag(ee_x) OVER ({SK}) AS dx, ee_y - lag(ee_y) OVER ({SK}) AS dy FROM tele",
    "slp": "SELECT episode_id, phase, coalesce(quantile_cont(pdt, 0.5) FILTER (WHERE pdt > 0), 0.02) AS pm FROM sl0 GROUP BY 1, 2",
    "sl": "SELECT *, CASE WHEN pdt IS NULL THEN 0 ELSE sqrt((dx / CASE WHEN pdt > 0 THEN pdt ELSE pm END) ** 2 + (dy / CASE WHEN pdt > 0 THEN pdt ELSE pm END) ** 2) END AS pspeed, greatest(3, m // 4) AS q, greatest(3, least(8, m // 12)) AS pw, "
    "greatest(4, least(12, m // 8)) AS h FROM sl0 JOIN slp USING (episode_id, phase)",
    "evid": "SELECT episode_id, phase AS skill, count(*) AS rows, arg_min(timestamp, seq) AS start_time, arg_max(timestamp, seq) AS end_time, "
    f"avg((pspeed > {P.stuck_speed_threshold})::INT) AS moving, avg(frame_valid) AS valid_ratio, max(abs(force_z)) AS peak, "
    "avg((gripper > 0.65)::INT) FILTER (WHERE k < q) AS open_head, avg((gripper < 0.35)::INT) FILTER (WHERE k >= m - q) AS closed_tail, avg((gripper > 0.65)::INT) FILTER (WHERE k >= m - q) AS open_tail, "
    "min(object_distance) AS nearest, min(object_distance) FILTER (WHERE k < h) AS head_nearest, avg((object_distance > 0.08)::INT) FILTER (WHERE k >= m - q) AS apart_tail, "
    f"avg((object_distance < {P.slip_distance_threshold} AND gripper < 0.35)::INT) FILTER (WHERE k >= m - q) AS held_tail, avg((object_distance < {P.slip_distance_threshold} AND gripper < 0.35)::INT) FILTER (WHERE k < pw) AS held_head FROM sl GROUP BY 1, 2",
    "assigned": "SELECT episode_id, at_phase AS skill, list_sort(list(code)) AS codes, bool_or(severity = 'critical') AS critical FROM located GROUP BY 1, 2",
    "grid": "SELECT eps.episode_id, success, no, skill FROM eps, (VALUES (0, 'approach'), (1, 'reach'), (2, 'grasp'), (3, 'transport'), (4, 'place')) v(no, skill)",
    "tr0": "SELECT grid.*, evid.* EXCLUDE (episode_id, skill), coalesce(codes, []) AS codes, coalesce(critical, false) AS critical, evid.rows IS NOT NULL AS observed FROM grid LEFT JOIN evid USING (episode_id, skill) LEFT JOIN assigned USING (episode_id, skill)",
    "tr1": f"SELECT *, CASE WHEN {has('GRASP_SLIP')} THEN false ELSE CASE WHEN skill = 'place' THEN held_head ELSE held_tail END >= 0.6 END AS object_attached, "
    "lead(head_nearest) OVER (PARTITION BY episode_id ORDER BY no) AS next_nearest, bool_or(observed AND skill <> 'approach') OVER (PARTITION BY episode_id) AS reached, bool_or(observed AND skill = 'place') OVER (PARTITION BY episode_id) AS has_place FROM tr0",
    "tr2": "SELECT *, max(CASE WHEN skill = 'place' THEN object_attached END) OVER (PARTITION BY episode_id) AS place_attached, "
    "[x FOR x IN codes IF x IN ('SENSOR_DESYNC', 'FRAME_DROP', 'MISSING_VALUES', 'TIMESTAMP_GAP')] AS stale FROM tr1",
    "grounded": "SELECT *, CASE WHEN stale = ['MISSING_VALUES'] THEN NULL WHEN len(stale) > 0 THEN false ELSE valid_ratio >= 0.98 END AS observation_fresh, "
    f"CASE WHEN {has('FORCE_SPIKE')} THEN false ELSE peak <= {P.force_floor} END AS collision_free, CASE WHEN reached THEN true END AS target_localized, open_head >= 0.6 AS gripper_open, "
    f"least(nearest, next_nearest) < 0.08 AS near_object, closed_tail >= 0.6 AS gripper_closed, CASE WHEN {has('ROBOT_STUCK')} THEN false ELSE moving >= 0.2 END AS motion_progress, "
    "CASE WHEN NOT has_place THEN false ELSE coalesce(place_attached, true) END AS at_goal, open_tail >= 0.6 AND apart_tail >= 0.5 AS object_released, success AS task_complete FROM tr2",
    "preds": _lists(),
    "skills": "SELECT g.episode_id, g.no, g.skill, CASE WHEN NOT observed THEN 'not_observed' WHEN coalesce(bad, false) OR critical THEN 'failed' WHEN coalesce(unk, false) OR len(codes) > 0 THEN 'degraded' ELSE 'completed' END AS status, "
    "round_even(start_time, 3) AS start_time, round_even(end_time, 3) AS end_time, coalesce(rows, 0) AS rows, coalesce(total, 0) AS total, coalesce(known, 0) AS known FROM grounded g LEFT JOIN "
    "(SELECT episode_id, skill, bool_or(state = false) AS bad, bool_or(state IS NULL) AS unk, count(*) AS total, count(state) AS known FROM preds GROUP BY 1, 2) p ON p.episode_id = g.episode_id AND p.skill = g.skill",
    "vio_issue": "SELECT episode_id, violated AS predicate, at_phase AS skill, start_time AS time, code AS issue_code, severity FROM located QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY start_time IS NULL, start_time, "
    "CASE WHEN start_time IS NULL THEN severity <> 'critical' END, CASE WHEN start_time IS NULL THEN code END, place) = 1",
    "vio_graph": "SELECT episode_id, predicate, skill, round_even(start_time, 3) AS time, 'UNSATISFIED_PREDICATE' AS issue_code, 'critical' AS severity FROM preds WHERE state = false QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY skill_no, place) = 1",
    "vio": "SELECT * FROM vio_issue UNION ALL SELECT * FROM vio_graph WHERE episode_id NOT IN (SELECT episode_id FROM vio_issue)",
    "er0": "SELECT episode_id, count(*) FILTER (WHERE status <> 'not_observed') AS observed_skills, count(*) FILTER (WHERE status = 'completed') AS completed_skills, "
    "sum(CASE status WHEN 'completed' THEN 1e0 WHEN 'degraded' THEN 0.65e0 WHEN 'failed' THEN 0.2e0 ELSE 0e0 END) / 5 * 100 AS health, min(no) FILTER (WHERE status = 'failed') AS failed_no, sum(known) / sum(total) * 100 AS coverage FROM skills GROUP BY 1",
    "er": "SELECT eps.episode_id, CASE WHEN observed_skills < 3 OR coverage < 35 THEN 'blocked' WHEN success AND predicate IS NULL THEN 'verified' WHEN success THEN 'degraded' WHEN predicate IS NOT NULL THEN 'recoverable' ELSE 'blocked' END AS status, eps.rows, duration, "
    "round_even(CASE WHEN success THEN 100 WHEN failed_no IS NOT NULL THEN failed_no / 5 * 100 ELSE observed_skills / 5 * 100 END, 1) AS task_progress, round_even(health, 1) AS plan_health, round_even(coverage, 1) AS grounding_coverage, observed_skills, completed_skills, predicate AS violated "
    "FROM eps JOIN er0 USING (episode_id) LEFT JOIN vio USING (episode_id)",
    "lib": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, '{s[0]}', '{s[1]}')" for p, ss in rs.RECOVERY_STEPS.items() for i, s in enumerate(ss, 1)) + ") v(predicate, step, kind, operator)",
}


def why(final: str) -> str:
    return statement(REASON_PARTS, final)


def reasoned(spark, sf) -> rs.Reasoning:
    rows, layout = telemetry(spark, sf)
    rows = layout.spread(rows, "episode_id", rows=read_table(spark, sf, "events").count())
    return rs.reason(rows, P, layout)


@query("nearest_row", why("SELECT episode_id, code, near_phase AS phase FROM near"))
def nearest_row(spark, sf):
    rows, layout = telemetry(spark, sf)
    points = detect.issue_rows(diagnosed(spark, sf)).filter("start_time IS NOT NULL").select("episode_id", "code", "start_time")
    return rs.nearest_phase(rows, points, layout)


@query("dimension_lookup", why("SELECT episode_id, code, violated AS predicate, CASE code " + " ".join(f"WHEN '{c}' THEN '{cat}'" for c, cat, *_ in detect.ISSUE_TYPES) + " END AS category FROM located"))
def dimension_lookup(spark, sf):
    """Issues with their category and the predicate they violate, from two small dimension tables."""
    found = reasoned(spark, sf).issues
    return found.join(F.broadcast(score.issue_dimension(spark)), "code", "left").select("episode_id", "code", "predicate", "category")


@query(
    "edge_window_ratio",
    why("SELECT episode_id, phase AS skill, round(avg((force_z > 35)::INT) FILTER (WHERE k < q), 6) AS head_ratio, round(avg((force_z > 35)::INT) FILTER (WHERE k >= m - q), 6) AS tail_ratio FROM sl GROUP BY 1, 2"),
)
def edge_window_ratio(spark, sf):
    rows, layout = telemetry(spark, sf)
    ranked, by_phase = rs.phase_positions(rows, layout)
    ranked = by_phase.with_figures(ranked, {"_m": F.count(F.lit(1))})
    width = "greatest(3, floor(_m / 4))"
    out = ranked.groupBy(*by_phase.keys).agg(F.expr(rs.edge_ratio("head_ratio", "force_z > 35", True, width)), F.expr(rs.edge_ratio("tail_ratio", "force_z > 35", False, width)))
    return out.select("episode_id", F.col("phase").alias("skill"), r("head_ratio").alias("head_ratio"), r("tail_ratio").alias("tail_ratio"))


@query(
    "with_next_phase_head",
    why(
        "SELECT a.episode_id, a.skill, least(a.nearest, b.head_nearest) AS nearest FROM evid a JOIN evid b ON a.episode_id = b.episode_id AND (a.skill, b.skill) IN "
        "(('approach', 'reach'), ('reach', 'grasp'), ('grasp', 'transport'), ('transport', 'place'))"
    ),
)
def with_next_phase_head(spark, sf):
    """Nearest object distance of a phase together with the first rows of the next phase."""
    rows, layout = telemetry(spark, sf)
    evidence = rs.phase_evidence(rows, layout, steps.resolve_roles(rows), P)
    numbered = evidence.join(F.broadcast(rs.skill_table(spark)), "skill")
    head = numbered.select("episode_id", (F.col("skill_no") - 1).alias("skill_no"), "head_nearest")
    return numbered.drop("head_nearest").join(head, ["episode_id", "skill_no"]).select("episode_id", "skill", F.least("nearest", "head_nearest").alias("nearest"))


@query("predicate_grounding", why("SELECT episode_id, skill, predicate, role, CASE WHEN state IS NULL THEN 'unknown' WHEN state THEN 'true' ELSE 'false' END AS state FROM preds"))
def predicate_grounding(spark, sf):
    return rs.predicate_rows(reasoned(spark, sf)).select("episode_id", "skill", "predicate", "role", "state")


@query("skill_trace", why("SELECT episode_id, skill, status, start_time, end_time, rows FROM skills"))
def skill_trace(spark, sf):
    return reasoned(spark, sf).trace.select("episode_id", "skill", "status", "start_time", "end_time", "rows")


@query("first_violation", why("SELECT episode_id, predicate, skill, round(time, 6) AS time, issue_code, severity FROM vio"))
def first_violation(spark, sf):
    return rs.first_violation(reasoned(spark, sf)).select("episode_id", "predicate", "skill", r("time").alias("time"), "issue_code", "severity")


@query("recovery_plan_join", why("SELECT episode_id, vio.predicate, step, kind, operator, CASE WHEN step = max(step) OVER (PARTITION BY episode_id) THEN vio.predicate END AS restores FROM vio JOIN lib ON lib.predicate = vio.predicate"))
def recovery_plan_join(spark, sf):
    return rs.recovery_plan(rs.first_violation(reasoned(spark, sf)), ["episode_id"])


@query("causal_chain_join", why("SELECT episode_id, predicate, cast(CASE predicate " + " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in rs.CAUSAL_CHAINS.items()) + " END AS INT) AS links FROM vio"))
def causal_chain_join(spark, sf):
    return rs.causal_chains(rs.first_violation(reasoned(spark, sf)), ["episode_id"]).select("episode_id", "predicate", F.size("chain").alias("links"))


@query("episode_reasoning", why("SELECT * FROM er"))
def episode_reasoning(spark, sf):
    return rs.episode_reasoning(reasoned(spark, sf))


STEP_COUNT = "CASE WHEN violated IS NULL THEN 0 " + " ".join(f"WHEN violated = '{p}' THEN {len(s)}" for p, s in rs.RECOVERY_STEPS.items()) + " END"


@query(
    "reasoning_overview",
    why(
        "SELECT count(*) AS episode_count, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("verified", "degraded", "recoverable", "blocked"))
        + ", round_even(count(*) FILTER (WHERE status = 'verified') / count(*) * 100, 1) AS verified_rate, round_even(count(*) FILTER (WHERE status = 'recoverable') / count(*) * 100, 1) AS recoverable_rate, "
        f"round_even(avg(grounding_coverage), 1) AS average_grounding_coverage, round_even(avg(plan_health), 1) AS average_plan_health, cast(sum({STEP_COUNT}) AS BIGINT) AS recovery_steps FROM er"
    ),
)
def reasoning_overview(spark, sf):
    return rs.reasoning_overview(rs.episode_reasoning(reasoned(spark, sf)))


@query("violated_predicates", why("SELECT violated AS predicate, count(*) AS episode_count FROM er WHERE violated IS NOT NULL GROUP BY 1"))
def violated_predicates(spark, sf):
    return rs.violated_predicates(rs.episode_reasoning(reasoned(spark, sf)))


@query(
    "blocking_issue_codes",
    why("SELECT episode_id, array_to_string(list_sort(list(code)), ';') AS blockers FROM located WHERE code IN ('SENSOR_DESYNC', 'FRAME_DROP', 'MISSING_VALUES', 'TIMESTAMP_GAP') GROUP BY 1"),
)
def blocking_issue_codes(spark, sf):
    """Set intersection of an episode's issue codes with those that make observations stale."""
    stale = F.array(*[F.lit(c) for c, (p, _) in rs.ISSUE_MEANING.items() if p == "observation_fresh"])
    found = diagnosed(spark, sf).select("episode_id", F.array_sort(F.array_intersect("issue_codes", stale)).alias("b"))
    return found.filter(F.size("b") > 0).select("episode_id", F.array_join("b", ";").alias("blockers"))
