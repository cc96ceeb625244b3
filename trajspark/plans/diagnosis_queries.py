"""Queries: projections, time series, detectors, scores and roll-ups over the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import norm, numeric
from trajspark.operators import detect, score, steps
from trajspark.operators import timeseries as ts
from trajspark.plans.oracle import EP, diagnosis_parts, runs_sql, statement
from trajspark.plans.registry import query
from trajspark.plans.telemetry import JOINTS, TELEMETRY_PROFILE, read_table, telemetry
from trajspark.profiles import profile_table

P = TELEMETRY_PROFILE
PARTS = diagnosis_parts(P)


def check(final: str) -> str:
    return statement(PARTS, final)


def r(column, digits: int = 6):
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits)


def inspected(spark: SparkSession, sf: str) -> detect.Diagnosis:
    rows, layout = telemetry(spark, sf)
    return detect.inspect_steps(rows, P, layout)


def diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_episodes(inspected(spark, sf))


def flagged(spark: SparkSession, sf: str) -> tuple[DataFrame, object]:
    rows, layout = telemetry(spark, sf)
    return detect.flagged_rows(rows, layout, P), layout


# ---- projections and filters ----------------------------------------------------------------------


@query(
    "validate_steps",
    "SELECT cast(user_id AS VARCHAR) AS episode_id, event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS timestamp, value "
    "FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL",
)
def validate_steps(spark, sf):
    raw = read_table(spark, sf, "events").select(
        F.col("user_id").alias("episode_id"), "event_id", F.get_json_object("props", "$.k").alias("timestamp"), "value"
    )
    return steps.validate_steps(raw)


@query("filter_episode", check("SELECT episode_id, seq, timestamp, phase, force_z FROM tele WHERE episode_id = 'EP-00007'"))
def filter_episode(spark, sf):
    rows, _ = telemetry(spark, sf)
    return steps.filter_episode(rows, "EP-00007").select("episode_id", "seq", "timestamp", "phase", "force_z")


@query(
    "active_phase_mask",
    "SELECT conv_id, turn, coalesce(lower(role) NOT IN ('idle', 'reset'), true) AS active FROM conversations",
)
def active_phase_mask(spark, sf):
    turns = read_table(spark, sf, "conversations").withColumnRenamed("role", "phase")
    return turns.select("conv_id", "turn", steps.active_phase(steps.resolve_roles(turns)).alias("active"))


@query("workspace_predicate", check("SELECT episode_id, seq, ee_x, ee_y FROM tele WHERE ee_x < -1.2 OR ee_x > 1.2 OR ee_y < -1.2 OR ee_y > 1.2"))
def workspace_predicate(spark, sf):
    rows, _ = telemetry(spark, sf)
    return steps.outside_workspace(rows, P).select("episode_id", "seq", "ee_x", "ee_y")


@query(
    "profile_table",
    check(
        "SELECT p.profile_id, count(*) AS outside_rows, count(DISTINCT episode_id) AS episodes FROM tele "
        "JOIN (VALUES ('generic-manipulator', -1.2, 1.2), ('franka-panda', -0.9, 0.9)) p(profile_id, lo, hi) ON ee_x < lo OR ee_x > hi GROUP BY 1"
    ),
)
def profiles(spark, sf):
    """Steps outside the workspace under each known profile (a table with one row per profile)."""
    rows, _ = telemetry(spark, sf)
    known = profile_table(spark).select("profile_id", "workspace_x_min", "workspace_x_max")
    outside = ~F.col("ee_x").between(F.col("workspace_x_min"), F.col("workspace_x_max"))
    return (
        rows.select("episode_id", "ee_x").join(F.broadcast(known), outside)
        .groupBy("profile_id").agg(F.count(F.lit(1)).alias("outside_rows"), F.count_distinct("episode_id").alias("episodes"))
    )


@query(
    "timeseries_select",
    check(
        "SELECT episode_id, seq, round(timestamp, 4) AS timestamp, phase, round(ee_x, 5) AS ee_x, round(ee_y, 5) AS ee_y, round(camera_motion, 5) AS camera_motion, "
        "round(force_z, 5) AS force_z, round(gripper, 5) AS gripper, round(object_distance, 5) AS object_distance, round(joint_1, 5) AS joint_1, round(joint_2, 5) AS joint_2 FROM tele"
    ),
)
def timeseries_select(spark, sf):
    rows, _ = telemetry(spark, sf)
    return steps.chart_series(rows)


# ---- windows and time series ----------------------------------------------------------------------


@query("step_interval", check("SELECT episode_id, seq, round(dt, 6) AS dt FROM st"))
def step_interval(spark, sf):
    rows, layout = telemetry(spark, sf)
    return ts.step_interval(rows, layout).select("episode_id", "seq", r("dt").alias("dt"))


@query("sample_period", check("SELECT episode_id, round(median_dt, 6) AS period, round(1 / median_dt, 4) AS rate FROM per"))
def sample_period(spark, sf):
    rows, layout = telemetry(spark, sf)
    rows = ts.step_interval(rows.select("episode_id", "seq", "timestamp"), layout)
    period = F.coalesce("period", F.lit(ts.DEFAULT_PERIOD))
    return layout.quantiles(rows, {"period": (ts.positive(), 0.5)}).select("episode_id", r(period).alias("period"), r(1 / period, 4).alias("rate"))


@query(
    "time_jitter",
    check("SELECT episode_id, round(coalesce(stddev_pop(dt) FILTER (WHERE dt > 0) / (avg(dt) FILTER (WHERE dt > 0) + 1e-9), 0), 6) AS jitter FROM st GROUP BY 1"),
)
def time_jitter(spark, sf):
    rows, layout = telemetry(spark, sf)
    return ts.step_interval(rows, layout).groupBy("episode_id").agg(r(ts.time_jitter()).alias("jitter"))


@query("interpolate_positional", check("SELECT episode_id, seq, round(f_joint_1, 8) AS joint_1, round(f_joint_2, 8) AS joint_2 FROM filled"))
def interpolate_positional(spark, sf):
    rows, layout = telemetry(spark, sf)
    out = ts.interpolate_positional(rows, layout, JOINTS)
    return out.select("episode_id", "seq", *[r(f"{c}__fill", 8).alias(c) for c in JOINTS])


@query("motion_speed", check("SELECT episode_id, seq, round(speed, 6) AS speed FROM moved"))
def motion_speed(spark, sf):
    rows, layout = telemetry(spark, sf)
    return ts.with_speed(rows, layout, steps.resolve_roles(rows)).select("episode_id", "seq", r("speed").alias("speed"))


@query(
    "channel_velocity",
    "WITH w AS (SELECT l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq FROM lineitem) "
    "SELECT cast(l_suppkey AS VARCHAR) AS episode_id, seq, round(abs(coalesce(l_quantity - lag(l_quantity) OVER v, 0)), 4) AS quantity, "
    "round(abs(coalesce(l_extendedprice - lag(l_extendedprice) OVER v, 0)), 4) AS price FROM w WINDOW v AS (PARTITION BY l_suppkey ORDER BY seq)",
)
def channel_velocity(spark, sf):
    """Line items as a channel table: one episode per supplier, one step per line."""
    rows, layout = supplier_steps(spark, sf)
    out = ts.channel_velocity(rows, layout, ["quantity", "price"])
    return out.select("episode_id", "seq", r("quantity__rate", 4).alias("quantity"), r("price__rate", 4).alias("price"))


def supplier_steps(spark, sf):
    from dataclasses import replace

    from trajspark.functions.layout import dense_positions

    lines = read_table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines, layout = dense_positions(lines, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    rows = lines.select(
        F.col("l_suppkey").cast("string").alias("episode_id"), "seq", F.col("seq").cast("double").alias("timestamp"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )
    return rows, replace(layout, keys=("episode_id",))


@query(
    "robust_threshold",
    check("SELECT episode_id, round(l_force, 6) AS force_limit, round(l_joint_1, 6) AS joint_1_limit, round(l_joint_2, 6) AS joint_2_limit FROM limits"),
)
def robust_threshold(spark, sf):
    rows, layout = telemetry(spark, sf)
    rows = ts.channel_velocity(rows, layout, JOINTS)
    values = {c: (F.col(f"{c}__rate"), P.joint_velocity_mad_scale, P.joint_velocity_floor) for c in JOINTS}
    values["force_z"] = (F.abs("force_z"), P.force_mad_scale, P.force_floor)
    out = ts.with_robust_thresholds(rows, layout, values).groupBy("episode_id")
    return out.agg(r(F.max("force_z__limit")).alias("force_limit"), *[r(F.max(f"{c}__limit")).alias(f"{c}_limit") for c in JOINTS])


SEGMENT_COLUMNS = ["episode_id", "kind", "start_seq", "end_seq", "rows", "start_time", "end_time"]


@query("contiguous_segments", check("SELECT episode_id, kind, start_seq, end_seq, rows, start_time, end_time FROM segs"))
def contiguous_segments(spark, sf):
    rows, layout = flagged(spark, sf)
    return detect.kept_segments(detect.row_runs(rows, layout), P).select(*SEGMENT_COLUMNS)


@query("true_runs", check("SELECT episode_id, kind, start_seq, end_seq, rows, start_time, end_time FROM runs"))
def true_runs(spark, sf):
    rows, layout = flagged(spark, sf)
    return detect.row_runs(rows, layout).select(*SEGMENT_COLUMNS)


@query("longest_segment", check("SELECT episode_id, kind, round(max(greatest(0, end_time - start_time)), 6) AS longest FROM runs GROUP BY 1, 2"))
def longest_segment(spark, sf):
    rows, layout = flagged(spark, sf)
    return ts.longest_segment(detect.row_runs(rows, layout), layout).select("episode_id", "kind", r("longest").alias("longest"))


GAP_SQL = {
    c: f"SELECT episode_id, seq, CASE WHEN {c} IS NOT NULL THEN {c} WHEN ns - ps - 1 <= 3 AND nt > pt "
    f"THEN pv + (nv - pv) * greatest(0, least(1, (timestamp - pt) / (nt - pt))) END AS {c}, "
    f"({c} IS NULL AND coalesce(ns - ps - 1 <= 3 AND nt > pt, false)) AS filled, "
    f"({c} IS NULL AND NOT coalesce(ns - ps - 1 <= 3 AND nt > pt, false)) AS open FROM "
    f"(SELECT *, last_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS ps, last_value({c} IGNORE NULLS) OVER b AS pv, "
    f"last_value(CASE WHEN {c} IS NOT NULL THEN timestamp END IGNORE NULLS) OVER b AS pt, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS ns, first_value({c} IGNORE NULLS) OVER a AS nv, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN timestamp END IGNORE NULLS) OVER a AS nt FROM tele "
    f"WINDOW b AS ({EP} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({EP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    for c in JOINTS
}


@query(
    "short_gap_interpolate",
    statement(
        PARTS | {f"gap_{c}": sql for c, sql in GAP_SQL.items()},
        "SELECT episode_id, seq, round(a.joint_1, 8) AS joint_1, a.filled AS joint_1_filled, a.open AS joint_1_open, "
        "round(b.joint_2, 8) AS joint_2, b.filled AS joint_2_filled, b.open AS joint_2_open FROM gap_joint_1 a JOIN gap_joint_2 b USING (episode_id, seq)",
    ),
)
def short_gap_interpolate(spark, sf):
    rows, layout = telemetry(spark, sf)
    out = ts.short_gap_interpolate(rows, layout, JOINTS)
    picked = [x for c in JOINTS for x in (r(c, 8).alias(c), F.col(f"{c}__filled").alias(f"{c}_filled"), F.col(f"{c}__open").alias(f"{c}_open"))]
    return out.select("episode_id", "seq", *picked)


SPIKE_SQL = (
    "SELECT episode_id, seq, f_joint_1 AS old, f0 + CASE WHEN t2 > t0 THEN (timestamp - t0) / (t2 - t0) ELSE 0.5 END * (f2 - f0) AS new FROM ("
    "SELECT *, (f_joint_1 - f0) / safe_dt AS came, (f2 - f_joint_1) / CASE WHEN t2 > timestamp THEN t2 - timestamp ELSE median_dt END AS went FROM ("
    f"SELECT flags.*, lag(f_joint_1) OVER w AS f0, lead(f_joint_1) OVER w AS f2, lag(timestamp) OVER w AS t0, lead(timestamp) OVER w AS t2 FROM flags WINDOW w AS ({EP}))) "
    "WHERE f0 IS NOT NULL AND f2 IS NOT NULL AND abs(came) > l_joint_1 AND abs(went) > l_joint_1 AND came * went < 0"
)


@query(
    "isolated_spike_repair",
    statement(PARTS | {"spikes": SPIKE_SQL}, "SELECT episode_id, seq, round(old, 8) AS before, round(new, 8) AS after FROM spikes"),
)
def isolated_spike_repair(spark, sf):
    rows, layout = telemetry(spark, sf)
    rows = ts.interpolate_positional(rows, layout, ["joint_1"]).withColumnRenamed("joint_1__fill", "before")
    rows = ts.with_period(ts.step_interval(rows, layout), layout)
    out = ts.isolated_spike_repair(rows, layout, ["joint_1"], P).filter("joint_1__spike")
    return out.select("episode_id", "seq", r("before", 8).alias("before"), r("joint_1", 8).alias("after"))


@query(
    "time_shift_resample",
    check(
        "SELECT t.episode_id, t.seq, round(CASE WHEN a.timestamp = t.timestamp + 0.15 THEN a.camera_motion WHEN b.timestamp IS NOT NULL AND a.timestamp IS NOT NULL THEN "
        "a.camera_motion + (b.camera_motion - a.camera_motion) * (t.timestamp + 0.15 - a.timestamp) / (b.timestamp - a.timestamp) END, 6) AS camera_motion "
        "FROM (SELECT *, timestamp + 0.15 AS target FROM tele) t "
        "ASOF LEFT JOIN (SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY episode_id, timestamp ORDER BY seq DESC) = 1) a ON t.episode_id = a.episode_id AND t.target >= a.timestamp "
        "ASOF LEFT JOIN (SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY episode_id, timestamp ORDER BY seq) = 1) b ON t.episode_id = b.episode_id AND t.target <= b.timestamp"
    ),
)
def time_shift_resample(spark, sf):
    rows, layout = telemetry(spark, sf)
    rows = ts.with_period(ts.step_interval(rows.select("episode_id", "seq", "timestamp", "camera_motion"), layout), layout)
    out = ts.sample_at(rows, layout, "camera_motion", F.lit(0.15))
    return out.select("episode_id", "seq", r("camera_motion__shifted").alias("camera_motion"))


@query(
    "segment_id",
    statement(PARTS, f"SELECT episode_id, seq, cast(sum(CASE WHEN backwards OR gap THEN 1 ELSE 0 END) OVER ({EP}) AS INT) AS segment_id FROM flags"),
)
def segment_id(spark, sf):
    rows, layout = telemetry(spark, sf)
    rows = ts.with_period(ts.step_interval(rows, layout), layout)
    return ts.segment_ids(rows, layout, P).select("episode_id", "seq", "segment_id")


@query(
    "dilate_mask",
    check(f"SELECT episode_id, seq, max(spike) OVER ({EP} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_spike FROM flags"),
)
def dilate_mask(spark, sf):
    rows, layout = flagged(spark, sf)
    return ts.dilate(rows, layout, "spike").select("episode_id", "seq", F.col("spike__wide").alias("near_spike"))


@query("sync_offset", check("SELECT episode_id, cast(lag AS INT) AS lag, round(lag * median_dt, 6) AS offset_s, round(confidence, 6) AS confidence FROM sync JOIN per USING (episode_id)"))
def sync_offset(spark, sf):
    rows, layout = telemetry(spark, sf)
    speed = ts.with_speed(rows, layout, steps.resolve_roles(rows))
    found = ts.sync_offset(speed, layout, "speed", "camera_motion", P.sync_max_lag_seconds)
    period = speed.groupBy("episode_id").agg(F.max("median_dt").alias("median_dt"))
    return found.join(period, "episode_id").select(
        "episode_id", F.col("lag").cast("int").alias("lag"), r(F.col("lag") * F.col("median_dt")).alias("offset_s"), r("confidence").alias("confidence")
    )


@query("downsample", check("SELECT episode_id, seq, cast(ceil(n / 20) AS BIGINT) AS downsample_step, round(force_z, 5) AS force_z FROM st WHERE seq % cast(ceil(n / 20) AS BIGINT) = 0"))
def downsample(spark, sf):
    rows, layout = telemetry(spark, sf)
    return ts.downsample(rows, layout, 20).select("episode_id", "seq", "downsample_step", r("force_z", 5).alias("force_z"))


# ---- detectors ------------------------------------------------------------------------------------


def issue_query(name: str, code: str) -> None:
    sql = check(f"SELECT episode_id, severity, count, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM issues WHERE code = '{code}'")

    @query(name, sql)
    def run(spark, sf):
        found = detect.issue_rows(diagnosed(spark, sf)).filter(F.col("code") == code)
        return found.select("episode_id", "severity", "count", r("start_time").alias("start_time"), r("end_time").alias("end_time"))


for _code in detect.ISSUE_RULE:
    issue_query(f"detect_{_code.lower()}", _code)


BASELINE_SQL = (
    "SELECT episode_id, [x FOR x IN ["
    "CASE WHEN max(dt) > greatest(0.1, any_value(median_dt) * 4) THEN 'TIMESTAMP_GAP' END, CASE WHEN bool_or(dropped) THEN 'FRAME_DROP' END, "
    "CASE WHEN greatest(max(v_joint_1), max(v_joint_2)) > 8 THEN 'JOINT_JUMP' END, CASE WHEN max(abs(force_z)) > 50 THEN 'FORCE_SPIKE' END, "
    "CASE WHEN any_value(still) >= 1.5 THEN 'ROBOT_STUCK' END, CASE WHEN abs(any_value(sync_offset)) >= 0.15 AND any_value(confidence) >= 0.35 THEN 'SENSOR_DESYNC' END, "
    "CASE WHEN count(*) FILTER (WHERE slip) >= 6 THEN 'GRASP_SLIP' END] IF x IS NOT NULL] AS codes "
    "FROM flags JOIN (SELECT episode_id, sync_offset, confidence FROM figs) USING (episode_id) LEFT JOIN "
    "(SELECT episode_id, max(greatest(0, end_time - start_time)) AS still FROM still_runs GROUP BY 1) USING (episode_id) GROUP BY 1"
)


@query(
    "fixed_threshold_baseline",
    statement(PARTS | {"still_runs": runs_sql("flags", "speed < 0.003"), "base": BASELINE_SQL}, "SELECT episode_id, array_to_string(list_sort(codes), ';') AS codes FROM base"),
)
def fixed_threshold_baseline(spark, sf):
    return detect.fixed_threshold_codes(inspected(spark, sf)).select("episode_id", F.concat_ws(";", "codes").alias("codes"))


EVENTS_SQL = (
    "SELECT episode_id, start_time AS time, end_time, 'frame-drop' AS type, 'Frames dropped' AS label FROM segs WHERE kind = 'drop' UNION ALL "
    "SELECT episode_id, drop_start, drop_end, 'frame-drop', 'Frames dropped' FROM figs WHERE drop_rows > 0 AND drop_segments = 0 UNION ALL "
    "SELECT episode_id, timestamp - dt, NULL, 'gap', 'Sampling gap' FROM flags WHERE gap UNION ALL "
    "SELECT episode_id, start_time, end_time, 'stuck', 'No motion' FROM segs WHERE kind = 'stuck' UNION ALL "
    "SELECT episode_id, mismatch_segment_start, mismatch_segment_end, 'gripper-response', 'Close command ignored' FROM figs WHERE mismatch_segments > 0 UNION ALL "
    "SELECT episode_id, evidence_start, evidence_end, 'slip', 'Object slipped' FROM figs WHERE slipped UNION ALL "
    f"SELECT episode_id, timestamp, NULL, 'jump', 'Joint jump' FROM (SELECT * FROM flags WHERE jump QUALIFY row_number() OVER ({EP}) <= 30) UNION ALL "
    f"SELECT episode_id, timestamp, NULL, 'collision', 'Contact force peak' FROM (SELECT * FROM flags WHERE spike QUALIFY row_number() OVER ({EP}) <= 30) UNION ALL "
    "SELECT flags.episode_id, timestamp, NULL, 'sync', 'Camera offset ' || cast(round_even(sync_offset * 1000, 0) AS BIGINT) || ' ms' FROM flags JOIN figs USING (episode_id) WHERE desynced AND seq = cast(floor(n / 2) AS BIGINT)"
)


@query("event_timeline", statement(PARTS | {"ev": EVENTS_SQL}, "SELECT episode_id, type, label, round(time, 6) AS time, round(end_time, 6) AS end_time FROM ev"))
def event_timeline(spark, sf):
    out = detect.event_rows(inspected(spark, sf)).select("episode_id", "type", "label", r("time").alias("time"), r("end_time").alias("end_time"))
    return out.orderBy("episode_id", "time")


@query(
    "first_events_per_type",
    check(f"SELECT episode_id, seq, round(timestamp, 6) AS time FROM (SELECT * FROM flags WHERE spike QUALIFY row_number() OVER ({EP}) <= 3)"),
)
def first_events_per_type(spark, sf):
    d = inspected(spark, sf)
    w = Window.partitionBy("episode_id").orderBy("seq")
    first = d.rows.filter("spike").withColumn("_n", F.row_number().over(w)).filter("_n <= 3")
    return first.select("episode_id", "seq", r("timestamp").alias("time"))


@query(
    "top_missing_channels",
    check(
        "SELECT episode_id, channel, missing, cast(row_number() OVER (PARTITION BY episode_id ORDER BY missing DESC, channel) AS INT) AS place FROM ("
        "SELECT episode_id, 'joint_1' AS channel, count(*) FILTER (WHERE joint_1 IS NULL) AS missing FROM tele GROUP BY 1 UNION ALL "
        "SELECT episode_id, 'joint_2', count(*) FILTER (WHERE joint_2 IS NULL) FROM tele GROUP BY 1) WHERE missing > 0 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY missing DESC, channel) <= 4"
    ),
)
def top_missing_channels(spark, sf):
    return detect.missing_channels(inspected(spark, sf)).select("episode_id", "channel", "missing", "place")


# ---- scores ---------------------------------------------------------------------------------------


@query("dimension_scores", check("SELECT episode_id, completeness, temporal, motion, sync, safety FROM figs"))
def dimension_scores(spark, sf):
    return diagnosed(spark, sf).select("episode_id", *score.DIMENSIONS)


@query("quality_score", check("SELECT episode_id, quality_score, grade, cast(critical_count AS INT) AS critical_count FROM eps"))
def quality_score(spark, sf):
    return diagnosed(spark, sf).select("episode_id", "quality_score", "grade", "critical_count")


@query("root_causes", check("SELECT episode_id, causes_list AS causes FROM eps"))
def root_causes(spark, sf):
    labels = F.transform("root_causes", lambda c: c["label"])
    return diagnosed(spark, sf).select("episode_id", F.array_join(labels, ";").alias("causes"))


@query("episode_outcome", "SELECT cast(o_custkey AS VARCHAR) AS episode_id, arg_max(o_orderstatus, o_orderkey) = 'F' AS success, count(*) AS rows FROM orders GROUP BY 1")
def episode_outcome(spark, sf):
    """Outcome of the last order of each customer."""
    orders = read_table(spark, sf, "orders")
    last = F.max(F.struct("o_orderkey", "o_orderstatus"))["o_orderstatus"]
    from trajspark.functions.columns import truthy

    return orders.groupBy(F.col("o_custkey").cast("string").alias("episode_id")).agg(
        truthy(F.when(last == "F", "success").otherwise("no")).alias("success"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "episode_metrics",
    check(
        "SELECT episode_id, rows, duration, sample_rate, round_even(missing_rate * 100, 3) AS missing_pct, gap_rows AS timestamp_gaps, round_even(jitter * 100, 2) AS jitter_pct, "
        "round_even(sync_offset * 1000, 1) AS sync_offset_ms, round_even(confidence, 3) AS sync_confidence, jump_rows AS joint_jumps, stuck_segments, spike_rows AS force_spikes, drop_rows AS frame_drops FROM eps"
    ),
)
def episode_metrics(spark, sf):
    return score.episode_metrics(diagnosed(spark, sf))


OVERVIEW_SQL = (
    "SELECT count(*) AS episode_count, cast(sum(rows) AS BIGINT) AS row_count, round_even(avg(quality_score), 1) AS average_score, round_even(avg(success::INT) * 100, 1) AS success_rate, "
    "count(*) AS success_labeled_count, count(*) FILTER (WHERE critical_count > 0) AS critical_episodes, "
    "count(*) FILTER (WHERE critical_count = 0 AND quality_score >= 78) AS training_ready_episodes FROM eps"
)


@query("dataset_overview", check(OVERVIEW_SQL))
def dataset_overview(spark, sf):
    return score.dataset_overview(diagnosed(spark, sf))


@query("grade_distribution", check("SELECT g AS grade, count(episode_id) AS episode_count FROM (VALUES ('A'), ('B'), ('C'), ('D')) v(g) LEFT JOIN eps ON grade = g GROUP BY 1"))
def grade_distribution(spark, sf):
    return score.grade_distribution(diagnosed(spark, sf))


@query(
    "score_histogram",
    check(
        "SELECT b AS bin, count(episode_id) AS episode_count FROM (VALUES ('90-100'), ('78-89'), ('65-77'), ('0-64')) v(b) LEFT JOIN "
        "(SELECT episode_id, CASE WHEN quality_score >= 90 THEN '90-100' WHEN quality_score >= 78 THEN '78-89' WHEN quality_score >= 65 THEN '65-77' ELSE '0-64' END AS bin FROM eps) ON bin = b GROUP BY 1"
    ),
)
def score_histogram(spark, sf):
    return score.score_histogram(diagnosed(spark, sf))


@query(
    "issue_code_counts",
    check(
        "SELECT code, episode_count, sample_count, severity, category, title FROM (SELECT code, count(*) AS episode_count, cast(sum(count) AS BIGINT) AS sample_count, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity FROM issues GROUP BY 1) "
        "JOIN (VALUES ('MISSING_VALUES', 'completeness', 'Missing sensor values'), ('FRAME_DROP', 'completeness', 'Dropped video frames'), ('NON_MONOTONIC_TIME', 'timing', 'Time does not increase'), "
        "('TIMESTAMP_GAP', 'timing', 'Gaps in the sample stream'), ('JOINT_JUMP', 'motion', 'Sudden joint jump'), ('ROBOT_STUCK', 'task', 'No useful motion for a long time'), "
        "('SENSOR_DESYNC', 'synchronisation', 'Camera and robot out of step'), ('FORCE_SPIKE', 'safety', 'Abnormal contact force'), ('GRIPPER_RESPONSE_FAILURE', 'control', 'Close command not carried out'), "
        "('GRASP_SLIP', 'task', 'Object probably slipped'), ('WORKSPACE_OUTLIER', 'safety', 'Pose outside the workspace')) t(code, category, title) USING (code)"
    ),
)
def issue_code_counts(spark, sf):
    return score.issue_code_counts(diagnosed(spark, sf))


@query("average_dimensions", check("SELECT " + ", ".join(f"round_even(avg({d}), 1) AS {d}" for d in score.DIMENSIONS) + " FROM figs"))
def average_dimensions(spark, sf):
    return score.average_dimensions(diagnosed(spark, sf))


@query("issues_by_severity", check("SELECT episode_id, cast(place AS INT) AS place, code, severity, count FROM placed"))
def issues_by_severity(spark, sf):
    return detect.issue_rows(diagnosed(spark, sf)).select("episode_id", "place", "code", "severity", "count")


@query("worst_episodes", check("SELECT episode_id, quality_score, cast(critical_count AS INT) AS critical_count FROM eps ORDER BY quality_score, critical_count DESC, episode_id LIMIT 10"))
def worst_episodes(spark, sf):
    return score.worst_episodes(diagnosed(spark, sf)).select("episode_id", "quality_score", "critical_count")


@query(
    "audit_filter",
    check("SELECT episode_id, quality_score, grade, primary_cause FROM eps WHERE contains(lower(concat_ws(' ', episode_id, primary_cause, replace(issue_codes, ';', ' '))), 'slip') AND grade = 'D' AND contains(concat(';', issue_codes, ';'), ';TIMESTAMP_GAP;')"),
)
def audit_filter(spark, sf):
    out = score.audit_filter(diagnosed(spark, sf), "Slip", "D", "TIMESTAMP_GAP")
    return out.select("episode_id", "quality_score", "grade", "primary_cause")


@query("audit_order", check("SELECT episode_id, quality_score, cast(row_number() OVER (ORDER BY cast(regexp_extract(episode_id, '(\\d+)', 1) AS BIGINT)) AS BIGINT) AS place FROM eps"))
def audit_order(spark, sf):
    """As audit_order, with the scores of the whole diagnosis."""
    ordered = score.audit_order(diagnosed(spark, sf), "episode-asc").select("episode_id", "quality_score")
    return numbered(ordered)


def numbered(ordered: DataFrame) -> DataFrame:
    """Number globally sorted rows through per-partition counts, so no task sees all of them."""
    import pandas as pd

    def number(batches):
        n = 0
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in b.columns}, "_row": range(n, n + len(b))})
            n += len(b)

    from trajspark.functions.lineage import materialise

    schema = ", ".join(f"{n} {t}" for n, t in ordered.dtypes)
    parts = materialise(ordered.withColumn("_part", F.spark_partition_id()))
    rows = parts.mapInPandas(number, f"{schema}, _part int, _row long")
    sizes = parts.groupBy("_part").count()
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    # One row per partition of the sort.
    return rows.join(F.broadcast(offsets), "_part").select(
        *ordered.columns, (F.col("_row") + F.col("_offset") + 1).alias("place")
    )


@query("channels_by_number", check("SELECT episode_id, channel, cast(split_part(channel, '_', 2) AS INT) AS number, count(value) AS known FROM (UNPIVOT (SELECT episode_id, joint_1, joint_2 FROM tele) ON joint_1, joint_2 INTO NAME channel VALUE value) GROUP BY 1, 2"))
def channels_by_number(spark, sf):
    rows, _ = telemetry(spark, sf)
    chans = steps.by_suffix([c for c in rows.columns if c.startswith("joint_")])
    long = steps.long_signals(rows, chans).groupBy("episode_id", "channel").agg(F.count("value").alias("known"))
    return long.withColumn("number", F.split_part("channel", F.lit("_"), F.lit(2)).cast("int")).orderBy("episode_id", "number")
