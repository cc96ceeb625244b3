"""Queries: fault injection over all episodes, and the detection and repair benchmarks on it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from trajspark.functions.layout import dense_positions
from trajspark.operators import evaluation as ev
from trajspark.operators import perturb as pt
from trajspark.plans.diagnosis_queries import P, r
from trajspark.plans.oracle import EP, diagnosis_parts, runs_sql, statement
from trajspark.plans.registry import query
from trajspark.plans.repair_queries import REPAIR_PARTS
from trajspark.plans.telemetry import TELEMETRY_SQL, read_table, telemetry
from trajspark.profiles import resolve_profile
from trajspark.sources import tables as tb

PERIOD = 0.05
GENERIC = resolve_profile()
REQUIRED = ("timestamp", "camera_motion", "force_z", "gripper", "object_distance", "ee_x", "ee_y")
HOLDING = "phase IN ('grasp', 'transport')"
BASE = {
    "base_no": "cast(substring(episode_id, 4) AS BIGINT)",
    "seq": "seq",
    "timestamp": "seq / 20e0",
    "phase": "phase",
    "joint_1": "seq / 50e0 + camera_motion / 1000",
    "joint_2": "-seq / 80e0",
    "ee_x": "travel / 200",
    "ee_y": "0.1e0",
    "camera_motion": "camera_motion",
    "force_z": "5e0",
    "gripper": f"CASE WHEN {HOLDING} THEN 0.18e0 ELSE 0.92e0 END",
    "gripper_command": f"CASE WHEN {HOLDING} THEN -1 ELSE 1 END",
    "object_distance": f"CASE WHEN {HOLDING} THEN 0.025e0 ELSE 0.14e0 END",
    "is_grasped": HOLDING,
}


def bases(spark, sf):
    """A clean version of every telemetry episode."""
    rows, layout = telemetry(spark, sf)
    rows = layout.running(rows.select("episode_id", "seq", "phase", "camera_motion"), {"travel": F.col("camera_motion")})
    base = rows.selectExpr("episode_id AS base_id", *[f"{e} AS {c}" for c, e in BASE.items()])
    return pt.select_base(base, REQUIRED), replace(layout, keys=("base_id",))


def samples(spark, sf, faults, seeds, noise=True, only: str | None = None):
    base, layout = bases(spark, sf)
    rows = pt.grid_samples(base, pt.Grid(faults, seeds, PERIOD), layout)
    if only:
        rows = rows.filter(F.col("fault") == only)
    # Joins on the keys of samples, too, may leave the samples with their base.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    of_samples = replace(layout, keys=pt.SAMPLE_KEYS)
    clean = pt.add_noise(rows) if noise else rows
    return pt.inject(clean, of_samples), of_samples, clean


# ---- the same samples in SQL ----------------------------------------------------------------------


# Written by hand from the description of the faults, so that a slip in operators/perturb.py shows. Periods are 0.05 s.
# fault number, fault, then (level, value, lag in rows, width in rows)
DETECTION_GRID = (
    (1, "sensor-delay", (("mild", 0.10, 2, 1), ("medium", 0.16, 3, 1), ("severe", 0.24, 5, 1))),
    (2, "force-spike", (("mild", 42.0, 0, 4), ("medium", 55.0, 0, 4), ("severe", 75.0, 0, 4))),
    (3, "joint-jump", (("mild", 0.09, 0, 1), ("medium", 0.18, 0, 1), ("severe", 0.35, 0, 1))),
    (4, "timestamp-gap", (("mild", 0.08, 0, 1), ("medium", 0.16, 0, 1), ("severe", 0.28, 0, 1))),
    (5, "frame-drop", (("mild", 4.0, 0, 4), ("medium", 7.0, 0, 7), ("severe", 12.0, 0, 12))),
    (6, "robot-stuck", (("mild", 1.4, 0, 28), ("medium", 2.0, 0, 40), ("severe", 2.8, 0, 56))),
    (7, "grasp-slip", (("mild", 0.13, 0, 4), ("medium", 0.18, 0, 4), ("severe", 0.24, 0, 4))),
)
REPAIR_GRID = (
    (1, "short-gap", (("mild", 1.0, 0, 1), ("medium", 2.0, 0, 2), ("severe", 3.0, 0, 3))),
    (2, "joint-spike", (("mild", 0.09, 0, 1), ("medium", 0.18, 0, 1), ("severe", 0.35, 0, 1))),
    (3, "sensor-delay", (("mild", 0.10, 2, 1), ("medium", 0.16, 3, 1), ("severe", 0.24, 5, 1))),
    (4, "timestamp-gap", (("mild", 0.08, 0, 1), ("medium", 0.16, 0, 1), ("severe", 0.28, 0, 1))),
    (5, "force-spike", (("mild", 42.0, 0, 4), ("medium", 55.0, 0, 4), ("severe", 75.0, 0, 4))),
)
NOISE_SQL = {"camera_motion": (1, "4e-4"), "ee_x": (2, "5e-5"), "force_z": (3, "8e-2"), "joint_1": (4, "3.5e-4"), "joint_2": (5, "3.5e-4")}
STALLED_SQL = ("joint_1", "joint_2", "ee_x")
DURING = "(seq BETWEEN place AND place + width - 1)"


def noise_sql(channel: str, shown: str | None = None) -> str:
    """Standard normal number from two steps of a multiplicative congruential sequence, times the channel's deviation."""
    number, deviation = NOISE_SQL[channel]
    one = f"(48271 * (12345 + 1299709 * {number} + 104729 * pick + 7919 * (seq % 1000003)) % 2147483647)"
    two = f"({one} * 69621 % 2147483647)"
    return f"{shown or channel} + {deviation}::DOUBLE * (sqrt(-2e0 * ln(({one} + 1) / 2147483648e0)) * cos(2 * pi() * ({two} / 2147483647e0)))"


def stalled_sql(channel: str) -> str:
    return (
        f"CASE WHEN fault <> 'robot-stuck' OR seq < place THEN {channel} WHEN seq < place + width THEN held_{channel} "
        f"ELSE {channel} + held_{channel} - after_{channel} END"
    )


def joint_sql(channel: str, number: int) -> str:
    hit = f"{DURING} AND (pick // 2) % 2 = {number}"
    return (
        f"CASE WHEN fault = 'short-gap' AND {hit} THEN NULL WHEN fault[:6] = 'joint-' AND {hit} THEN {channel} + value * (CASE pick % 2 WHEN 0 THEN 1 ELSE -1 END) "
        f"ELSE {stalled_sql(channel)} END"
    )


INJECTED_SQL = {
    "joint_1": joint_sql("joint_1", 0),
    "joint_2": joint_sql("joint_2", 1),
    "ee_x": stalled_sql("ee_x"),
    "camera_motion": f"CASE fault WHEN 'sensor-delay' THEN cam_delayed WHEN 'frame-drop' THEN (CASE WHEN NOT {DURING} THEN camera_motion END) ELSE camera_motion END",
    "force_z": f"CASE WHEN fault = 'force-spike' AND {DURING} THEN value * (1 + 8e-2 * sin(pi() * (seq - place) / greatest(1, width - 1))) ELSE force_z END",
    "timestamp": "timestamp + (CASE WHEN fault = 'timestamp-gap' AND seq >= place + 1 THEN value ELSE 0 END)",
    "frame_valid": f"CASE WHEN fault = 'frame-drop' AND {DURING} THEN 0 ELSE 1 END",
    "gripper": f"CASE WHEN fault = 'grasp-slip' AND {DURING} THEN 18e-2 ELSE gripper END",
    "object_distance": "CASE WHEN fault <> 'grasp-slip' OR seq < place THEN object_distance WHEN seq >= place + width THEN value "
    "ELSE 105e-3 + (value - 105e-3) * (seq - place) / greatest(1, width - 1) END",
    "phase": f"CASE WHEN fault = 'robot-stuck' AND {DURING} THEN 'transport' ELSE phase END",
    "success": "fault = 'nominal'",
}


def sample_parts(faults, seeds: int) -> dict[str, str]:
    grid = DETECTION_GRID if faults is pt.DETECTION_FAULTS else REPAIR_GRID
    cells = [(0, "nominal", (("none", 0.0, 0, 0),)), *grid]
    values = ", ".join(f"({s}, {no}, '{f}', '{lv}', {v}::DOUBLE, {lag}, {w})" for s in range(seeds) for no, f, levels in cells for lv, v, lag, w in levels)
    lags = ", ".join(f"lag(camera_motion, {k}) OVER w AS cam_lag_{k}" for k in (2, 3, 5))
    delayed = "CASE lag_rows " + " ".join(f"WHEN {k} THEN coalesce(cam_lag_{k}, cam_first)" for k in (2, 3, 5)) + " ELSE camera_motion END"
    held = ", ".join(
        f"max(CASE WHEN seq = place THEN {c} END) OVER (PARTITION BY episode_id) AS held_{c}, max(CASE WHEN seq = place + width THEN {c} END) OVER (PARTITION BY episode_id) AS after_{c}"
        for c in STALLED_SQL
    )
    pick = "(15485863 * floor(value * 1000)::BIGINT + 1299709 * fault_no + 104729 * seed + 7919 * base_no) % 1000003"
    first = "greatest(20, floor(n * 42e-2)::BIGINT)"
    place = f"{first} + pick % greatest(1, floor(n * 72e-2)::BIGINT - {first} - width)"
    noisy = ", ".join(f"{noise_sql(c)} AS {c}" for c in NOISE_SQL)
    keep = "episode_id, seq, ee_y, gripper_command, is_grasped"
    return {
        "telemetry_rows": TELEMETRY_SQL,
        "base0": f"SELECT episode_id, seq, phase, camera_motion, sum(camera_motion) OVER ({EP}) AS travel FROM telemetry_rows",
        "base1": "SELECT episode_id AS base_id, 1 AS frame_valid, " + ", ".join(f"{e} AS {c}" for c, e in BASE.items()) + " FROM base0",
        "base2": f"SELECT *, count(*) OVER (PARTITION BY base_id) AS n, first_value(camera_motion) OVER w AS cam_first, {lags} FROM base1 WINDOW w AS (PARTITION BY base_id ORDER BY seq)",
        "drawn": f"SELECT *, {pick} AS pick FROM base2, (VALUES {values}) g(seed, fault_no, fault, level, value, lag_rows, width)",
        "placed_samples": f"SELECT *, concat_ws('/', base_id, seed, fault, level) AS episode_id, pick // 2 % 2 AS pick_joint, {place} AS place, {delayed} AS cam_delayed FROM drawn",
        "noisy_samples": f"SELECT * REPLACE ({noisy}, {noise_sql('camera_motion', 'cam_delayed')} AS cam_delayed) FROM placed_samples",
        "held_samples": f"SELECT *, {held} FROM noisy_samples",
        "sample_rows": f"SELECT fault, level, value, place, width, pick_joint, {keep}, " + ", ".join(f"{e} AS {c}" for c, e in INJECTED_SQL.items()) + " FROM held_samples",
        "tele": "SELECT * EXCLUDE (fault, level, value, place, width, pick_joint) FROM sample_rows",
        "meta": "SELECT episode_id, any_value(fault) AS fault, any_value(level) AS level, any_value(value) AS value FROM sample_rows GROUP BY 1",
    }


def _diagnosis(profile):
    parts = diagnosis_parts(profile)
    return {k: v for k, v in parts.items() if k != "tele"}


ONE = sample_parts(pt.DETECTION_FAULTS, 1)
SHORT = sample_parts(pt.REPAIR_FAULTS, 1)


def injection_query(name: str, fault: str, columns: list[str], faults=pt.DETECTION_FAULTS) -> None:
    source = ONE if faults is pt.DETECTION_FAULTS else SHORT
    shown = ", ".join(f"{c}" if c in ("frame_valid", "phase") else f"round({c}, 7) AS {c}" for c in columns)

    @query(name, statement(source, f"SELECT episode_id, seq, {shown} FROM sample_rows WHERE fault = '{fault}'"))
    def run(spark, sf):
        rows, _, _ = samples(spark, sf, faults, 1, only=fault)
        return rows.select("episode_id", "seq", *[F.col(c) if c in ("frame_valid", "phase") else r(c, 7).alias(c) for c in columns])


injection_query("inject_delay", "sensor-delay", ["camera_motion"])
injection_query("inject_force_spike", "force-spike", ["force_z"])
injection_query("inject_joint_jump", "joint-jump", ["joint_1", "joint_2"])
injection_query("inject_time_gap", "timestamp-gap", ["timestamp"])
injection_query("inject_frame_drop", "frame-drop", ["frame_valid", "camera_motion"])
injection_query("inject_stuck", "robot-stuck", ["ee_x", "joint_1", "joint_2", "phase"])
injection_query("inject_slip", "grasp-slip", ["gripper", "object_distance"])
injection_query("inject_missing", "short-gap", ["joint_1", "joint_2"], pt.REPAIR_FAULTS)


@query("select_base", statement(ONE, "SELECT base_id, seq, round(joint_1, 6) AS joint_1, round(ee_x, 6) AS ee_x, frame_valid, true AS success FROM base1"))
def select_base(spark, sf):
    base, _ = bases(spark, sf)
    return base.select("base_id", "seq", r("joint_1").alias("joint_1"), r("ee_x").alias("ee_x"), "frame_valid", "success")


@query("add_noise", statement(ONE, "SELECT episode_id, seq, " + ", ".join(f"round({c}, 8) AS {c}" for c in pt.NOISE) + " FROM noisy_samples WHERE fault = 'nominal'"))
def add_noise(spark, sf):
    _, _, clean = samples(spark, sf, pt.DETECTION_FAULTS, 1, only="nominal")
    return clean.select("episode_id", "seq", *[r(c, 8).alias(c) for c in pt.NOISE])


@query("grid_cross_join", statement(ONE, "SELECT fault, level, count(DISTINCT episode_id) AS samples, count(*) AS rows, cast(sum(place) AS BIGINT) AS place_sum FROM placed_samples GROUP BY 1, 2"))
def grid_cross_join(spark, sf):
    base, layout = bases(spark, sf)
    rows = pt.grid_samples(base, pt.Grid(pt.DETECTION_FAULTS, 1, PERIOD), layout)
    per_sample = rows.groupBy("episode_id", "fault", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("p"))
    return per_sample.groupBy("fault", "level").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("rows"), F.sum("p").alias("place_sum"))


VISUAL = (
    "SELECT label AS topic, vec_id, CASE WHEN seq BETWEEN 10 AND 15 THEN 0 ELSE 1 END AS frame_valid, round(list_sum(CASE WHEN seq BETWEEN 10 AND 15 THEN good ELSE pixels END), 5) AS brightness FROM "
    "(SELECT *, max(CASE WHEN seq = 9 THEN pixels END) OVER (PARTITION BY label) AS good FROM (SELECT label, vec_id, [x::DOUBLE FOR x IN embedding] AS pixels, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq FROM embeddings))"
)


@query("inject_visual_fault", VISUAL)
def inject_visual_fault(spark, sf):
    """Frame drop on the frames of every topic."""
    frames = read_table(spark, sf, "embeddings").selectExpr("label AS topic", "vec_id", "transform(embedding, x -> cast(x AS DOUBLE)) AS pixels")
    frames, layout = dense_positions(frames, "topic", ["vec_id"])
    out = pt.inject_visual_fault(frames, layout, "frame-drop", 10, 6)
    return out.select("topic", "vec_id", "frame_valid", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 5).alias("brightness"))


# ---- detection benchmark --------------------------------------------------------------------------

CODE = "CASE fault " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c, _ in pt.DETECTION_FAULTS) + " END"
BASELINE = (
    "SELECT episode_id, [x FOR x IN ["
    "CASE WHEN max(dt) > greatest(0.1, any_value(median_dt) * 4) THEN 'TIMESTAMP_GAP' END, CASE WHEN bool_or(dropped) THEN 'FRAME_DROP' END, "
    "CASE WHEN greatest(max(v_joint_1), max(v_joint_2)) > 8 THEN 'JOINT_JUMP' END, CASE WHEN max(abs(force_z)) > 50 THEN 'FORCE_SPIKE' END, "
    "CASE WHEN any_value(still) >= 1.5 THEN 'ROBOT_STUCK' END, CASE WHEN abs(any_value(sync_offset)) >= 0.15 AND any_value(confidence) >= 0.35 THEN 'SENSOR_DESYNC' END, "
    "CASE WHEN count(*) FILTER (WHERE slip) >= 6 THEN 'GRASP_SLIP' END] IF x IS NOT NULL] AS codes "
    "FROM flags JOIN (SELECT episode_id, sync_offset, confidence FROM figs) USING (episode_id) LEFT JOIN "
    "(SELECT episode_id, max(greatest(0, end_time - start_time)) AS still FROM still_runs GROUP BY 1) USING (episode_id) GROUP BY 1"
)
DETECT = sample_parts(pt.DETECTION_FAULTS, 2) | _diagnosis(GENERIC) | {
    "still_runs": runs_sql("flags", "speed < 0.003"),
    "baseline_rules": BASELINE,
    "true_place": "SELECT episode_id, min(timestamp) AS true_start FROM sample_rows WHERE seq = CASE WHEN fault = 'sensor-delay' THEN cast(round(value / 0.05) AS BIGINT) ELSE place END GROUP BY 1",
    "recs": f"SELECT meta.*, {CODE} AS expected, string_split(issue_codes, ';') AS predicted, codes AS baseline_codes, sync_offset, true_start FROM meta JOIN eps USING (episode_id) JOIN baseline_rules USING (episode_id) LEFT JOIN true_place USING (episode_id)",
}


def check(final: str) -> str:
    return statement(DETECT, final)


def _classes(key: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS code, count(*) FILTER (WHERE coalesce(expected = '{c}', false) AND list_contains({key}, '{c}')) AS tp, count(*) FILTER (WHERE NOT coalesce(expected = '{c}', false) AND list_contains({key}, '{c}')) AS fp, "
        f"count(*) FILTER (WHERE coalesce(expected = '{c}', false) AND NOT list_contains({key}, '{c}')) AS fn FROM recs"
        for c in ev.TARGETS
    )
    return (
        "SELECT code, tp, fp, fn, tp + fn AS support, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM "
        f"(SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM ({rows}))"
    )


def _detections(spark, sf):
    rows, layout, _ = samples(spark, sf, pt.DETECTION_FAULTS, 2)
    return ev.detection_records(rows, layout, GENERIC)


@query("detection_metrics", check(_classes("predicted")))
def detection_metrics(spark, sf):
    """Two seeds, seven faults at three levels, and clean samples, over every episode."""
    return ev.detection_metrics(_detections(spark, sf), "expected", "predicted")


TARGET_LIST = "[" + ", ".join(f"'{c}'" for c in ev.TARGETS) + "]"


def _summary(key: str) -> str:
    return (
        f"SELECT round_even(avg(precision), 4) AS macro_precision, round_even(avg(recall), 4) AS macro_recall, round_even(avg(f1), 4) AS macro_f1, any_value(exact_match) AS exact_match, any_value(nf) AS nominal_false_positive_rate FROM ({_classes(key)}), "
        f"(SELECT round_even(avg((list_sort([x FOR x IN {key} IF list_contains({TARGET_LIST}, x)]) = CASE WHEN expected IS NULL THEN [] ELSE [expected] END)::INT), 4) AS exact_match, "
        f"coalesce(round_even(avg((len([x FOR x IN {key} IF list_contains({TARGET_LIST}, x)]) > 0)::INT) FILTER (WHERE expected IS NULL), 4), 0) AS nf FROM recs)"
    )


@query("detection_summary", check(_summary("predicted")))
def detection_summary(spark, sf):
    from trajspark.functions.lineage import materialise

    return ev.detection_summary(materialise(_detections(spark, sf)), "expected", "predicted")


MEASURES = ("macro_precision", "macro_recall", "macro_f1", "exact_match", "nominal_false_positive_rate")


@query(
    "detection_comparison",
    check(
        f"SELECT *, round_even(macro_f1 - baseline_macro_f1, 4) AS macro_f1_delta, round_even(macro_recall - baseline_macro_recall, 4) AS recall_delta, round_even(nominal_false_positive_rate - baseline_nominal_false_positive_rate, 4) AS false_positive_delta "
        f"FROM ({_summary('predicted')}), (SELECT {', '.join(f'{m} AS baseline_{m}' for m in MEASURES)} FROM ({_summary('baseline_codes')}))"
    ),
)
def detection_comparison(spark, sf):
    """The detectors against the fixed rules, over two seeds of every fault."""
    from trajspark.functions.lineage import materialise

    return ev.detection_comparison(materialise(_detections(spark, sf)))


@query(
    "detection_matrix",
    check(
        "SELECT *, round_even(detection_rate - baseline_detection_rate, 4) AS delta FROM (SELECT fault, level, count(*) AS support, round_even(avg(list_contains(predicted, expected)::INT), 4) AS detection_rate, "
        "round_even(avg(list_contains(baseline_codes, expected)::INT), 4) AS baseline_detection_rate FROM recs WHERE expected IS NOT NULL GROUP BY 1, 2)"
    ),
)
def detection_matrix(spark, sf):
    return ev.detection_matrix(_detections(spark, sf))


@query(
    "localization_error",
    check(
        "SELECT round_even(quantile_cont(abs(start_time - true_start) * 1000, 0.5), 2) AS location_median_ms, round_even(avg(CASE WHEN fault = 'sensor-delay' THEN abs(abs(round_even(sync_offset * 1000, 1)) - value * 1000) END), 2) AS sync_mae_ms "
        "FROM recs LEFT JOIN issues ON issues.episode_id = recs.episode_id AND issues.code = expected"
    ),
)
def localization_error(spark, sf):
    from trajspark.functions.lineage import materialise

    return ev.localization_error(materialise(_detections(spark, sf))).drop("set")


@query(
    "class_agreement",
    "WITH r AS (SELECT CASE WHEN quality = 1 THEN 'GOOD' ELSE 'POOR' END AS expected, CASE WHEN n_chars > 600 THEN 'GOOD' ELSE 'POOR' END AS predicted FROM labels JOIN documents USING (doc_id)) "
    "SELECT code, tp, fp, fn, tp + fn AS support, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS code, count(*) FILTER (WHERE expected = '{c}' AND predicted = '{c}') AS tp, count(*) FILTER (WHERE expected <> '{c}' AND predicted = '{c}') AS fp, count(*) FILTER (WHERE expected = '{c}' AND predicted <> '{c}') AS fn FROM r"
        for c in ("GOOD", "POOR")
    )
    + ")",
)
def class_agreement(spark, sf):
    """The class metrics on labelled documents: quality label against a length rule."""
    labels = read_table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "GOOD").otherwise("POOR").alias("expected"))
    told = read_table(spark, sf, "documents").select("doc_id", F.array(F.when(F.col("n_chars") > 600, "GOOD").otherwise("POOR")).alias("predicted"))
    return ev.detection_metrics(labels.join(told, "doc_id"), "expected", "predicted", ("GOOD", "POOR"))


# ---- repair benchmark -----------------------------------------------------------------------------

JOINT = "CASE pick_joint WHEN 0 THEN {} ELSE {} END"
INSIDE = "(a.seq >= place AND a.seq < place + width)"
REPAIRED = SHORT | {k: v for k, v in REPAIR_PARTS.items() if k not in SHORT} | {
    "judge": f"SELECT a.episode_id, fault, level, value, {INSIDE} AS inside, quality_valid, segment_id, CASE WHEN fault IN ('short-gap', 'joint-spike') AND {INSIDE} THEN "
    f"{JOINT.format('new_1', 'new_2')} - {JOINT.format('m.joint_1', 'm.joint_2')} WHEN fault = 'sensor-delay' AND quality_valid THEN new_cam - m.camera_motion END AS err, "
    "(NOT (new_1 IS NOT DISTINCT FROM a.old_1 OR coalesce(abs(new_1 - a.old_1) <= 1e-12, false)))::INT + (NOT (new_2 IS NOT DISTINCT FROM a.old_2 OR coalesce(abs(new_2 - a.old_2) <= 1e-12, false)))::INT + "
    "(NOT (new_cam IS NOT DISTINCT FROM a.camera_motion OR coalesce(abs(new_cam - a.camera_motion) <= 1e-12, false)))::INT AS changed "
    "FROM audited a JOIN (SELECT episode_id, seq, fault, level, value, place, width, pick_joint, joint_1, joint_2, camera_motion FROM noisy_samples) m USING (episode_id, seq)",
    "rrec": "SELECT episode_id, any_value(fault) AS fault, any_value(level) AS level, coalesce(sum(err * err), 0) AS squared_error, count(err) AS error_cells, avg((NOT quality_valid)::INT) FILTER (WHERE inside) AS isolated, max(segment_id) + 1 AS segments, "
    "avg(quality_valid::INT) AS retained, sum(changed) AS changed_cells, count(*) * 8 AS signal_cells, count(*) FILTER (WHERE NOT quality_valid) AS quarantined_rows, count(*) AS rows FROM judge GROUP BY 1",
}


def check_repair(final: str) -> str:
    return statement(REPAIRED, final)


def _repairs(spark, sf):
    _, layout, clean = samples(spark, sf, pt.REPAIR_FAULTS, 1)
    rows = pt.inject(ev.with_truth(clean, ["joint_1", "joint_2", "ee_x", "camera_motion", "force_z"]), layout)
    # None of these queries shows the delay that is left.
    return ev.repair_records(ev.run_repair(rows, layout, P), residuals=False)


@query("reconstruction_rmse", check_repair("SELECT fault, round_even(sqrt(sum(squared_error) / sum(error_cells)), 8) AS rmse, cast(sum(error_cells) AS BIGINT) AS error_cells FROM rrec WHERE error_cells > 0 GROUP BY 1"))
def reconstruction_rmse(spark, sf):
    """Corrected cells against the samples before the fault, one seed over every episode."""
    return ev.reconstruction_rmse(_repairs(spark, sf))


@query(
    "isolation_metrics",
    check_repair(
        "SELECT fault, count(*) AS support, round_even(avg(CASE fault WHEN 'force-spike' THEN isolated WHEN 'timestamp-gap' THEN (segments >= 2)::INT END), 4) AS isolation_recall, "
        "CASE WHEN fault IN ('force-spike', 'timestamp-gap') THEN 1.0::DOUBLE END AS preservation_rate, round_even(avg(retained), 4) AS average_retained_rate FROM rrec WHERE fault <> 'nominal' GROUP BY 1"
    ),
)
def isolation_metrics(spark, sf):
    return ev.isolation_metrics(_repairs(spark, sf)).drop("success_rate")


@query(
    "overcorrection_rate",
    check_repair("SELECT round_even(sum(changed_cells) / (sum(rows) * 5), 6) AS nominal_overcorrection_rate, round_even(sum(quarantined_rows) / sum(rows), 6) AS nominal_false_quarantine_rate FROM rrec WHERE fault = 'nominal'"),
)
def overcorrection_rate(spark, sf):
    return ev.overcorrection_rate(_repairs(spark, sf))


@query("quality_gates")
def quality_gates(spark, sf):
    from trajspark.functions.lineage import materialise

    return ev.quality_gates(ev.repair_metrics(materialise(_repairs(spark, sf))))
