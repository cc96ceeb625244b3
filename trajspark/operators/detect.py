"""Fault detectors: one pass over the steps, one row of figures per episode, issues and events from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import TRUE_WORDS, numeric_sql
from trajspark.functions.layout import Layout
from trajspark.operators import timeseries as ts
from trajspark.operators.steps import IDLE_PHASES, Roles, resolve_roles
from trajspark.profiles import Profile, resolve_profile

# Command and opening at which a closing command counts as ignored, and for how long.
CLOSE_COMMAND, STILL_OPEN, MISMATCH_SECONDS = -0.5, 0.65, 0.5
EVENTS_PER_TYPE = 30

# code, category, severity when fixed, title, advice; in rule order.
ISSUE_TYPES = (
    ("MISSING_VALUES", "completeness", None, "Missing sensor values", "Check the recorder; interpolate short gaps, drop or record again long ones."),
    ("FRAME_DROP", "completeness", "critical", "Dropped video frames", "Check the camera queue, the encoder and disk latency; leave the gaps out of training."),
    ("NON_MONOTONIC_TIME", "timing", "critical", "Time does not increase", "Find the clock at fault; do not hide it by sorting."),
    ("TIMESTAMP_GAP", "timing", "warning", "Gaps in the sample stream", "Check queues and sensor drop-outs; mark the gap before training."),
    ("JOINT_JUMP", "motion", "critical", "Sudden joint jump", "Check encoders, control period and action scaling; do not run it on hardware."),
    ("ROBOT_STUCK", "task", "critical", "No useful motion for a long time", "Compare contact force and commands to tell a blocked arm from a silent one."),
    ("SENSOR_DESYNC", "synchronisation", None, "Camera and robot out of step", "Use one clock or correct the offset at export, then check again."),
    ("FORCE_SPIKE", "safety", "critical", "Abnormal contact force", "Check the contact point and force control; keep the part out of imitation learning."),
    ("GRIPPER_RESPONSE_FAILURE", "control", "critical", "Close command not carried out", "Check gripper drive, mapping and limits before transport."),
    ("GRASP_SLIP", "task", "critical", "Object probably slipped", "Replay the frames; check grasp pose, force and tracking."),
    ("WORKSPACE_OUTLIER", "safety", "critical", "Pose outside the workspace", "Set the exact workspace of the robot and add limits."),
)
ISSUE_RULE = {row[0]: i for i, row in enumerate(ISSUE_TYPES)}
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}


@dataclass(frozen=True)
class Diagnosis:
    """Rows with flags, runs, and one row of figures per episode."""

    rows: DataFrame
    runs: DataFrame
    figures: DataFrame
    roles: Roles
    profile: Profile
    layout: Layout


RUN_KINDS = ("drop", "stuck", "mismatch")


def flagged_rows(steps: DataFrame, layout: Layout, profile: Profile, roles: Roles | None = None, fixed: bool = False) -> DataFrame:
    """The steps with speed, thresholds, one flag per row rule, and the runs of dropped frames, of no motion
    and of an ignored close command; if ``fixed``, also those of no motion by the fixed rules."""
    roles = roles or resolve_roles(steps)
    p = profile
    channels = list(dict.fromkeys([*roles.motion, *roles.joints]))
    grasp = roles.has("gripper", "object_distance")
    previous = [c for c in ("object_distance", "is_grasped") if grasp and roles.has(c)]
    rows = ts.with_rates(steps, layout, channels, previous)
    rows = rows.selectExpr(
        "*", f"{ts.speed_sql(roles)} AS speed", *[f"abs({ts.rate_sql(c)}) AS `{c}__rate`" for c in roles.joints]
    ).drop(*[f"{c}{s}" for c in channels for s in ("__fill", "__fill__lag")])
    robust = {c: (F.col(f"{c}__rate"), p.joint_velocity_mad_scale, p.joint_velocity_floor) for c in roles.joints}
    if roles.has("force_z"):
        robust["force_z"] = (F.expr(f"abs({numeric_sql('force_z')})"), p.force_mad_scale, p.force_floor)
    rows = ts.with_robust_thresholds(rows, layout, robust)
    n = numeric_sql
    closed = f"{n('gripper')} < {p.slip_gripper_closed}"
    limit = f"greatest(median_dt * {p.gap_period_multiplier}, median_dt + {p.gap_extra_seconds})"
    idle = f"lower(phase) IN ({', '.join(repr(x) for x in IDLE_PHASES)})" if roles.has("phase") else "false"
    flags = {
        "backwards": "dt <= 0",
        "gap": f"dt > {limit}",
        "jump": " OR ".join(f"coalesce(`{c}__rate` > `{c}__limit`, false)" for c in roles.joints) or "false",
        "spike": f"abs({n('force_z')}) > force_z__limit" if roles.has("force_z") else "false",
        "slip": f"{closed} AND {n('object_distance')} > {p.slip_distance_threshold} AND "
        f"{n('object_distance')} - {n('object_distance__lag')} > {p.slip_step_threshold}" if grasp else "false",
        "loss": f"{closed} AND is_grasped__lag AND NOT coalesce(is_grasped, false)"
        if grasp and roles.has("is_grasped") else "false",
    }
    outside = [
        f"if({n(c)} < {lo} OR {n(c)} > {hi}, 1, 0)" for c, (lo, hi) in p.workspace.items() if roles.has(c)
    ]
    rows = rows.selectExpr(
        "*", *[f"coalesce({f}, false) AS {name}" for name, f in flags.items()], f"{' + '.join(outside) or '0'} AS outside"
    ).drop(*[f"{c}__lag" for c in previous])
    masks = {
        "drop": f"coalesce({n('frame_valid')}, 0) < 0.5" if roles.has("frame_valid") else "false",
        "stuck": f"speed < {p.stuck_speed_threshold} AND NOT coalesce({idle}, false)" if roles.motion else "false",
        "mismatch": f"{n('gripper_command')} < {CLOSE_COMMAND} AND {n('gripper')} > {STILL_OPEN}"
        if roles.has("gripper", "gripper_command") else "false",
    }
    return ts.with_runs(rows, layout, masks | (still_mask(roles) if fixed else {}))


def row_runs(rows: DataFrame, layout: Layout) -> DataFrame:
    """The runs of ``flagged_rows``, of any length."""
    return ts.runs_of(rows, layout, RUN_KINDS, carry=["median_dt"])


def segment_seconds(profile: Profile) -> dict[str, str]:
    """Least duration of a run that counts, per kind (SQL)."""
    return {
        "drop": f"greatest(median_dt, {profile.frame_drop_min_duration})",
        "stuck": f"{profile.stuck_min_duration}D",
        "mismatch": f"{MISMATCH_SECONDS}D",
    }


def kept_segments(runs: DataFrame, profile: Profile) -> DataFrame:
    cases = " ".join(f"WHEN '{k}' THEN {s}" for k, s in segment_seconds(profile).items())
    return ts.contiguous_segments(runs, F.expr(f"CASE kind {cases} END"))


def row_figures(rows: DataFrame, roles: Roles, keys, profile: Profile, also: Sequence[Column] = (), told: Sequence[Column] = ()) -> DataFrame:
    """One row per episode: counts, extremes and times of the row rules and of the runs that count, and the aggregates ``also``.

    ``told`` are columns with one value for an episode. They are grouped by: a minimum of texts would take the hash aggregate away.
    """

    def first_last(flag: str) -> list[str]:
        return [
            f"count_if({flag}) AS {flag}_rows",
            f"min_by(timestamp, seq) FILTER (WHERE {flag}) AS {flag}_start",
            f"max_by(timestamp, seq) FILTER (WHERE {flag}) AS {flag}_end",
        ]

    def segments(kind: str, least: str) -> list[str]:
        start = f"{kind}__from"
        kept = f"{kind}__end AND seq > {start}.seq AND timestamp - {start}.t >= {least}"
        return [
            f"count_if({kept}) AS {kind}_segments",
            f"coalesce(sum(seq - {start}.seq + 1) FILTER (WHERE {kept}), 0) AS {kind}_segment_rows",
            f"coalesce(sum(timestamp - {start}.t) FILTER (WHERE {kept}), 0D) AS {kind}_seconds",
            f"min_by({start}.t, seq) FILTER (WHERE {kept}) AS {kind}_segment_start",
            f"max_by(timestamp, seq) FILTER (WHERE {kept}) AS {kind}_segment_end",
        ]

    words = ", ".join(repr(w) for w in TRUE_WORDS)
    last = {c: f"coalesce(lower(trim(cast(max_by({c}, seq) AS STRING))) IN ({words}), false)" for c in ("success", "success_known") if roles.has(c)}
    known = last.get("success_known", "true" if roles.has("success") else "false")
    peak = "greatest(0D, 0D" + "".join(f", `{c}__rate`" for c in roles.joints) + ")"
    sums = [
        "count(1) AS rows",
        "min_by(timestamp, seq) AS first_time",
        "max_by(timestamp, seq) AS last_time",
        "max(median_dt) AS median_dt",
        "coalesce(stddev_pop(dt) FILTER (WHERE dt > 0) / (avg(dt) FILTER (WHERE dt > 0) + 1e-9), 0D) AS jitter",
        f"count(1) * {max(1, len(roles.numeric))} AS total_cells",
        *[f"count_if(`{c}` IS NULL) AS `missing__{c}`" for c in roles.numeric],
        "count_if(backwards) AS backwards_rows",
        "count_if(gap) AS gap_rows",
        "min_by(timestamp - dt, seq) FILTER (WHERE gap) AS gap_start",
        "max_by(timestamp, seq) FILTER (WHERE gap) AS gap_end",
        "max(dt) FILTER (WHERE gap) AS largest_gap",
        *[e for flag in ("drop", "jump", "spike", "slip", "loss") for e in first_last(flag)],
        *[e for kind, least in segment_seconds(profile).items() for e in segments(kind, least)],
        f"max({peak}) FILTER (WHERE jump) AS peak_joint_speed",
        "sum(outside) AS outside_samples",
        f"{known} AS success_known",
        f"{known} AND {last.get('success', 'false')} AS success",
    ]
    if roles.has("force_z"):
        sums += [f"max(abs({numeric_sql('force_z')})) FILTER (WHERE spike) AS peak_force", "max(force_z__limit) AS force_limit"]
    out = rows.groupBy(*keys, *told).agg(*[F.expr(e) for e in sums], *also)
    missing = " + ".join(f"`missing__{c}`" for c in roles.numeric) or "0"
    return out.selectExpr("*", f"{missing} AS missing_cells")


def sync_figures(rows: DataFrame, layout: Layout, profile: Profile) -> DataFrame:
    return ts.sync_offset(rows, layout, "speed", "camera_motion", profile.sync_max_lag_seconds)


def inspect_steps(
    steps: DataFrame, profile: str | Profile | None = None, layout: Layout | None = None, fixed: bool = False,
    also: Sequence[Column] = (), told: Sequence[Column] = (),
) -> Diagnosis:
    """All detectors over all episodes in one plan. If ``fixed``, the figures have the sums of the fixed rules, too, from the same
    pass over the rows; ``also`` and ``told`` are those of ``row_figures``."""
    profile = resolve_profile(profile)
    layout = layout or Layout.probe(steps)
    roles = resolve_roles(steps)
    rows = flagged_rows(steps, layout, profile, roles, fixed)
    figures = row_figures(rows, roles, layout.keys, profile, [*(fixed_sums(roles) if fixed else []), *also], told)
    if roles.has("camera_motion"):
        figures = figures.join(sync_figures(rows, layout, profile), list(layout.keys), "left")
    else:
        figures = figures.selectExpr("*", "0 AS lag", "0D AS confidence")
    kept = [c for c in figures.columns if c not in ("lag", "confidence")]
    slip = "slip_rows >= 3"
    figures = figures.selectExpr(
        *[f"`{c}`" for c in kept],
        "coalesce(lag * median_dt, 0D) AS offset",
        "coalesce(confidence, 0D) AS confidence",
        "missing_cells / greatest(1, total_cells) AS missing_rate",
        f"({slip} OR loss_rows > 0) AS slipped",
        *[f"if({slip}, slip_{x}, loss_{x}) AS slip_evidence_{x}" for x in ("rows", "start", "end")],
    ).selectExpr(
        "*",
        f"(abs(offset) >= {profile.sync_warning_seconds} AND confidence >= {profile.sync_min_confidence}) AS desynced",
    )
    return Diagnosis(rows, row_runs(rows, layout), figures, roles, profile, layout)


# ---- issues ---------------------------------------------------------------------------------------


def issue_array(roles: Roles, profile: Profile) -> Column:
    """The issues of an episode from its figures, critical ones first, else in rule order (at most one per rule)."""
    fixed = {code: severity for code, _, severity, _, _ in ISSUE_TYPES}
    force = "format_string('limit %.1f N, peak %.1f N', force_limit, peak_force)" if roles.has("force_z") else "''"
    # code: condition, count, start, end, evidence, severity when it depends on the figures
    rules = {
        "MISSING_VALUES": ("missing_cells > 0", "missing_cells", None, None, top_missing(roles), "if(missing_rate < 0.02, 'warning', 'critical')"),
        "FRAME_DROP": ("drop_rows > 0", "drop_rows", "drop_start", "drop_end", "format_string('frame_valid=0 in %.1f%% of rows', drop_rows / rows * 100)", None),
        "NON_MONOTONIC_TIME": ("backwards_rows > 0", "backwards_rows", None, None, "''", None),
        "TIMESTAMP_GAP": ("gap_rows > 0", "gap_rows", "gap_start", "gap_end", "format_string('usual period %.1f ms, largest gap %.0f ms', median_dt * 1000, largest_gap * 1000)", None),
        "JOINT_JUMP": ("jump_rows > 0", "jump_rows", "jump_start", "jump_end", "format_string('peak %.1f rad/s', peak_joint_speed)", None),
        "ROBOT_STUCK": ("stuck_segments > 0", "stuck_segments", "stuck_segment_start", "stuck_segment_end", "format_string('%.1f s in all', stuck_seconds)", None),
        "SENSOR_DESYNC": ("desynced", "1", None, None, "format_string('offset %.0f ms, confidence %.2f', offset * 1000, confidence)", f"if(abs(offset) >= {profile.sync_critical_seconds}, 'critical', 'warning')"),
        "FORCE_SPIKE": ("spike_rows > 0", "spike_rows", "spike_start", "spike_end", force, None),
        "GRIPPER_RESPONSE_FAILURE": ("mismatch_segments > 0", "mismatch_segment_rows", "mismatch_segment_start", "mismatch_segment_end", "'gripper_command < -0.5 and gripper > 0.65'", None),
        "GRASP_SLIP": ("slipped", "slip_evidence_rows", "slip_evidence_start", "slip_evidence_end", "if(slip_rows >= 3, 'distance grows with a closed gripper', 'grasp lost with a closed gripper')", None),
        "WORKSPACE_OUTLIER": ("outside_samples > 0", "outside_samples", None, None, "''", None),
    }

    def entry(code: str) -> str:
        found, count, start, end, evidence, severity = rules[code]
        severity = severity or repr(fixed[code])
        none = "cast(NULL AS DOUBLE)"
        return (
            f"if({found}, named_struct('rank', if({severity} = 'critical', 0, 1), 'rule', {ISSUE_RULE[code]}, 'code', '{code}', "
            f"'severity', {severity}, 'count', cast({count} AS BIGINT), 'start_time', {start or none}, 'end_time', {end or none}, "
            f"'evidence', {evidence}), NULL)"
        )

    return F.expr(f"array_sort(array_compact(array({', '.join(entry(code) for code in ISSUE_RULE)})))")


def top_missing(roles: Roles, k: int = 4) -> str:
    """The channels with most missing values of an episode as text, from its ``missing__*`` figures (SQL)."""
    if not roles.numeric:
        return "''"
    counts = ", ".join(
        f"named_struct('n', -`missing__{c}`, 'i', {i}, 'text', concat('{c}: ', `missing__{c}`))" for i, c in enumerate(roles.numeric)
    )
    return f"array_join(transform(slice(array_sort(filter(array({counts}), e -> e.n < 0)), 1, {k}), e -> e.text), ', ')"


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def issue_rows(episodes: DataFrame, keys=("episode_id",)) -> DataFrame:
    """One row per (episode, issue) with its place in the severity order."""
    exploded = episodes.select(*keys, F.posexplode("issues").alias("place", "issue"))
    return exploded.select(*keys, "place", "issue.*").drop("rank")


def missing_channels(d: Diagnosis, k: int = 4) -> DataFrame:
    """The channels with most missing values per episode, one row each."""
    entries = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"missing__{c}").alias("missing"), F.lit(i).alias("place")) for i, c in enumerate(d.roles.numeric)])
    long = d.figures.select(*d.layout.keys, F.inline(F.filter(entries, lambda e: e["missing"] > 0)))
    w = Window.partitionBy(*d.layout.keys).orderBy(F.desc("missing"), "place")
    return long.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


# ---- events ---------------------------------------------------------------------------------------


EVENT_LABELS = {
    "frame-drop": "Frames dropped", "gap": "Sampling gap", "stuck": "No motion", "gripper-response": "Close command ignored", "slip": "Object slipped",
    "jump": "Joint jump", "collision": "Contact force peak",
}


def event_rows(d: Diagnosis, per_type: int = EVENTS_PER_TYPE) -> DataFrame:
    """All events: runs, gaps, offset, slip, and the first ones of jumps and force peaks, with a label.

    One scan of the rows, beside the one that makes the figures: every row emits its events, the first row of an episode those of the
    figures, the middle one the offset. What is kept of jumps and peaks is limited within tasks before anything is shuffled.
    """
    keys = list(d.layout.keys)
    figures = ["rows", "drop_rows", "drop_segments", "drop_start", "drop_end", "mismatch_segments", "mismatch_segment_start", "mismatch_segment_end",
               "slipped", "slip_evidence_start", "slip_evidence_end", "desynced", "offset"]
    own = [*keys, "seq", "timestamp", "dt", "median_dt", "gap", "jump", "spike", *[f"{k}__{x}" for k in ("drop", "stuck") for x in ("from", "end")]]
    rows = d.layout.attach(d.rows.select(*own), d.figures.select(*keys, *[F.col(c).alias(f"_{c}") for c in figures]))
    least = segment_seconds(d.profile)

    def event(when: str, kind: str, time: str, end: str = "cast(NULL AS DOUBLE)", severity: str = "critical", label: str | None = None) -> str:
        label = label or f"'{EVENT_LABELS[kind]}'"
        return f"if({when}, named_struct('time', {time}, 'end_time', {end}, 'type', '{kind}', 'severity', '{severity}', 'label', {label}), NULL)"

    segment = lambda kind: f"{kind}__end AND seq > {kind}__from.seq AND timestamp - {kind}__from.t >= {least[kind]}"
    entries = [
        event(segment("drop"), "frame-drop", "drop__from.t", "timestamp"),
        event("seq = 0 AND _drop_rows > 0 AND _drop_segments = 0", "frame-drop", "_drop_start", "_drop_end"),
        event("gap", "gap", "timestamp - dt", severity="warning"),
        event(segment("stuck"), "stuck", "stuck__from.t", "timestamp"),
        event("seq = 0 AND _mismatch_segments > 0", "gripper-response", "_mismatch_segment_start", "_mismatch_segment_end"),
        event("seq = 0 AND _slipped", "slip", "_slip_evidence_start", "_slip_evidence_end"),
        event("jump", "jump", "timestamp"),
        event("spike", "collision", "timestamp"),
        event("_desynced AND seq = floor(_rows / 2)", "sync", "timestamp", severity="warning", label="concat('Camera offset ', cast(bround(_offset * 1000) AS BIGINT), ' ms')"),
    ]
    found = rows.selectExpr(*keys, "seq", f"inline(array_compact(array({', '.join(entries)})))")
    # Other types count each event by itself, so that one limit serves all rows.
    w = Window.partitionBy(*keys, "type", F.when(~F.col("type").isin("jump", "collision"), F.col("seq"))).orderBy("seq")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_type).drop("_n", "seq")


# ---- fixed-threshold rules ------------------------------------------------------------------------


def still_mask(roles: Roles) -> dict[str, str]:
    idle = "lower(phase) IN ('idle', 'reset')" if roles.has("phase") else "false"
    return {"still": f"speed < 0.003 AND NOT coalesce({idle}, false)"}


FIXED_SUMS = ("_dt", "_joint", "_force", "_slip", "_still")


def fixed_sums(roles: Roles) -> list[Column]:
    """What the fixed rules need of an episode's rows, which have the runs of ``still_mask``."""
    peak = "greatest(0D, 0D" + "".join(f", `{c}__rate`" for c in roles.joints) + ")"
    return [
        F.expr("max(dt) AS _dt"), F.expr(f"max({peak}) AS _joint"),
        F.expr(f"max(abs({numeric_sql('force_z')})) AS _force" if roles.has("force_z") else "0D AS _force"),
        F.expr(f"count_if(slip AND {numeric_sql('gripper')} < 0.3) AS _slip" if roles.has("gripper") else "0L AS _slip"),
        F.expr("max(greatest(0D, timestamp - still__from.t)) FILTER (WHERE still__end) AS _still"),
    ]


def fixed_codes() -> str:
    """The codes of the fixed rules from the figures and ``fixed_sums``, sorted (SQL)."""
    rules = {
        "TIMESTAMP_GAP": "_dt > greatest(0.10, median_dt * 4)",
        "FRAME_DROP": "drop_rows > 0",
        "JOINT_JUMP": "_joint > 8",
        "FORCE_SPIKE": "_force > 50",
        "ROBOT_STUCK": "_still >= 1.5",
        "SENSOR_DESYNC": "abs(offset) >= 0.15 AND confidence >= 0.35",
        "GRASP_SLIP": "_slip >= 6",
    }
    codes = ", ".join(f"if({rule}, '{code}', NULL)" for code, rule in rules.items())
    return f"array_sort(array_compact(array({codes})))"


def fixed_threshold_codes(d: Diagnosis) -> DataFrame:
    """A simpler detector with fixed limits, for comparison: ``codes`` per episode, sorted."""
    keys = list(d.layout.keys)
    rows = ts.with_runs(d.rows, d.layout, still_mask(d.roles))
    sums = rows.groupBy(*keys).agg(*fixed_sums(d.roles))
    return d.figures.select(*keys, "median_dt", "drop_rows", "offset", "confidence").join(sums, keys).selectExpr(*keys, f"{fixed_codes()} AS codes")
