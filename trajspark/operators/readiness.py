"""Readiness of episodes for policy training: what is observed, whether actions move the state, and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.columns import TRUE_WORDS_LOCAL, count_if, numeric_sql
from trajspark.functions.lagged import lag_correlations
from trajspark.functions.layout import Layout
from trajspark.operators import timeseries as ts
from trajspark.operators.steps import Roles, resolve_roles

# Weights, hard blockers, limits.
WEIGHTS = {"observability": 0.22, "controllability": 0.25, "temporal_grounding": 0.18, "contact_grounding": 0.20, "behavior_diversity": 0.15}
HARD_BLOCKERS = ("ACTION_MISSING", "OUTCOME_MISSING", "TIME_INVALID")
ACTION_BOUND, RESPONSE_ROWS, RESPONSE_MIN_ROWS = 1.05, 12, 16
ADVICE = {
    "ACTION_MISSING": "Record an action with every step, aligned with the observation.",
    "ACTION_PROXY": "Export the controller's real action; state differences are only a stand-in.",
    "OUTCOME_MISSING": "Add success, reward or a terminal flag.",
    "PHASE_MISSING": "Keep phase or event labels so that episodes can be cut by task step.",
    "CONTACT_MISSING": "Record gripper, object distance or contact force.",
    "TIME_INVALID": "Repair the clock or the order within the episode; keep the original time.",
}


def state_channels(roles: Roles) -> tuple[str, ...]:
    return roles.joints or roles.positions


def response_alignment(rows: DataFrame, layout: Layout, action: str, motion: str) -> DataFrame:
    """Best correlation of the action with the motion 0..min(12, n div 5) rows later, and that lag."""
    counted = layout.with_figures(rows, {"_n": F.count(F.lit(1)), "_action0": F.avg(action), "_motion0": F.avg(motion)}).filter(F.col("_n") >= RESPONSE_MIN_ROWS)
    last = F.least(F.lit(RESPONSE_ROWS), F.floor(F.col("_n") / 5))
    found = lag_correlations(counted, layout, action, motion, F.lit(0), last, (F.col("_action0"), F.col("_motion0")))
    weak = "pairs < 8 OR left_std < 1e-9 OR right_std < 1e-9 OR r IS NULL OR isnan(r)"
    found = found.selectExpr(*layout.keys, "lag", f"if({weak}, 0D, greatest(-1D, least(1D, r))) AS r")
    best = found.groupBy(*layout.keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("back"))).alias("_b"))
    return best.select(*layout.keys, F.col("_b.r").alias("alignment"), (-F.col("_b.back")).cast("int").alias("response_lag"))


def with_motion(steps: DataFrame, layout: Layout, roles: Roles) -> DataFrame:
    """``state_rate``: speed of the state channels; ``action_size``: norm of the action, or the state speed."""
    states, actions = state_channels(roles), roles.actions
    rows = ts.with_rates(steps, layout, [*states, *actions])
    zero = lambda c: f"coalesce(`{c}__fill`, 0D)"
    step = lambda c: f"if(dt IS NULL, 0D, (coalesce(`{c}__fill`, 0D) - coalesce(`{c}__fill__lag`, 0D)) / if(dt > 0, dt, median_dt))"
    speed = "sqrt(" + " + ".join(f"power({step(c)}, 2)" for c in states) + ")" if states else "0D"
    size = "sqrt(" + " + ".join(f"power({zero(c)}, 2)" for c in actions) + ")" if actions else ("state_rate" if states else "0D")
    wide = " OR ".join(f"abs({zero(c)}) > {ACTION_BOUND}" for c in actions) or "false"
    return rows.selectExpr("*", f"{speed} AS state_rate").selectExpr("*", f"{size} AS action_size", f"({wide}) AS action_wide").drop(
        *[f"{c}{s}" for c in (*states, *actions) for s in ("__fill", "__fill__lag")]
    )


def action_bounds_rate(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.groupBy(*layout.keys).agg(F.expr("avg(int(action_wide)) AS action_out_of_bounds"))


def phase_first_seen(steps: DataFrame, layout: Layout) -> DataFrame:
    """The phases of each episode with the position where each first occurs."""
    return steps.groupBy(*layout.keys, F.coalesce(F.col("phase").cast("string"), F.lit("unknown")).alias("phase")).agg(
        F.min(layout.order).alias("first_seq"), F.count(F.lit(1)).alias("rows")
    )


def phase_transitions(steps: DataFrame, layout: Layout) -> DataFrame:
    """Number of distinct phases, number of changes and the coverage score."""
    name = F.coalesce(F.col("phase").cast("string"), F.lit("unknown"))
    rows = layout.local(
        steps.select(*layout.keys, layout.order, name.alias("phase")), lambda w: {"_before": F.lag("phase").over(w)}, before=1
    )
    per_phase = rows.groupBy(*layout.keys, "phase").agg(count_if(F.col("phase") != F.col("_before")).alias("_changes"))
    return per_phase.groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("phase_count"), F.sum("_changes").alias("phase_transitions")).selectExpr(
        "*", "0.6D * least(1D, phase_count / 4) + 0.4D * least(1D, phase_transitions / 4) AS phase_coverage"
    )


def contact_figures(rows: DataFrame, layout: Layout, roles: Roles) -> DataFrame:
    """Share of rows in contact, share of rows with force activity, and the contact score."""
    n = numeric_sql
    aggs, score = ["0D AS contact_ratio"], "20D"
    if roles.has("force_z"):
        size = f"abs(coalesce({n('force_z')}, 0D))"
        rows = layout.with_quantiles(rows, {"_p65": (F.expr(size), 0.65)})
        aggs.append(f"avg(int({size} > greatest(2D, _p65))) AS force_activity")
    else:
        aggs.append("0D AS force_activity")
    if roles.has("gripper", "object_distance"):
        touch = f"coalesce({n('gripper')}, 1D) < 0.35 AND coalesce({n('object_distance')}, 1D) < 0.08"
        aggs[0] = f"avg(int({touch})) AS contact_ratio"
        score += " + if(contact_ratio > 0, 45D, 0D)"
    if roles.has("force_z"):
        score += " + least(35D, force_activity * 120)"
    return rows.groupBy(*layout.keys).agg(*[F.expr(a) for a in aggs]).selectExpr("*", f"greatest(0D, least(100D, {score})) AS contact_quality")


def readiness(steps: DataFrame, layout: Layout | None = None) -> DataFrame:
    """One row per episode: five dimensions, score, blockers, status. Without a layout, by the length of each episode."""
    if layout is None:
        return reduce(DataFrame.unionByName, [readiness(rows, way) for rows, way in Layout.split(steps)])
    roles = resolve_roles(steps)
    keys = list(layout.keys)
    states, actions = state_channels(roles), roles.actions
    rows = with_motion(steps, layout, roles)
    source = "explicit" if actions else "proxy" if states else "missing"
    words = ", ".join(repr(w) for w in TRUE_WORDS_LOCAL)
    sums = [
        "count(1) AS rows", "min_by(timestamp, seq) AS first_time", "max_by(timestamp, seq) AS last_time", "max(median_dt) AS median_dt",
        "count_if(dt <= 0) = 0 AS monotonic",
        "coalesce(stddev_pop(dt) FILTER (WHERE dt > 0) / (avg(dt) FILTER (WHERE dt > 0) + 1e-9), 0D) AS jitter",
        "stddev_pop(action_size) / (avg(abs(action_size)) + 1e-9) AS action_variation",
        "avg(int(action_wide)) AS action_out_of_bounds",
        f"coalesce(lower(trim(cast(max_by(success, seq) AS STRING))) IN ({words}), false) AS task_success" if roles.has("success")
        else "cast(NULL AS BOOLEAN) AS task_success",
    ]
    out = rows.groupBy(*keys).agg(*[F.expr(s) for s in sums])
    out = out.join(contact_figures(rows, layout, roles), keys)
    if actions:
        out = out.join(response_alignment(rows, layout, "action_size", "state_rate"), keys, "left").selectExpr(
            *[c for c in out.columns], "coalesce(alignment, 0D) AS alignment", "coalesce(response_lag, 0) AS response_lag"
        )
    else:
        out = out.selectExpr("*", "cast(NULL AS DOUBLE) AS alignment", "cast(NULL AS INT) AS response_lag").withColumn("action_out_of_bounds", F.lit(None).cast("double"))
    if roles.has("phase"):
        out = out.join(phase_transitions(steps, layout), keys)
    else:
        out = out.selectExpr("*", "0L AS phase_count", "0L AS phase_transitions", "0D AS phase_coverage")
    visual = roles.has("camera_motion") or roles.has("frame_valid")
    contact = any(roles.has(c) for c in ("force_z", "gripper", "object_distance"))
    # What counts as contact evidence is narrower than what counts as an observed contact channel.
    contact_evidence = roles.has("gripper", "object_distance") or roles.has("force_z")
    seen = (28 if states else 0) + (22 if actions else 8 if states else 0) + 16 * visual + 18 * contact + 16 * roles.has("success")
    control = {"explicit": "50D + greatest(0D, alignment) * 42 - least(20D, action_out_of_bounds * 200)", "proxy": "45D", "missing": "15D"}[source]
    temporal = "100 * (0.55D * int(monotonic) + 0.25D * greatest(0D, 1 - least(1D, jitter / 0.25D)) + 0.20D * phase_coverage)"
    dims = {
        "observability": f"{float(seen)}D",
        "controllability": f"greatest(0D, least(100D, {control}))",
        "temporal_grounding": temporal,
        "contact_grounding": "contact_quality",
        "behavior_diversity": "greatest(0D, least(100D, 35 + least(1D, action_variation) * 65))",
    }
    fixed = [
        ("ACTION_MISSING", source == "missing"), ("ACTION_PROXY", source == "proxy"), ("OUTCOME_MISSING", not roles.has("success")),
        ("PHASE_MISSING", not roles.has("phase")), ("CONTACT_MISSING", not contact_evidence),
    ]
    blockers = [f"if({str(hit).lower()}, '{code}', NULL)" for code, hit in fixed] + ["if(monotonic, NULL, 'TIME_INVALID')"]
    hard = ", ".join(repr(c) for c in HARD_BLOCKERS)
    out = out.selectExpr("*", *[f"(rint(({e}) * 10D) / 10D + 0D) AS {n}" for n, e in dims.items()], f"array_compact(array({', '.join(blockers)})) AS blockers")
    out = out.selectExpr("*", " + ".join(f"{n} * {w}D" for n, w in WEIGHTS.items()) + " AS raw_score", f"'{source}' AS action_source")
    advice = ", ".join(f"if(array_contains(blockers, '{code}'), {text!r}, NULL)" for code, text in ADVICE.items())
    wide = "if(action_out_of_bounds > 0.01, 'Check that actions are scaled to [-1, 1].', NULL)"
    return out.selectExpr(
        "*", "(rint(raw_score * 10D) / 10D + 0D) AS score",
        f"CASE WHEN arrays_overlap(blockers, array({hard})) OR raw_score < 55 THEN 'blocked' WHEN raw_score < 78 OR size(blockers) > 0 THEN 'review' ELSE 'ready' END AS status",
        "(rint(greatest(0D, last_time - first_time) * 1000D) / 1000D + 0D) AS duration",
        "(rint((response_lag * median_dt * 1000) * 10D) / 10D + 0D) AS response_lag_ms",
        f"array_compact(array({advice}, {wide})) AS recommendations",
    )


def readiness_overview(episodes: DataFrame) -> DataFrame:
    dims = [f"(rint(avg({d}) * 10D) / 10D + 0D) AS {d}" for d in WEIGHTS]
    out = episodes.selectExpr(
        "count(1) AS episode_count", "sum(rows) AS row_count", "(rint(avg(score) * 10D) / 10D + 0D) AS score", "avg(score) AS _score",
        *[f"count_if(status = '{s}') AS {s}" for s in ("ready", "review", "blocked")], *dims,
    )
    return out.selectExpr(
        *[c for c in out.columns if c != "_score"], "(rint((ready / episode_count * 100) * 10D) / 10D + 0D) AS ready_rate",
        "CASE WHEN blocked = 0 AND review = 0 AND _score >= 78 THEN 'ready' WHEN _score >= 55 THEN 'review' ELSE 'blocked' END AS status",
    )


def blocker_counts(episodes: DataFrame) -> DataFrame:
    long = episodes.select(F.explode("blockers").alias("code"))
    return long.groupBy("code").agg(F.count(F.lit(1)).alias("episode_count")).orderBy(F.desc("episode_count"), "code")
