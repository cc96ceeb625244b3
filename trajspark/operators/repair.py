"""Conservative repair: correct what can be corrected safely, quarantine the rest, keep an audit trail.

All episodes are repaired in one plan. Physical events are kept as measured; no samples are invented.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import numeric_sql
from trajspark.functions.layout import Layout
from trajspark.functions.lineage import materialise
from trajspark.operators import detect, score
from trajspark.operators import timeseries as ts
from trajspark.operators.steps import Roles, resolve_roles
from trajspark.profiles import Profile, resolve_profile

MAX_SHORT_GAP = 3
PREVIEW_ROWS = 30

# Action code: kind, whether it takes the row out of training, description.
ACTIONS = {
    "MISSING_VALUES": ("correction", False, "short gap filled linearly in time"),
    "JOINT_JUMP": ("correction", False, "single-row jump replaced from its neighbours"),
    "SENSOR_DESYNC": ("correction", False, "camera motion moved by the estimated offset"),
    "TIMESTAMP_SEGMENT": ("segmentation", False, "new segment after a break in time"),
    "FORCE_SPIKE": ("quarantine", True, "force peak and its neighbours set aside, measurement kept"),
    "FRAME_DROP": ("quarantine", True, "invalid frames set aside"),
    "GRASP_SLIP": ("quarantine", True, "slip interval set aside"),
    "MISSING_VALUES_UNRESOLVED": ("quarantine", True, "gap too long or without known values on both sides"),
    "NON_MONOTONIC_TIME": ("quarantine", True, "time does not increase"),
    "ROBOT_STUCK": ("quarantine", True, "interval without motion set aside"),
    "SENSOR_DESYNC_EDGE": ("quarantine", True, "outside the camera coverage after the correction"),
    "WORKSPACE_OUTLIER": ("quarantine", True, "pose outside the workspace"),
}
KIND_ORDER = {"correction": 0, "segmentation": 1, "quarantine": 2}
FACTS = ("offset", "confidence", "stuck_segment_start", "stuck_segment_end", "slipped", "slip_evidence_start", "slip_evidence_end")
AUDIT_COLUMNS = ("source_row", "quality_valid", "repair_actions", "repair_reason", "segment_id")


def hit(code: str) -> str:
    return f"did_{code.lower()}"


@dataclass(frozen=True)
class Repair:
    """``rows``: cleaned steps with audit columns, originals, one flag per action and the ``meta_*`` columns of the steps."""

    rows: DataFrame
    before: DataFrame
    columns: tuple[str, ...]
    signals: tuple[str, ...]
    joints: tuple[str, ...]
    profile: Profile
    layout: Layout
    stored: bool = True

    @cached_property
    def dealt(self) -> DataFrame:
        """The rows by episode, a bounded number to a task. Stored rows have lost how they were dealt, and windows over them would
        take as many tasks as the session has for any shuffle."""
        return self.layout.spread(self.rows, self.layout.keys[0]) if self.stored else self.rows

    @property
    def cleaned(self) -> DataFrame:
        """The cleaned rows as a user reads them."""
        return self.rows.select(*[f"`{c}`" for c in self.columns], *[f"{c}__original" for c in self.signals], *AUDIT_COLUMNS)

    @cached_property
    def after(self) -> DataFrame:
        """The diagnosis of the cleaned rows, one row per episode."""
        told = [k for k in self.layout.keys if k not in self.columns]
        return materialise(score.diagnose(self.dealt.select(*[f"`{c}`" for c in self.columns], *told), self.profile, self.layout))


def repair_steps(
    steps: DataFrame,
    profile: str | Profile | None = None,
    layout: Layout | None = None,
    max_short_gap: int = MAX_SHORT_GAP,
    stored: bool = True,
) -> Repair:
    """The repair of all episodes. Unless ``stored``, the rows are worked out again where they are read and none goes to disk, and of
    the diagnosis before only what the repair needs is kept."""
    profile = resolve_profile(profile)
    layout = layout or Layout.probe(steps)
    roles = resolve_roles(steps)
    before = score.diagnose(steps, profile, layout)
    before = materialise(before) if stored else before
    facts = before.select(*layout.keys, *FACTS)
    rows = repaired_rows(steps, facts if stored else materialise(facts), roles, profile, layout, max_short_gap)
    return Repair(materialise(rows) if stored else rows, before, roles.columns, roles.signals, roles.joints, profile, layout, stored)


def repaired_rows(
    steps: DataFrame, before: DataFrame, roles: Roles, profile: Profile, layout: Layout, max_short_gap: int
) -> DataFrame:
    """Corrections in order: short gaps, isolated jumps, camera offset; then segments and quarantine flags."""
    signals = list(roles.signals)
    rows = ts.short_gap_interpolate(steps, layout, signals, max_short_gap)
    rows = ts.with_period(ts.step_interval(rows, layout), layout)
    if roles.joints:
        rows = ts.isolated_spike_repair(rows, layout, list(roles.joints), profile)
    facts = before.selectExpr(
        *layout.keys,
        "(rint((offset * 1000) * 10D) / 10D + 0D) / 1000 AS _offset_s",
        f"abs((rint((offset * 1000) * 10D) / 10D + 0D) / 1000) >= {profile.sync_warning_seconds} AND (rint(confidence * 1000D) / 1000D + 0D) >= {profile.sync_min_confidence} AS _move",
        "stuck_segment_start AS _stuck_a", "stuck_segment_end AS _stuck_b",
        "if(slipped, slip_evidence_start, NULL) AS _slip_a", "slip_evidence_end AS _slip_b",
    )
    rows = layout.attach(rows, facts)
    false = "false"
    flags = {"SENSOR_DESYNC": false, "SENSOR_DESYNC_EDGE": false}
    if roles.has("camera_motion"):
        rows = layout.with_figures(rows, {"_known": F.count("camera_motion")})
        move = "coalesce(_move AND _known >= 2, false)"
        rows = ts.sample_at(rows, layout, "camera_motion", F.col("_offset_s"), move)
        flags["SENSOR_DESYNC"] = f"{move} AND camera_motion__shifted IS NOT NULL"
        flags["SENSOR_DESYNC_EDGE"] = f"{move} AND camera_motion__shifted IS NULL"
    rows = ts.segment_ids(rows, layout, profile)
    n = numeric_sql
    if roles.has("force_z"):
        force = {"force_z": (F.expr(f"abs({n('force_z')})"), profile.force_mad_scale, profile.force_floor)}
        rows = ts.with_robust_thresholds(rows, layout, force)
        rows = rows.selectExpr("*", f"coalesce(abs({n('force_z')}) > force_z__limit, false) AS peak")
        rows = ts.dilate(rows, layout, "peak")
    outside = {c: f"coalesce({n(c)} < {lo} OR {n(c)} > {hi}, false)" for c, (lo, hi) in profile.workspace.items() if roles.has(c)}
    camera = "`camera_motion`"
    moved = f"if({flags['SENSOR_DESYNC']}, camera_motion__shifted, {camera})"
    final = {c: (moved if c == "camera_motion" else f"`{c}`") for c in roles.columns}
    holes = " OR ".join(f"({final[c]}) IS NULL" for c in roles.columns)
    flags |= {
        "MISSING_VALUES": " OR ".join(f"`{c}__filled`" for c in signals) or false,
        "JOINT_JUMP": " OR ".join(f"`{c}__spike`" for c in roles.joints) or false,
        "TIMESTAMP_SEGMENT": "boundary",
        "NON_MONOTONIC_TIME": "coalesce(dt <= 0, false)",
        "FRAME_DROP": f"coalesce({n('frame_valid')}, 0) < 0.5" if roles.has("frame_valid") else false,
        "FORCE_SPIKE": "peak__wide" if roles.has("force_z") else false,
        "ROBOT_STUCK": "coalesce(timestamp BETWEEN _stuck_a AND _stuck_b, false)",
        "GRASP_SLIP": "coalesce(timestamp BETWEEN _slip_a AND _slip_b, false)",
        "WORKSPACE_OUTLIER": " OR ".join(outside.values()) or false,
        "MISSING_VALUES_UNRESOLVED": " OR ".join([*[f"`{c}__open`" for c in signals], holes]),
    }
    cells = {
        "MISSING_VALUES": " + ".join(f"int(`{c}__filled`)" for c in signals) or "0",
        "JOINT_JUMP": " + ".join(f"int(`{c}__spike`)" for c in roles.joints) or "0",
    }
    rows = rows.selectExpr(
        *[f"{final[c]} AS `{c}`" for c in roles.columns],
        *[c for c in steps.columns if c.startswith("meta_")],
        *[f"`{c}__original`" for c in signals],
        *[f"`{c}__filled`" for c in signals],
        *[f"`{c}__open`" for c in signals],
        *[f"({outside[c]}) AS `{c}__outside`" for c in outside],
        "segment_id",
        *[f"({f}) AS {hit(code)}" for code, f in flags.items()],
        *[f"{e} AS cells_{code.lower()}" for code, e in cells.items()],
    )
    codes = ", ".join(f"if({hit(c)}, '{c}', NULL)" for c in sorted(ACTIONS))
    bad = " OR ".join(hit(c) for c, (_, out, _) in ACTIONS.items() if out)
    return rows.selectExpr("*", f"NOT ({bad}) AS quality_valid", f"concat_ws(';', {codes}) AS repair_actions").selectExpr(
        "*", "repair_actions AS repair_reason", "seq AS source_row"
    )


# ---- what was done --------------------------------------------------------------------------------


def repair_actions(r: Repair) -> DataFrame:
    """One row per (episode, action): kind, rows, cells, channels, start and end time."""
    aggs = []
    for code in ACTIONS:
        flag = hit(code)
        aggs += [
            f"count_if({flag}) AS n_{flag}",
            f"min_by(timestamp, seq) FILTER (WHERE {flag}) AS a_{flag}",
            f"max_by(timestamp, seq) FILTER (WHERE {flag}) AS b_{flag}",
        ]
    axes = [c for c in r.rows.columns if c.endswith("__outside")]
    touched = [*[f"{c}__filled" for c in r.signals], *[f"{c}__open" for c in r.signals], *axes]
    sums = r.rows.groupBy(*r.layout.keys).agg(
        *[F.expr(a) for a in aggs],
        *[F.expr(f"sum(cells_{c}) AS cells_{c}") for c in ("missing_values", "joint_jump")],
        *[F.expr(f"bool_or(`{c}`) AS `{c}`") for c in touched],
    )

    def names(columns: list[str], ending: str) -> str:
        items = ", ".join(f"if(`{c}{ending}`, '{c}', NULL)" for c in sorted(columns))
        return f"concat_ws(';', {items})" if items else "''"

    channels = {
        "MISSING_VALUES": names(list(r.signals), "__filled"),
        "MISSING_VALUES_UNRESOLVED": names(list(r.signals), "__open"),
        "JOINT_JUMP": repr(";".join(sorted(r.joints))),
        "WORKSPACE_OUTLIER": names([c[: -len("__outside")] for c in axes], "__outside"),
        "SENSOR_DESYNC": "'camera_motion'", "SENSOR_DESYNC_EDGE": "'camera_motion'",
        "TIMESTAMP_SEGMENT": "'timestamp'", "NON_MONOTONIC_TIME": "'timestamp'",
        "FRAME_DROP": "'frame_valid'", "FORCE_SPIKE": "'force_z'",
    }
    cells = {"MISSING_VALUES": "cells_missing_values", "JOINT_JUMP": "cells_joint_jump", "SENSOR_DESYNC": f"n_{hit('SENSOR_DESYNC')}"}
    entries = ", ".join(
        f"named_struct('code', '{code}', 'kind', '{kind}', 'kind_order', {KIND_ORDER[kind]}, 'row_count', n_{hit(code)}, "
        f"'cells', cast({cells.get(code, '0')} AS BIGINT), 'columns', {channels.get(code, repr(''))}, "
        f"'start_time', (rint((a_{hit(code)}) * 10000D) / 10000D + 0D), 'end_time', (rint((b_{hit(code)}) * 10000D) / 10000D + 0D))"
        for code, (kind, _, _) in ACTIONS.items()
    )
    return sums.selectExpr(*r.layout.keys, f"inline(array_sort(filter(array({entries}), e -> e.row_count > 0), "
                           "(x, y) -> if(x.kind_order < y.kind_order OR x.kind_order = y.kind_order AND x.code < y.code, -1, 1)))")


def row_audit(r: Repair) -> DataFrame:
    return r.rows.select(*r.layout.keys, *AUDIT_COLUMNS)


def issue_resolution(r: Repair) -> DataFrame:
    """Issue codes before and after, and what became of them."""
    keys = list(r.layout.keys)
    done = r.rows.groupBy(*keys).agg(*[F.expr(f"bool_or({hit(c)}) AS {hit(c)}") for c in ACTIONS])

    def codes(kind: str) -> str:
        items = ", ".join(f"if({hit(c)}, '{c}', NULL)" for c, (k, _, _) in sorted(ACTIONS.items()) if k == kind)
        return f"array_compact(array({items}))"

    both = (
        r.before.select(*keys, F.col("issue_codes").alias("before"))
        .join(r.after.select(*keys, F.col("issue_codes").alias("unresolved")), keys)
        .join(done, keys)
    )
    return both.selectExpr(
        *keys, "before", f"{codes('correction')} AS corrected", "array_sort(array_except(before, unresolved)) AS resolved",
        "unresolved", f"{codes('quarantine')} AS quarantined",
    )


def repair_summary(r: Repair) -> DataFrame:
    """One row per episode: row counts, segments, issue counts and scores before and after, code lists."""
    keys = list(r.layout.keys)
    sums = r.rows.groupBy(*keys).agg(
        F.expr("count(1) AS source_rows"),
        F.expr("count_if(repair_actions <> '') AS modified_rows"),
        F.expr("sum(cells_missing_values) AS interpolated_cells"),
        F.expr("sum(cells_joint_jump) AS joint_jump_cells"),
        F.expr(f"count_if({hit('SENSOR_DESYNC')}) AS sync_corrected_rows"),
        F.expr("max(segment_id) + 1 AS segment_count"),
        F.expr("count_if(NOT quality_valid) AS quarantined_rows"),
        F.expr("count_if(quality_valid) AS retained_rows"),
    )
    old = r.before.selectExpr(*keys, "issue_count AS before_issue_count", "quality_score AS before_quality_score", "issue_codes AS _before")
    new = r.after.selectExpr(*keys, "issue_count AS after_issue_count", "quality_score AS after_quality_score", "issue_codes AS _after")
    return sums.join(old, keys).join(new, keys).selectExpr(
        *keys,
        "if(quarantined_rows > 0 OR after_issue_count > 0, 'review_required', 'ready') AS status",
        *[c for c in sums.columns if c not in keys],
        "(rint((retained_rows / source_rows * 100) * 100D) / 100D + 0D) AS retained_rate",
        "before_issue_count", "after_issue_count", "before_quality_score", "after_quality_score",
        "array_join(array_sort(array_except(_before, _after)), ';') AS resolved_issues",
        "array_join(_after, ';') AS unresolved_issues",
    )


def repair_preview(r: Repair, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first changed rows per episode, with old and new value of each changed channel."""
    w = Window.partitionBy(*r.layout.keys).orderBy("seq")
    first = r.dealt.filter("repair_actions <> ''").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows)
    cells = ", ".join(
        f"if(bround(`{c}__original`, 8) <=> bround(`{c}`, 8), NULL, named_struct('channel', '{c}', 'before', bround(cast(`{c}__original` AS DOUBLE), 8), 'after', bround(cast(`{c}` AS DOUBLE), 8)))"
        for c in sorted(r.signals)
    )
    return first.selectExpr(
        *r.layout.keys, "source_row", "(rint(timestamp * 10000D) / 10000D + 0D) AS timestamp", "quality_valid", "repair_actions",
        f"array_compact(array({cells})) AS changes",
    )


def batch_totals(summary: DataFrame) -> DataFrame:
    """Totals over the dataset; an empty one has zeros and is ready."""
    return summary.selectExpr(
        "count(1) AS episode_count", *[f"coalesce(sum({c}), 0) AS {c}" for c in ("source_rows", "modified_rows", "quarantined_rows", "retained_rows")],
        "coalesce((rint((sum(retained_rows) / greatest(1, sum(source_rows)) * 100) * 100D) / 100D + 0D), 0D) AS retained_rate",
        "if(sum(quarantined_rows) > 0 OR sum(after_issue_count) > 0, 'review_required', 'ready') AS status",
    )


def batch_summary(summary: DataFrame, actions: DataFrame, resolution: DataFrame) -> DataFrame:
    """One row for the dataset: totals, what each action did, most rows first, and how often each issue was resolved or stayed.

    The three come from one repair. Code tables are bounded, so their lists are.
    """
    done = batch_actions(actions).agg(F.expr("array_sort(collect_list(struct(-row_count AS _order, code, episode_count, row_count))) AS a")).selectExpr(
        "transform(a, x -> struct(x.code, x.episode_count, x.row_count)) AS actions"
    )
    counted = "array_sort(collect_list(struct(code, episode_count)) FILTER (WHERE outcome = '{0}')) AS {0}"
    outcomes = batch_resolution(resolution).agg(*[F.expr(counted.format(o)) for o in ("resolved", "unresolved")])
    return batch_totals(summary).crossJoin(F.broadcast(done)).crossJoin(F.broadcast(outcomes))


def batch_actions(actions: DataFrame) -> DataFrame:
    out = actions.groupBy("code").agg(F.count(F.lit(1)).alias("episode_count"), F.sum("row_count").alias("row_count"))
    return out.orderBy(F.desc("row_count"), "code")


def batch_resolution(resolution: DataFrame) -> DataFrame:
    """How often each issue code was resolved or stayed."""
    long = resolution.selectExpr("'resolved' AS outcome", "explode(resolved) AS code").unionByName(
        resolution.selectExpr("'unresolved' AS outcome", "explode(unresolved) AS code")
    )
    return long.groupBy("outcome", "code").agg(F.count(F.lit(1)).alias("episode_count"))
