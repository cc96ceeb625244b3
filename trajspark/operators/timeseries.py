"""Window and time-series operators over step tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.columns import count_if, finite, finite_sql, is_true, mad_threshold, norm, numeric_sql
from trajspark.functions.lagged import lag_correlations
from trajspark.functions.layout import Layout, range_buckets
from trajspark.operators.steps import Roles

DEFAULT_PERIOD = 0.02


# ---- time steps -----------------------------------------------------------------------------------


def step_interval(df: DataFrame, layout: Layout) -> DataFrame:
    """``dt``: time since the previous row in acquisition order; null on the first row."""
    return layout.local(df, lambda w: {"dt": F.col("timestamp") - F.lag("timestamp").over(w)}, before=1)


def positive(dt: str = "dt") -> Column:
    return F.when(F.col(dt) > 0, F.col(dt))


def with_period(df: DataFrame, layout: Layout) -> DataFrame:
    """``median_dt``: the median positive time step of the episode."""
    out = layout.with_quantiles(df, {"median_dt": (positive(), 0.5)})
    return out.withColumn("median_dt", F.coalesce("median_dt", F.lit(DEFAULT_PERIOD)))


def time_jitter() -> Column:
    """Aggregate: population deviation over mean of the positive time steps."""
    return F.coalesce(F.stddev_pop(positive()) / (F.avg(positive()) + 1e-9), F.lit(0.0))


def safe_interval() -> Column:
    return F.coalesce(positive(), F.col("median_dt"))


def gap_limit(profile) -> Column:
    period = F.col("median_dt")
    return F.greatest(period * profile.gap_period_multiplier, period + profile.gap_extra_seconds)


# ---- interpolation --------------------------------------------------------------------------------


def position_fill(name: str, order: str = "seq") -> str:
    """Linear between the nearest known rows by row position, nearest value at the edges (SQL)."""
    a, b = f"`{name}__prev`", f"`{name}__next`"
    return (
        f"CASE WHEN {a} IS NULL THEN {b}.v WHEN {b} IS NULL OR {a}.seq = {b}.seq THEN {a}.v "
        f"ELSE {a}.v + ({b}.v - {a}.v) * ((`{order}` - {a}.seq) / ({b}.seq - {a}.seq)) END"
    )


def interpolate_positional(
    df: DataFrame, layout: Layout, channels: Sequence[str], suffix: str = "__fill", also=None, before: int = 0, after: int = 0
) -> DataFrame:
    """Adds ``<channel>__fill``; ``also`` rides along as in :meth:`Layout.carry`."""
    kept = df.columns
    out = layout.with_anchors(df, {c: numeric_sql(c) for c in channels}, also=also, before=before, after=after)
    anchors = {f"{c}__{side}" for c in channels for side in ("prev", "next")}
    added = [c for c in out.columns if c not in anchors and c not in kept]
    return out.selectExpr(
        *[f"`{c}`" for c in [*kept, *added]], *[f"{position_fill(c, layout.order)} AS `{c}{suffix}`" for c in channels]
    )


def time_fill(a: Column, b: Column, t: Column) -> Column:
    """Linear in time between two points; the share stays in [0, 1] because clocks may run backwards."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - a["t"]) / (b["t"] - a["t"])))
    return a["v"] + (b["v"] - a["v"]) * share


def short_gap_interpolate(df: DataFrame, layout: Layout, channels: Sequence[str], max_gap: int = 3) -> DataFrame:
    """Fill gaps of at most ``max_gap`` rows that have known values and rising time on both sides. Infinite values are gaps.

    Adds ``<c>__original`` and the flags ``<c>__filled`` and ``<c>__open`` (missing and not filled).
    """
    out = layout.with_anchors(df, {c: finite_sql(c) for c in channels})
    for c in channels:
        a, b = F.col(f"{c}__prev"), F.col(f"{c}__next")
        missing = finite(c).isNull()
        fillable = is_true(missing & (b["seq"] - a["seq"] - 1 <= max_gap) & (b["t"] > a["t"]))
        out = out.withColumns(
            {
                f"{c}__original": F.col(c),
                f"{c}__filled": fillable,
                f"{c}__open": missing & ~fillable,
                f"{c}__value": F.when(fillable, time_fill(a, b, F.col("timestamp"))).otherwise(finite(c)),
            }
        )
    out = out.withColumns({c: F.col(f"{c}__value") for c in channels})
    return out.drop(*[f"{c}__{s}" for c in channels for s in ("prev", "next", "value")])


# ---- velocity -------------------------------------------------------------------------------------


def with_previous(df: DataFrame, layout: Layout, columns: Sequence[str]) -> DataFrame:
    return layout.local(df, lambda w: {f"{c}__lag": F.lag(c).over(w) for c in columns}, before=1)


def rate_sql(name: str) -> str:
    """Change per second of a filled channel; zero on the first row. Needs ``with_rates`` columns."""
    return f"if(dt IS NULL, 0D, (`{name}__fill` - `{name}__fill__lag`) / if(dt > 0, dt, median_dt))"


def _rate(name: str) -> Column:
    return F.expr(rate_sql(name))


def speed_sql(roles: Roles) -> str:
    """Speed of the tool position, else of the joints, else zero. Needs ``with_rates`` columns."""
    if not roles.motion:
        return "0D"
    return "sqrt(" + " + ".join(f"power({rate_sql(c)}, 2)" for c in roles.motion) + ")"


def with_rates(df: DataFrame, layout: Layout, channels: Sequence[str], previous: Sequence[str] = ()) -> DataFrame:
    """dt, median_dt, filled and previous values of the channels, and ``<c>__lag`` of other columns."""

    def steps_back(w):
        return {
            "dt": F.col("timestamp") - F.lag("timestamp").over(w),
            "next_time": F.lead("timestamp").over(w),
            **{f"{c}__lag": F.lag(c).over(w) for c in previous},
        }

    if channels:
        df = interpolate_positional(df, layout, channels, also=steps_back, before=1, after=1)
        df = layout.local(df, lambda w: {f"{c}__fill__lag": F.lag(f"{c}__fill").over(w) for c in channels}, before=1)
    else:
        df = layout.local(df, steps_back, before=1, after=1)
    return with_period(df, layout)


def with_speed(df: DataFrame, layout: Layout, roles: Roles) -> DataFrame:
    return with_rates(df, layout, roles.motion).withColumn("speed", F.expr(speed_sql(roles)))


def channel_velocity(df: DataFrame, layout: Layout, channels: Sequence[str]) -> DataFrame:
    """Absolute rate of change per channel, as ``<c>__rate``."""
    return with_rates(df, layout, channels).withColumns({f"{c}__rate": F.abs(_rate(c)) for c in channels})


def with_robust_thresholds(
    df: DataFrame, layout: Layout, values: Mapping[str, tuple[Column, float, float]], suffix: str = "__limit"
) -> DataFrame:
    """Per episode and value: max(floor, median + scale * 1.4826 * MAD). ``values``: name -> (value, scale, floor)."""
    out = layout.with_quantiles(df, {f"_med_{n}": (v, 0.5) for n, (v, _, _) in values.items()})
    out = layout.with_quantiles(
        out, {f"_mad_{n}": (F.abs(v - F.col(f"_med_{n}")), 0.5) for n, (v, _, _) in values.items()}
    )
    out = out.withColumns(
        {
            f"{n}{suffix}": mad_threshold(F.col(f"_med_{n}"), F.col(f"_mad_{n}"), scale, floor)
            for n, (_, scale, floor) in values.items()
        }
    )
    return out.drop(*[f"_{k}_{n}" for n in values for k in ("med", "mad")])


# ---- runs -----------------------------------------------------------------------------------------


def with_runs(df: DataFrame, layout: Layout, masks: Mapping[str, str], next_time: str = "next_time") -> DataFrame:
    """For each mask (SQL condition) add ``<name>``, ``<name>__from`` = start (seq, t) of the run that holds
    the row, and ``<name>__end``: whether the run ends here. ``next_time`` is the time of the next row."""
    out = df.withColumns({n: F.expr(f"coalesce({m}, false)") for n, m in masks.items()})
    # A run starts right after the last row outside it, or at the first row of the episode.
    after = {
        f"{n}__from": F.expr(f"if({n}, if(seq = 0, named_struct('seq', seq, 't', timestamp), NULL), named_struct('seq', seq + 1, 't', `{next_time}`))")
        for n in masks
    }
    return layout.carry(
        out, after, also=lambda w: {f"{n}__end": F.col(n) & ~F.lead(n, 1, False).over(w) for n in masks}, after=1
    )


def runs_of(df: DataFrame, layout: Layout, names: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The runs of ``with_runs``, one row each: kind, rows, start/end position and time."""
    entries = ", ".join(
        f"if({n}__end, named_struct('kind', '{n}', 'start_seq', {n}__from.seq, 'start_time', {n}__from.t), NULL)" for n in names
    )
    ends = df.selectExpr(
        *layout.keys, "seq AS end_seq", "timestamp AS end_time", *carry, f"inline(array_compact(array({entries})))"
    )
    return ends.select(
        *layout.keys, "kind", (F.col("end_seq") - F.col("start_seq") + 1).alias("rows"),
        "start_seq", "end_seq", "start_time", "end_time", *carry,
    )


def true_runs(df: DataFrame, layout: Layout, masks: Mapping[str, str], carry: Sequence[str] = ()) -> DataFrame:
    """Runs of true rows of any length."""
    if "next_time" not in df.columns:
        df = layout.local(df, lambda w: {"next_time": F.lead("timestamp").over(w)}, after=1)
    return runs_of(with_runs(df, layout, masks), layout, list(masks), carry)


def contiguous_segments(runs: DataFrame, min_duration: Column) -> DataFrame:
    """Runs of at least two rows that last long enough."""
    return runs.filter((F.col("rows") >= 2) & (F.col("end_time") - F.col("start_time") >= min_duration))


def longest_segment(runs: DataFrame, layout: Layout) -> DataFrame:
    span = F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))
    return runs.groupBy(*layout.keys, "kind").agg(F.max(span).alias("longest"))


def dilate(df: DataFrame, layout: Layout, flag: str, reach: int = 1) -> DataFrame:
    """Extend flagged rows by ``reach`` rows on both sides, as ``<flag>__wide``."""
    return layout.local(
        df, lambda w: {f"{flag}__wide": F.max(flag).over(w.rowsBetween(-reach, reach))}, before=reach, after=reach
    )


def segment_ids(df: DataFrame, layout: Layout, profile) -> DataFrame:
    """``segment_id`` counts the boundaries passed: time that does not rise, or a gap. Needs dt and median_dt."""
    boundary = is_true((F.col("dt") <= 0) | (F.col("dt") > gap_limit(profile)))
    out = layout.running(df.withColumn("boundary", boundary), {"segment_id": F.col("boundary").cast("int")})
    return out.withColumn("segment_id", F.col("segment_id").cast("int"))


# ---- spikes ---------------------------------------------------------------------------------------


def isolated_spike_repair(df: DataFrame, layout: Layout, joints: Sequence[str], profile) -> DataFrame:
    """Replace single rows that jump away and straight back; adds ``<joint>__spike``. Needs dt, median_dt."""
    kept = df.columns
    out = interpolate_positional(df, layout, joints)
    out = layout.local(
        out,
        lambda w: {
            "_t0": F.lag("timestamp").over(w),
            "_t2": F.lead("timestamp").over(w),
            **{f"{c}__fill__lag": F.lag(f"{c}__fill").over(w) for c in joints},
            **{f"{c}__fill__lead": F.lead(f"{c}__fill").over(w) for c in joints},
        },
        before=1,
        after=1,
    )
    out = with_robust_thresholds(
        out,
        layout,
        {c: (F.abs(_rate(c)), profile.joint_velocity_mad_scale, profile.joint_velocity_floor) for c in joints},
    )
    ahead = F.col("_t2") - F.col("timestamp")
    ahead = F.when(ahead > 0, ahead).otherwise(F.col("median_dt"))
    span = F.col("_t2") - F.col("_t0")
    share = F.when(span > 0, (F.col("timestamp") - F.col("_t0")) / span).otherwise(0.5)
    new = {}
    for c in joints:
        left, right, limit = F.col(f"{c}__fill__lag"), F.col(f"{c}__fill__lead"), F.col(f"{c}__limit")
        came, left_by = _rate(c), (right - F.col(f"{c}__fill")) / ahead
        spike = is_true(
            left.isNotNull() & right.isNotNull()
            & (F.abs(came) > limit) & (F.abs(left_by) > limit) & (came * left_by < 0)
        )
        new[f"{c}__spike"] = spike
        new[c] = F.when(spike, left + share * (right - left)).otherwise(F.col(c))
    return out.select(
        *[new[c].alias(c) if c in new else F.col(c) for c in kept], *[new[f"{c}__spike"].alias(f"{c}__spike") for c in joints]
    )


# ---- lagged correlation ---------------------------------------------------------------------------


def lag_limit(max_lag_seconds: float) -> Column:
    """Aggregate-free expression over episode figures ``median_dt`` and ``n``."""
    return F.least(
        F.floor(F.lit(max_lag_seconds) / F.col("median_dt")), F.floor(F.col("n") / 3)
    ).cast("int")


def sync_offset(
    df: DataFrame, layout: Layout, robot: str, sensor: str, max_lag_seconds: float, most_rows: int | None = None
) -> DataFrame:
    """Best lag of a sensor behind the robot, one row per episode: lag, offset (s), confidence.

    ``df`` needs ``median_dt``; gaps in both signals are filled first. Positive means the sensor is later. Every episode is searched
    as far as its own period asks, and no further than ``most_rows`` if given.
    """
    rows = layout.with_figures(
        df.select(*layout.keys, "seq", "timestamp", "median_dt", finite(robot).alias("_robot"), finite(sensor).alias("_sensor")),
        {
            "n": F.count(F.lit(1)), "_both": count_if(F.col("_robot").isNotNull() & F.col("_sensor").isNotNull()),
            "_robot0": F.avg("_robot"), "_sensor0": F.avg("_sensor"),
        },
    )
    fill = layout.whole  # the search fills gaps itself, which takes two sorts less; the figures have brought the rows together
    if not fill:
        rows = interpolate_positional(rows, layout, ["_robot", "_sensor"])
    rows = rows.filter((F.col("_both") >= 20) & (F.col("median_dt") > 0))
    limit = lag_limit(max_lag_seconds) if most_rows is None else F.least(lag_limit(max_lag_seconds), F.lit(most_rows))
    signals = ("_robot", "_sensor") if fill else ("_robot__fill", "_sensor__fill")
    found = lag_correlations(rows, layout, *signals, -limit, limit, (F.col("_robot0"), F.col("_sensor0")), fill)
    found = found.filter((F.col("pairs") >= 10) & F.col("r").isNotNull() & ~F.isnan("r"))
    best = found.groupBy(*layout.keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("back"))).alias("_best"))
    return best.select(
        *layout.keys, (-F.col("_best.back")).alias("lag"), F.greatest(F.lit(0.0), F.col("_best.r")).alias("confidence")
    )


# ---- shifted sampling and thinning ----------------------------------------------------------------


def sample_at(df: DataFrame, layout: Layout, column: str, offset: Column, when: str = "true") -> DataFrame:
    """``<column>__shifted``: the channel at time + offset, linear between known samples; null outside them, and in episodes for
    which ``when`` (SQL, one value for an episode) is false: their samples are not put among the targets.

    Samples and targets are ordered together by time, in sampled ranges of rows when episodes are long: a clock that stands
    still or leaps makes no range larger.
    """
    target = "named_struct('_time', timestamp + _offset, '_kind', 1, '_value', cast(NULL AS DOUBLE))"
    sample = f"named_struct('_time', timestamp, '_kind', 0, '_value', {numeric_sql(column)})"
    sides = f"inline(if({when}, array({sample}, {target}), array({target})))"
    both = df.withColumn("_offset", offset).selectExpr("*", sides).drop("_offset")
    both = both.withColumn("_at", F.struct("_time", "_kind", layout.order))
    if not layout.whole:
        both = range_buckets(both, [*layout.keys, "_time", "_kind", layout.order])
    by_time = replace(layout, order="_at", bucket=None if layout.whole else "_bucket")
    found = by_time.with_anchors(both, {"_s": "_value"}, time="_time").filter("_kind = 1")
    a, b = F.col("_s__prev"), F.col("_s__next")
    value = F.when(a["t"] == F.col("_time"), a["v"]).when(a.isNotNull() & b.isNotNull(), time_fill(a, b, F.col("_time")))
    return found.select(*df.columns, value.alias(f"{column}__shifted"))


def downsample(df: DataFrame, layout: Layout, max_points: int = 800) -> DataFrame:
    """Every k-th row, k = ceil(rows / max_points)."""
    out = layout.with_figures(df, {"_n": F.count(F.lit(1))})
    return out.withColumn("downsample_step", F.ceil(F.col("_n") / max_points)).filter(
        F.col("seq") % F.col("downsample_step") == 0
    ).drop("_n")


def path_length(df: DataFrame, layout: Layout, axes: Sequence[str], until: Column | None = None) -> DataFrame:
    """Length of the path through the points, up to a time."""
    if until is not None:
        df = df.filter(F.col("timestamp") <= until + 1e-9)
    rows = with_previous(df, layout, axes)
    return rows.groupBy(*layout.keys).agg(
        F.coalesce(F.sum(norm([F.col(c) - F.col(f"{c}__lag") for c in axes])), F.lit(0.0)).alias("path_length")
    )
