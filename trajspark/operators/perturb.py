"""Fault injection on tables: a base crossed with a grid of faults, every choice a function of the row's keys.

A base has one row per step (``base_id``, ``seq``, channels). The grid has one row per (seed, fault, level).
Noise and fault places come from integer arithmetic on the keys, so a lost task gives the same rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.layout import Layout

# Faults with their levels, and the noise of each channel.
DETECTION_FAULTS = (
    # name, issue code, values
    ("sensor-delay", "SENSOR_DESYNC", (0.10, 0.16, 0.24)),
    ("force-spike", "FORCE_SPIKE", (42.0, 55.0, 75.0)),
    ("joint-jump", "JOINT_JUMP", (0.09, 0.18, 0.35)),
    ("timestamp-gap", "TIMESTAMP_GAP", (0.08, 0.16, 0.28)),
    ("frame-drop", "FRAME_DROP", (4.0, 7.0, 12.0)),
    ("robot-stuck", "ROBOT_STUCK", (1.4, 2.0, 2.8)),
    ("grasp-slip", "GRASP_SLIP", (0.13, 0.18, 0.24)),
)
REPAIR_FAULTS = (
    # name, action code, values, how the repair is judged
    ("short-gap", "MISSING_VALUES", (1.0, 2.0, 3.0), "reconstruction"),
    ("joint-spike", "JOINT_JUMP", (0.09, 0.18, 0.35), "reconstruction"),
    ("sensor-delay", "SENSOR_DESYNC", (0.10, 0.16, 0.24), "synchronization"),
    ("timestamp-gap", "TIMESTAMP_SEGMENT", (0.08, 0.16, 0.28), "segmentation"),
    ("force-spike", "FORCE_SPIKE", (42.0, 55.0, 75.0), "isolation"),
)
SAMPLE_KEYS = ("base_id", "episode_id")  # the base first: windows over samples run where their base lies
LEVELS = ("mild", "medium", "severe")
NOISE = {"joint_1": 0.00035, "joint_2": 0.00035, "ee_x": 0.00005, "force_z": 0.08, "camera_motion": 0.0004}
MODULUS = 2147483647


@dataclass(frozen=True)
class Grid:
    """The faults to inject into bases sampled every ``period`` seconds."""

    faults: tuple
    seeds: int
    period: float

    def rows(self) -> list[tuple]:
        """(seed, fault number, fault, level, value, lag in rows, width in rows); fault 0 is nominal."""
        out = []
        for seed in range(self.seeds):
            out.append((seed, 0, "nominal", "none", 0.0, 0, 0))
            for no, fault in enumerate(self.faults, start=1):
                for level, value in zip(LEVELS, fault[2]):
                    out.append((seed, no, fault[0], level, value, self.lag(fault[0], value), self.width(fault[0], value)))
        return out

    def lag(self, fault: str, value: float) -> int:
        return max(1, round(value / self.period)) if fault == "sensor-delay" else 0

    def width(self, fault: str, value: float) -> int:
        if fault in ("frame-drop", "short-gap"):
            return int(round(value))
        if fault == "robot-stuck":
            return max(3, round(value / self.period))
        if fault == "force-spike":
            return max(4, round(0.12 / self.period))
        if fault == "grasp-slip":
            return max(3, round(0.2 / self.period))
        return 1

    @property
    def lags(self) -> list[int]:
        return sorted({row[5] for row in self.rows() if row[5]})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "seed bigint, fault_no bigint, fault string, level string, value double, lag_rows int, width bigint")


# ---- expressions (the same text runs in other SQL engines) ----------------------------------------

CHOICE = "(base_no * 7919 + seed * 104729 + fault_no * 1299709 + cast(floor(value * 1000) AS BIGINT) * 15485863) % 1000003"
FIRST = "greatest(20, cast(floor(n * 0.42e0) AS BIGINT))"
# Start of the fault: between 42 % and 72 % of the run, leaving room for its width.
PLACE = f"{FIRST} + pick % greatest(1, cast(floor(n * 0.72e0) AS BIGINT) - width - {FIRST})"
IN_WINDOW = "seq >= place AND seq < place + width"


def gauss(channel_no: int) -> str:
    """A standard normal number from the row's keys (Box-Muller over two steps of a congruential sequence)."""
    a = f"((seq % 1000003) * 7919 + pick * 104729 + {channel_no} * 1299709 + 12345) * 48271 % {MODULUS}"
    return f"sqrt(-2e0 * ln((({a}) + 1) / {MODULUS + 1}e0)) * cos(6.283185307179586e0 * ((({a}) * 69621 % {MODULUS}) / {MODULUS}e0))"


def noisy(channel: str) -> str:
    return f"{channel} + {NOISE[channel]:.5f}e0 * ({gauss(sorted(NOISE).index(channel) + 1)})"


SIGN = "CASE WHEN pick % 2 = 0 THEN 1 ELSE -1 END"
WAVE = "(1 + 0.08e0 * sin(3.141592653589793e0 * (seq - place) / greatest(1, width - 1)))"


def injected(joints: tuple[str, str] = ("joint_1", "joint_2")) -> dict[str, str]:
    """Channel -> expression over noisy channels and the sample's fault. ``held_*`` and ``after_*`` are the
    noisy values at the start and the end of a stall; ``cam_delayed`` is the delayed camera channel."""
    out = {}
    for i, joint in enumerate(joints):
        mine = f"(cast(floor(pick / 2) AS BIGINT) % 2 = {i} AND {IN_WINDOW})"
        out[joint] = (
            f"CASE WHEN fault IN ('joint-jump', 'joint-spike') AND {mine} THEN {joint} + value * ({SIGN}) WHEN fault = 'short-gap' AND {mine} THEN NULL "
            f"ELSE {_stall(joint)} END"
        )
    out["ee_x"] = _stall("ee_x")
    out["camera_motion"] = f"CASE WHEN fault = 'sensor-delay' THEN cam_delayed WHEN fault = 'frame-drop' AND {IN_WINDOW} THEN NULL ELSE camera_motion END"
    out["force_z"] = f"CASE WHEN fault = 'force-spike' AND {IN_WINDOW} THEN value * {WAVE} ELSE force_z END"
    out["timestamp"] = "CASE WHEN fault = 'timestamp-gap' AND seq > place THEN timestamp + value ELSE timestamp END"
    out["frame_valid"] = f"CASE WHEN fault = 'frame-drop' AND {IN_WINDOW} THEN 0 ELSE frame_valid END"
    out["gripper"] = f"CASE WHEN fault = 'grasp-slip' AND {IN_WINDOW} THEN 0.18e0 ELSE gripper END"
    ramp = "0.105e0 + (value - 0.105e0) * (seq - place) / greatest(1, width - 1)"
    out["object_distance"] = f"CASE WHEN fault = 'grasp-slip' AND seq >= place + width THEN value WHEN fault = 'grasp-slip' AND {IN_WINDOW} THEN {ramp} ELSE object_distance END"
    out["phase"] = f"CASE WHEN fault = 'robot-stuck' AND {IN_WINDOW} THEN 'transport' ELSE phase END"
    out["success"] = "fault = 'nominal'"
    return out


def _stall(channel: str) -> str:
    """Hold the value through the window, then go on from it without a jump."""
    return (
        f"CASE WHEN fault = 'robot-stuck' AND {IN_WINDOW} THEN held_{channel} "
        f"WHEN fault = 'robot-stuck' AND seq >= place + width THEN {channel} + held_{channel} - after_{channel} ELSE {channel} END"
    )


STALLED = ("ee_x", "joint_1", "joint_2")


def select_base(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Check the channels that a benchmark base needs; all frames are valid and the outcome is a success."""
    missing = sorted(set(required) - set(df.columns))
    if missing or not any(c.startswith("joint_") for c in df.columns):
        raise ValueError(f"a benchmark base needs joints and {', '.join(missing)}")
    return df.withColumns({"frame_valid": F.lit(1), "success": F.lit(True)})


def grid_samples(base: DataFrame, grid: Grid, layout: Layout) -> DataFrame:
    """Base rows crossed with the grid (a table of fixed size): one sample per base, seed, fault and level.

    The bases are dealt to as many tasks as their samples need; the samples stay there under ``SAMPLE_KEYS``, so no copy is shuffled.
    """
    base = layout.spread(base, "base_id", len(grid.rows()))
    base = layout.with_figures(base, {"n": F.count(F.lit(1))})
    base = layout.local(base, lambda w: {f"cam_lag_{k}": F.lag("camera_motion", k).over(w) for k in grid.lags}, before=max(grid.lags, default=0))
    base = layout.with_figures(base, {"cam_first": F.min_by("camera_motion", "seq")})
    rows = base.crossJoin(F.broadcast(grid.table(base.sparkSession))).selectExpr("*", f"{CHOICE} AS pick")
    lags = " ".join(f"WHEN {k} THEN coalesce(cam_lag_{k}, cam_first)" for k in grid.lags)
    delayed = f"CASE lag_rows {lags} ELSE camera_motion END" if lags else "camera_motion"
    return rows.selectExpr(
        "concat_ws('/', base_id, seed, fault, level) AS episode_id", "base_id", "seed", "fault", "level", "value", "width", "pick", "cast(floor(pick / 2) AS BIGINT) % 2 AS pick_joint", f"{PLACE} AS place",
        *[c for c in base.columns if not c.startswith("cam_") and c not in ("base_id", *NOISE)], *NOISE, f"{delayed} AS cam_delayed",
    )


def add_noise(samples: DataFrame) -> DataFrame:
    """Gaussian noise per channel; the delayed camera channel gets the camera's noise."""
    return samples.selectExpr(
        *[c for c in samples.columns if c not in (*NOISE, "cam_delayed")],
        *[f"{noisy(c)} AS {c}" for c in NOISE], f"{noisy('camera_motion').replace('camera_motion', 'cam_delayed', 1)} AS cam_delayed",
    )


def inject(samples: DataFrame, layout: Layout) -> DataFrame:
    """Apply each sample's fault. ``layout`` is that of the samples, keyed by ``SAMPLE_KEYS``."""
    at = lambda c, when: F.max(F.expr(f"if(seq = {when}, {c}, NULL)"))
    figures = {f"held_{c}": at(c, "place") for c in STALLED} | {f"after_{c}": at(c, "place + width") for c in STALLED}
    rows = layout.with_figures(samples, figures)
    changed = injected()
    keep = [c for c in samples.columns if c not in changed and c not in ("cam_delayed", "n", "pick")]
    return rows.selectExpr(*keep, *[f"{e} AS {c}" for c, e in changed.items()])


def inject_visual_fault(frames: DataFrame, layout: Layout, kind: str, start: int, width: int, delay: int = 4, pixels: str = "pixels") -> DataFrame:
    """Faults on grey frames: ``sensor-delay`` shows the frame ``delay`` rows earlier, ``frame-drop`` repeats the
    last good frame, ``camera-occlusion`` shows a flat one. Adds ``frame_valid``."""
    inside = F.col("seq").between(start, start + width - 1)
    if kind == "sensor-delay":
        out = layout.local(frames, lambda w: {"_old": F.lag(pixels, delay).over(w)}, before=delay)
        out = layout.with_figures(out, {"_first": F.min_by(pixels, "seq")})
        return out.withColumns({pixels: F.coalesce("_old", "_first"), "frame_valid": F.lit(1)}).drop("_old", "_first")
    if kind == "frame-drop":
        out = layout.with_figures(frames, {"_good": F.max_by(pixels, F.when(F.col("seq") == start - 1, F.col("seq")))})
        new = F.when(inside, F.col("_good")).otherwise(F.col(pixels))
        return out.withColumns({pixels: new, "frame_valid": F.when(inside, 0).otherwise(1)}).drop("_good")
    if kind == "camera-occlusion":
        flat = F.transform(pixels, lambda x: F.lit(12.0))
        return frames.withColumns({pixels: F.when(inside, flat).otherwise(F.col(pixels)), "frame_valid": F.when(inside, 0).otherwise(1)})
    raise ValueError(f"unknown visual fault {kind}")
