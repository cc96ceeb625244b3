"""Step tables: column roles, validation, projections and row filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions.columns import any_of, finite, numeric
from trajspark.functions.layout import Layout
from trajspark.profiles import Profile

BOOKKEEPING = ("timestamp", "seq")
# Channels that may be repaired besides joint_*, state_* and action_*.
REPAIRABLE = ("ee_x", "ee_y", "ee_z", "camera_motion", "force_x", "force_y", "force_z", "gripper", "object_distance")
REPAIRABLE_FAMILIES = ("joint_", "state_", "action_")
IDLE_PHASES = ("idle", "reset")
PREFERRED_SIGNALS = ("ee_x", "ee_y", "ee_z", "camera_motion", "force_z", "gripper", "object_distance", "reward")


def by_suffix(names: list[str]) -> list[str]:
    """Channels in the order of their number."""
    return sorted(names, key=lambda n: int(re.search(r"(\d+)$", n).group(1)) if re.search(r"(\d+)$", n) else 0)


@dataclass(frozen=True)
class Roles:
    """What the columns of a step table mean, read once from its schema."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    joints: tuple[str, ...]
    states: tuple[str, ...]
    actions: tuple[str, ...]
    positions: tuple[str, ...]

    def has(self, *names: str) -> bool:
        return all(n in self.columns for n in names)

    @property
    def motion(self) -> tuple[str, ...]:
        return self.positions if len(self.positions) >= 2 else self.joints

    @property
    def signals(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c in REPAIRABLE or c.startswith(REPAIRABLE_FAMILIES))


def resolve_roles(df: DataFrame) -> Roles:
    # Columns named meta_* travel with the rows and are never signals.
    kinds = {f.name: f.dataType for f in df.schema.fields if not f.name.startswith("meta_")}
    names = list(kinds)
    family = lambda prefix: tuple(n for n in names if n.startswith(prefix) and not n.endswith("__original"))
    return Roles(
        columns=tuple(names),
        numeric=tuple(n for n in names if isinstance(kinds[n], T.NumericType) and n not in BOOKKEEPING),
        joints=family("joint_"),
        states=family("state_"),
        actions=family("action_"),
        positions=tuple(n for n in ("ee_x", "ee_y", "ee_z") if n in kinds),
    )


def validate_steps(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Require the key columns, make the time numeric, drop rows without a time, make the id a string.

    A position ``seq`` is made dense again after that. Without a layout the longest episode is counted for it.
    """
    missing = sorted({"timestamp", "episode_id"} - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    out = df.withColumns({"timestamp": finite("timestamp"), "episode_id": F.col("episode_id").cast("string")})
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name != "timestamp"]
    out = out.withColumns({c: F.expr(f"if(isnan(`{c}`), NULL, `{c}`)") for c in floats})
    out = out.filter(F.col("timestamp").isNotNull())
    return renumber(out, layout or Layout.probe(out)) if "seq" in out.columns else out


def renumber(df: DataFrame, layout: Layout) -> DataFrame:
    """Make ``seq`` dense again after rows were dropped."""
    if layout.whole:
        return layout.local(df, lambda w: {"seq": (F.row_number().over(w) - 1).cast("long")})
    return layout.running(df, {"_upto": F.lit(1)}).withColumn("seq", F.col("_upto") - 1).drop("_upto")


def filter_episode(df: DataFrame, episode_id: str) -> DataFrame:
    """The rows of one episode; an unknown one is an error, found by a job that ends with the first row."""
    return require_rows(df.filter(F.col("episode_id") == str(episode_id)), f"no episode {episode_id}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def active_phase(roles: Roles) -> Column:
    if not roles.has("phase"):
        return F.lit(True)
    return F.coalesce(~F.lower(F.col("phase").cast("string")).isin(*IDLE_PHASES), F.lit(True))


def training_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("quality_valid")


def outside(column: str, profile: Profile) -> Column:
    low, high = profile.workspace[column]
    return F.coalesce((numeric(column) < low) | (numeric(column) > high), F.lit(False))


def outside_workspace(df: DataFrame, profile: Profile) -> DataFrame:
    return df.filter(any_of([outside(c, profile) for c in profile.workspace if c in df.columns]))


def chart_columns(roles: Roles) -> list[str]:
    picked = [c for c in PREFERRED_SIGNALS if roles.has(c)]
    return picked + list(roles.joints[:6]) + list(roles.states[:6]) + list(roles.actions[:6])


def chart_series(df: DataFrame) -> DataFrame:
    """The signals that a chart shows: preferred ones and the first six of each family."""
    chosen = chart_columns(resolve_roles(df))
    keep = [c for c in ("phase",) if c in df.columns]
    return df.select(
        "episode_id", "seq", F.round("timestamp", 4).alias("timestamp"), *keep,
        *[F.round(numeric(c), 5).alias(c) for c in chosen],
    )


def long_signals(df: DataFrame, channels: list[str]) -> DataFrame:
    """One row per (step, channel)."""
    typed = df.select("episode_id", "seq", "timestamp", *[numeric(c).alias(c) for c in channels])
    return typed.unpivot(["episode_id", "seq", "timestamp"], channels, "channel", "value")
