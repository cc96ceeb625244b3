"""Episode scores, grades, causes, and the dataset roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.columns import count_if, round_even
from trajspark.functions.layout import Layout
from trajspark.operators.detect import (
    ISSUE_TYPES,
    Diagnosis,
    inspect_steps,
    issue_array,
    issue_rows,
    severity_rank,
)
from trajspark.profiles import Profile

DIMENSIONS = ("completeness", "temporal", "motion", "sync", "safety")
# Weights of the dimensions, grade limits, histogram bins.
WEIGHTS = {"completeness": 0.22, "temporal": 0.20, "motion": 0.20, "sync": 0.18, "safety": 0.20}
GRADES = (("A", 90.0), ("B", 78.0), ("C", 65.0), ("D", None))
BINS = (("90-100", 90.0), ("78-89", 78.0), ("65-77", 65.0), ("0-64", None))


def _capped(penalty: str) -> str:
    return f"(rint((greatest(0D, 100D - least(100D, cast({penalty} AS DOUBLE)))) * 10D) / 10D + 0D)"


# SQL over the figures of an episode.
DIMENSION_SQL = {
    "completeness": _capped("missing_rate * 1200"),
    "temporal": _capped("backwards_rows * 20 + gap_rows * 12 + greatest(0D, jitter - 0.08D) * 80"),
    "motion": _capped("jump_rows * 9 + stuck_segments * 42 + mismatch_segments * 35"),
    "sync": f"if(confidence >= 0.25, {_capped('abs(offset) * 350')}, 80D)",
    "safety": _capped("outside_samples * 8 + if(spike_rows > 0, 55 + least(30, spike_rows * 5), 0) + if(slipped, 62, 0)"),
}


def overall_score() -> str:
    """Unrounded score from the rounded dimensions and the number of critical issues (SQL)."""
    base = " + ".join(f"{d} * {w}D" for d, w in WEIGHTS.items()) + " - critical_count * 6"
    capped = f"if(critical_count > 0, least({base}, 79D), {base})"
    return f"greatest(0D, if(least({', '.join(DIMENSIONS)}) < 40, least({capped}, 69D), {capped}))"


def banded(value: Column, bands) -> Column:
    out = None
    for label, limit in bands:
        if limit is None:
            return out.otherwise(label)
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out


def root_causes() -> str:
    """Candidate causes in fixed order; a fallback when a labelled failure has none (SQL)."""
    candidates = [
        ("frames lost in capture", "high", "drop_rows > 0"),
        ("collision or contact", "high", "spike_rows > 0"),
        ("execution stalled", "high", "stuck_segments > 0"),
        ("gripper did not act", "high", "mismatch_segments > 0"),
        ("object slipped", "high", "slipped"),
        ("sensors out of step", "medium", "desynced"),
        ("unstable control", "medium", "jump_rows > 0"),
    ]

    def cause(label: str, level: str) -> str:
        return f"named_struct('label', '{label}', 'confidence', '{level}')"

    found = ", ".join(f"if({hit}, {cause(label, level)}, NULL)" for label, level, hit in candidates)
    unknown = " OR ".join(hit for _, _, hit in candidates)
    fallback = f"if(success_known AND NOT success AND NOT ({unknown}), {cause('task failed', 'low')}, NULL)"
    return f"array_compact(array({found}, {fallback}))"


def score_episodes(d: Diagnosis) -> DataFrame:
    """One row per episode: metrics, dimension scores, score, grade, causes and issues."""
    out = d.figures.withColumns({"issues": issue_array(d.roles, d.profile)} | {n: F.expr(e) for n, e in DIMENSION_SQL.items()})
    out = out.selectExpr(
        "*",
        "transform(issues, i -> i.code) AS issue_codes",
        "size(issues) AS issue_count",
        "size(filter(issues, i -> i.severity = 'critical')) AS critical_count",
        f"{root_causes()} AS root_causes",
    )
    out = out.selectExpr("*", f"{overall_score()} AS raw_score")
    bands = " ".join(f"WHEN raw_score >= {limit} THEN '{g}'" for g, limit in GRADES if limit is not None)
    return out.selectExpr(
        "*",
        "(rint(raw_score * 10D) / 10D + 0D) AS quality_score",
        f"CASE {bands} ELSE '{GRADES[-1][0]}' END AS grade",
        "(rint(greatest(0D, last_time - first_time) * 1000D) / 1000D + 0D) AS duration",
        "(rint(if(median_dt > 0, 1 / median_dt, 0D) * 100D) / 100D + 0D) AS sample_rate",
        "coalesce(try_element_at(root_causes, 1).label, 'nothing found') AS primary_cause",
        "try_element_at(issue_codes, 1) AS primary_issue_code",
    )


def episode_metrics(episodes: DataFrame, keys=("episode_id",)) -> DataFrame:
    return episodes.select(
        *keys, "rows", "duration", "sample_rate",
        round_even(F.col("missing_rate") * 100, 3).alias("missing_pct"),
        F.col("gap_rows").alias("timestamp_gaps"),
        round_even(F.col("jitter") * 100, 2).alias("jitter_pct"),
        round_even(F.col("offset") * 1000, 1).alias("sync_offset_ms"),
        round_even("confidence", 3).alias("sync_confidence"),
        F.col("jump_rows").alias("joint_jumps"), "stuck_segments",
        F.col("spike_rows").alias("force_spikes"), F.col("drop_rows").alias("frame_drops"),
    )


def diagnose(steps: DataFrame, profile: str | Profile | None = None, layout: Layout | None = None) -> DataFrame:
    """The full diagnosis, one row per episode. Without a layout each episode goes the way that its own length asks for."""
    parts = [(steps, layout)] if layout else Layout.split(steps)
    return reduce(DataFrame.unionByName, [score_episodes(inspect_steps(rows, profile, way)) for rows, way in parts])


# ---- dataset roll-up ------------------------------------------------------------------------------


def dataset_overview(episodes: DataFrame) -> DataFrame:
    known = F.col("success_known")
    return episodes.agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.sum("rows").alias("row_count"),
        round_even(F.avg("quality_score"), 1).alias("average_score"),
        round_even(F.avg(F.when(known, F.col("success").cast("int"))) * 100, 1).alias("success_rate"),
        count_if(known).alias("success_labeled_count"),
        count_if(F.col("critical_count") > 0).alias("critical_episodes"),
        count_if((F.col("critical_count") == 0) & (F.col("quality_score") >= 78)).alias("training_ready_episodes"),
    )


def _fixed_labels(episodes: DataFrame, label: Column, labels: list[str], name: str) -> DataFrame:
    """Counts per label, with zeros for labels that do not occur."""
    counted = episodes.agg(*[count_if(label == x).alias(x) for x in labels])
    return counted.unpivot([], labels, name, "episode_count")


def grade_distribution(episodes: DataFrame) -> DataFrame:
    return _fixed_labels(episodes, F.col("grade"), [g for g, _ in GRADES], "grade")


def score_histogram(episodes: DataFrame) -> DataFrame:
    return _fixed_labels(episodes, banded(F.col("quality_score"), BINS), [b for b, _ in BINS], "bin")


def issue_code_counts(episodes: DataFrame) -> DataFrame:
    counts = issue_rows(episodes).groupBy("code").agg(
        F.count(F.lit(1)).alias("episode_count"), F.sum("count").alias("sample_count"), F.min(severity_rank(F.col("severity"))).alias("rank")
    )
    level = F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.col("rank") + 1)
    titled = {
        name: F.create_map(*[F.lit(x) for row in ISSUE_TYPES for x in (row[0], row[at])])[F.col("code")] for name, at in (("category", 1), ("title", 3))
    }
    return counts.withColumns({"severity": level, **titled}).orderBy("rank", F.desc("episode_count"), "code").drop("rank")


def average_dimensions(episodes: DataFrame) -> DataFrame:
    return episodes.agg(*[round_even(F.avg(d), 1).alias(d) for d in DIMENSIONS])


def worst_episodes(episodes: DataFrame, k: int = 10) -> DataFrame:
    return episodes.orderBy("quality_score", F.desc("critical_count"), "episode_id").limit(k)


def audit_filter(episodes: DataFrame, text: str = "", grade: str = "all", issue: str = "all") -> DataFrame:
    """Search in id, cause and codes; filter by grade and by issue code (``clean`` = no issue)."""
    searchable = F.lower(F.concat_ws(" ", "episode_id", "primary_cause", F.concat_ws(" ", "issue_codes")))
    out = episodes
    if text.strip():
        out = out.filter(F.contains(searchable, F.lit(text.strip().lower())))
    if grade != "all":
        out = out.filter(F.col("grade") == grade)
    if issue == "clean":
        out = out.filter(F.size("issue_codes") == 0)
    elif issue != "all":
        out = out.filter(F.array_contains("issue_codes", issue))
    return out


def audit_order(episodes: DataFrame, order: str = "score-asc") -> DataFrame:
    orders = {
        "score-asc": [F.asc("quality_score")],
        "score-desc": [F.desc("quality_score")],
        "critical-desc": [F.desc("critical_count"), F.asc("quality_score")],
        # Natural order: text before the number, then the number.
        "episode-asc": [F.regexp_extract("episode_id", r"^(\D*)", 1), F.regexp_extract("episode_id", r"(\d+)", 1).try_cast("long"), F.col("episode_id")],
    }
    return episodes.orderBy(*orders[order])


def issue_dimension(spark) -> DataFrame:
    rows = [(code, category, title, advice) for code, category, _, title, advice in ISSUE_TYPES]
    return spark.createDataFrame(rows, "code string, category string, title string, recommendation string")


def any_critical(issues: str = "issues") -> Column:
    return F.exists(issues, lambda i: i["severity"] == "critical")
