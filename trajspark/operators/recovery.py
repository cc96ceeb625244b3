"""Paired recovery experiments: one run with a fault, one with the fault and a recovery policy.

Replay documents are flattened to three tables: ``runs`` (one row per run), ``frames`` (one row per time
step, position ``seq``) and ``events`` (place ``ord`` in the document). Keys: scenario, seed, variant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.columns import count_if, round_even
from trajspark.functions.layout import Layout
from trajspark.functions.lineage import materialise

KEYS = ("scenario", "seed", "variant")
PAIR = ["scenario", "seed"]
FORCE_LIMIT = 36.0
# The injected fault and the ordered recovery plan (operator: evidence) of each scenario.
FAULTS = {"collision": "collision-command", "gripper-failure": "gripper-failure", "grasp-slip": "grasp-slip-force"}
PLANS = {
    "collision": (
        ("EmergencyStop", "event"), ("RetreatToSafePose", "recovery_retreat"), ("ReobserveObstacle", "recovery_reobserve"),
        ("ReplanCollisionFreePath", "recovery_reach"), ("ForceGuardedRetry", "success_safe"),
    ),
    "gripper-failure": (
        ("HoldPosition", "event"), ("ReplanPregrasp", "recovery_reach"), ("RestoreGripperActuation", "gripper_restored"),
        ("CloseAndVerifyAttachment", "predicate"), ("ResumeTransport", "success"),
    ),
    "grasp-slip": (
        ("StopTransport", "event"), ("WaitForObjectSettlement", "recovery_hold"), ("RelocalizeObject", "recovery_reobserve"),
        ("ReplanPregrasp", "recovery_reach"), ("CloseAndVerifyAttachment", "predicate"), ("ResumeTransport", "success"),
    ),
}
CONTROLLED = ("env_id", "scenario", "seed", "steps", "fps", "width", "height")

REPLAY_SCHEMA = (
    "scenario string, seed bigint, variant string, fps int, rows bigint, duration double, success boolean, "
    "config struct<env_id: string, steps: int, width: int, height: int>, "
    "recovery struct<trigger_source: string, trigger_type: string, trigger_step: bigint>, "
    "timestamps array<double>, tcp array<array<double>>, object array<array<double>>, goal array<array<double>>, force array<double>, "
    "gripper array<double>, gripper_command array<double>, is_grasped array<int>, success_trace array<int>, phases array<string>, "
    "events array<struct<time: double, type: string, source: string, label: string>>"
)


@dataclass(frozen=True)
class Replays:
    runs: DataFrame
    frames: DataFrame
    events: DataFrame
    layout: Layout


def read_replays(spark: SparkSession, path: str, multi_line: bool = True) -> Replays:
    """Replay documents (one JSON per run) as runs, frames and events."""
    return flatten_replays(spark.read.schema(REPLAY_SCHEMA).json(path, multiLine=multi_line))


def flatten_replays(documents: DataFrame) -> Replays:
    keys = list(KEYS)
    runs = documents.select(*keys, "fps", "rows", "duration", "success", "config.*", "recovery.*")
    arrays = ["timestamps", "tcp", "object", "goal", "force", "gripper", "gripper_command", "is_grasped", "success_trace", "phases"]
    # A document may lack an array; it then gives nulls.
    known = documents.select(*keys, *[F.coalesce(a, F.array().cast(documents.schema[a].dataType)).alias(a) for a in arrays])
    frames = known.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("seq", "f"))
    point = lambda name: [F.get(F.col(f"f.{name}"), F.lit(i)).alias(f"{name}_{a}") for i, a in enumerate("xyz")]
    frames = frames.select(
        *keys, F.col("seq").cast("long").alias("seq"), F.col("f.timestamps").alias("timestamp"), *point("tcp"), *point("object"), *point("goal"),
        F.col("f.force").alias("force"), F.col("f.gripper").alias("gripper"), F.col("f.gripper_command").alias("gripper_command"),
        F.col("f.is_grasped").cast("boolean").alias("is_grasped"), F.col("f.success_trace").cast("boolean").alias("success_now"), F.col("f.phases").alias("phase"),
    )
    events = documents.select(*keys, F.posexplode("events").alias("ord", "e")).select(*keys, "ord", "e.*")
    return Replays(runs, frames, events, Layout.probe(frames, KEYS))


# ---- run facts ------------------------------------------------------------------------------------


def event_index(kind: str, fps: str = "fps") -> str:
    """Frame index of the first event of a type (SQL aggregate over events)."""
    return f"greatest(0L, cast(bround(min_by(time, ord) FILTER (WHERE type = '{kind}') * max({fps})) AS BIGINT))"


def run_facts(r: Replays) -> DataFrame:
    """Runs with the frame indexes of their events, the recovery start and the injected fault."""
    keys = list(KEYS)
    fault = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in FAULTS.items())
    marks = r.events.join(r.runs.select(*keys, "fps"), keys).groupBy(*keys).agg(
        *[F.expr(f"if(count_if(type = '{k}') > 0, {event_index(k)}, NULL) AS {n}") for k, n in
          (("predicate-violated", "violated_at"), ("predicate-restored", "restored_at"), ("recovery-start", "started_at"))],
        F.expr(f"min_by(struct(type, (rint(time * 10000D) / 10000D + 0D) AS time, label), ord) FILTER (WHERE source = 'injection' AND type = CASE scenario {fault} END) AS fault"),
    )
    out = r.runs.join(marks, keys, "left")
    return out.withColumn("start_at", F.coalesce(F.col("trigger_step"), F.col("started_at")))


def frame_at_time(frames: DataFrame, cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """The frame shown at a time: round(time * fps) within the run, then on to the last frame not later.

    ``cursors``: keys and ``time``; a run has few of them and they travel with its frames.
    """
    keys = list(KEYS)
    wanted = cursors.join(runs.select(*keys, "fps", "rows"), keys).selectExpr(
        *keys, "time", "greatest(0L, least(rows - 1, cast(bround(time * fps) AS BIGINT))) AS first_index"
    )
    pairs = frames.join(wanted, keys).filter((F.col("seq") == F.col("first_index")) | ((F.col("seq") > F.col("first_index")) & (F.col("timestamp") <= F.col("time"))))
    return pairs.groupBy(*keys, "time").agg(F.max("seq").alias("frame"), F.max_by("phase", "seq").alias("phase"), F.max_by("force", "seq").alias("force"))


def rolling_hold(frames: DataFrame, layout: Layout, trigger: str, width: int = 3) -> DataFrame:
    """First index at or after the trigger, in a recovery phase, that opens ``width`` frames within the force
    limit. ``trigger`` is a column of the frames."""
    rows = layout.local(
        frames,
        lambda w: {"_peak": F.max("force").over(w.rowsBetween(0, width - 1)), "_full": F.lead("seq", width - 1).over(w).isNotNull()},
        after=width - 1,
    )
    held = rows.filter(f"seq >= {trigger} AND startswith(phase, 'recovery_') AND _full AND _peak <= {FORCE_LIMIT}")
    return held.groupBy(*layout.keys).agg(F.min("seq").alias("restored_index"))


# ---- pair integrity -------------------------------------------------------------------------------


def signatures(r: Replays, facts: DataFrame) -> DataFrame:
    """What must be equal in both runs of a pair: controlled fields, fault and initial state."""
    keys = list(KEYS)
    first = r.frames.filter("seq = 0").selectExpr(
        *keys, *[f"array({', '.join(f'(rint({p}_{a} * 1000000D) / 1000000D + 0D)' for a in 'xyz')}) AS {p}_0" for p in ("tcp", "object", "goal")]
    )
    controlled = "struct(" + ", ".join(CONTROLLED) + ")"
    return facts.join(first, keys, "left").selectExpr(*keys, f"{controlled} AS controlled", "fault", "struct(tcp_0, object_0, goal_0) AS initial")


def pair_integrity(r: Replays, facts: DataFrame) -> DataFrame:
    """One row per pair: the three checks, the failed ones and a fingerprint of the failure run."""
    s = signatures(r, facts)
    side = lambda v: s.filter(F.col("variant") == v).selectExpr(*PAIR, *[f"{c} AS {v}_{c}" for c in ("controlled", "fault", "initial")])
    both = side("failure").join(side("recovered"), PAIR)
    checks = {
        "controlled_variables": "failure_controlled <=> recovered_controlled",
        "initial_state": "failure_initial <=> recovered_initial",
        "fault_signature": "failure_fault <=> recovered_fault AND failure_fault IS NOT NULL",
    }
    failed = ", ".join(f"if({c}, NULL, '{k}')" for k, c in checks.items())
    return both.selectExpr(
        *PAIR, *[f"({c}) AS {k}" for k, c in checks.items()], f"array_compact(array({failed})) AS failed_pair_checks",
        "substring(sha2(to_json(struct(failure_controlled AS controlled, failure_fault AS fault, failure_initial AS initial)), 256), 1, 16) AS fingerprint",
    ).selectExpr("*", "size(failed_pair_checks) = 0 AS pair_integrity")


def admit_seeds(results: DataFrame, scenarios: int = len(FAULTS)) -> tuple[DataFrame, DataFrame]:
    """Results of the seeds whose every scenario pair is sound, and the failed pairs of the other seeds."""
    whole = results.groupBy("seed").agg(F.bool_and("pair_integrity").alias("_ok"), F.count_distinct("scenario").alias("_n"))
    kept = whole.filter(F.col("_ok") & (F.col("_n") == scenarios)).select("seed")
    excluded = results.filter("NOT pair_integrity").select("seed", "scenario", "failed_pair_checks")
    return results.join(kept, "seed", "left_semi"), excluded


# ---- verdicts -------------------------------------------------------------------------------------


def _step_evidence(check: str) -> str:
    """Condition on a frame for a plan step (SQL)."""
    if check.startswith("recovery_"):
        return f"phase = '{check}'"
    return {
        "event": "seq = started_at",
        "gripper_restored": "gripper_command < -0.5 AND gripper < 0.65",
        "predicate": "restored AND seq = restored_at",
        "success": "success_now",
        "success_safe": f"success_now AND post_peak <= {FORCE_LIMIT}",
    }[check]


def run_figures(r: Replays, facts: DataFrame) -> DataFrame:
    """One row per run: summary, safety, restoration, plan steps and path lengths."""
    keys = list(KEYS)
    layout = r.layout
    # round() to 3 digits as in the summaries, then the interval both runs share.
    spans = facts.selectExpr(*keys, "(rint(duration * 1000D) / 1000D + 0D) AS duration_s")
    shared = spans.groupBy(*PAIR).agg(F.min("duration_s").alias("shared_s"))
    info = facts.join(shared, PAIR).selectExpr(
        *keys, "success AS run_success", "fps", "violated_at", "restored_at", "started_at", "shared_s",
        "if(variant = 'failure', 0L, coalesce(start_at, rows)) AS begin_at",
    )
    rows = layout.attach(r.frames, info, "inner")
    rows = layout.local(rows, lambda w: {f"_{a}": F.col(f"tcp_{a}") - F.lag(f"tcp_{a}").over(w) for a in "xyz"}, before=1)
    rows = layout.with_figures(
        rows,
        {
            "calm": F.expr(f"bool_and(force <= {FORCE_LIMIT}) FILTER (WHERE seq BETWEEN restored_at AND restored_at + 2)"),
            "held": F.expr("bool_or(is_grasped) FILTER (WHERE seq = restored_at)"),
        } if not layout.whole else {
            "calm": F.min(F.expr(f"if(seq BETWEEN restored_at AND restored_at + 2, force <= {FORCE_LIMIT}, NULL)")),
            "held": F.max(F.expr("if(seq = restored_at, is_grasped, NULL)")),
        },
    )
    restored = "coalesce(variant = 'recovered' AND run_success AND violated_at < begin_at AND begin_at <= restored_at AND if(scenario = 'collision', calm, held), false)"
    rows = rows.selectExpr("*", f"{restored} AS restored").selectExpr("*", "if(restored, restored_at, begin_at) AS post_at")
    rows = layout.with_figures(rows, {"post_peak": F.max(F.expr("if(seq >= post_at, force, NULL)"))})
    steps = max(len(p) for p in PLANS.values())
    rows = rows.withColumn("cursor_0", F.col("begin_at"))
    for i in range(steps):
        cases = " ".join(f"WHEN '{s}' THEN {_step_evidence(plan[i][1])}" for s, plan in PLANS.items() if i < len(plan))
        hit = F.expr(f"if(seq >= cursor_{i} AND (CASE scenario {cases} ELSE false END), seq, NULL)")
        rows = layout.with_figures(rows, {f"found_{i + 1}": F.min(hit)})
        rows = rows.withColumn(f"cursor_{i + 1}", F.coalesce(f"found_{i + 1}", f"cursor_{i}"))
    length = "sqrt(_x * _x + _y * _y + coalesce(_z * _z, 0D))"
    bad = f"(force IS NULL OR isnan(force) OR abs(force) = double('infinity') OR force > {FORCE_LIMIT})"
    sums = [
        "count(1) AS frames", "max(force) AS peak_force", "max(post_peak) AS post_peak", "bool_or(restored) AS restored", "max(begin_at) AS begin_at", "max(fps) AS fps",
        f"coalesce(sum({length}), 0D) AS path_length", f"coalesce(sum({length}) FILTER (WHERE timestamp <= shared_s + 1e-9), 0D) AS shared_path", "max(shared_s) AS shared_s",
        "count_if(is_grasped) AS grasped_frames", "max_by(is_grasped, seq) AS final_grasped",
        "min_by(timestamp, seq) FILTER (WHERE success_now AND seq >= begin_at) AS success_time",
        f"count_if({bad}) AS unsafe_frames", f"min_by(timestamp, seq) FILTER (WHERE {bad}) AS unsafe_time",
        f"count_if({bad} AND seq >= begin_at) AS unsafe_after", "count_if(seq >= begin_at) AS frames_after", "max(force) FILTER (WHERE seq >= begin_at) AS peak_after",
        f"min_by(timestamp, seq) FILTER (WHERE {bad} AND seq >= begin_at) AS unsafe_after_time",
        *[f"max(found_{i + 1}) AS found_{i + 1}" for i in range(steps)],
    ]
    return rows.groupBy(*keys).agg(*[F.expr(s) for s in sums])


def variant_summary(figures: DataFrame, facts: DataFrame) -> DataFrame:
    """Per run: outcome, duration, force peaks, path length, grasp."""
    keys = list(KEYS)
    return facts.select(*keys, "success", "rows", "duration").join(figures, keys).selectExpr(
        *keys, "success", "rows", "(rint(duration * 1000D) / 1000D + 0D) AS duration", "(rint(peak_force * 1000D) / 1000D + 0D) AS peak_force", "(rint(post_peak * 1000D) / 1000D + 0D) AS post_recovery_peak_force",
        "(rint(path_length * 10000D) / 10000D + 0D) AS path_length", "grasped_frames", "final_grasped",
    )


def force_safety(figures: DataFrame) -> DataFrame:
    """Whether every frame stays within the force limit, over the whole run and from the recovery start."""
    return figures.selectExpr(
        *KEYS, "frames > 0 AND unsafe_frames = 0 AS episode_safety", "unsafe_frames", "(rint(unsafe_time * 1000D) / 1000D + 0D) AS first_violation_time",
        "frames_after > 0 AND unsafe_after = 0 AS post_intervention_safety", "frames_after AS evaluated_frames", "unsafe_after AS unsafe_frames_after",
    )


def plan_steps(figures: DataFrame) -> DataFrame:
    """One row per plan step of each recovered run: completed or failed, and its frame."""
    cases = " ".join(
        f"WHEN '{s}' THEN array({', '.join(f'''named_struct('step', {i}, 'operator', '{op}', 'frame', found_{i})''' for i, (op, _) in enumerate(plan, 1))})"
        for s, plan in PLANS.items()
    )
    steps = figures.filter("variant = 'recovered'").selectExpr(*PAIR, f"inline(CASE scenario {cases} END)")
    return steps.selectExpr("*", "if(frame IS NULL, 'failed', 'completed') AS status")


def completion_rate(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*PAIR).agg(
        F.expr("count_if(status = 'completed') AS completed"), F.expr("count(1) AS steps"), F.expr("(rint((count_if(status = 'completed') / count(1) * 100) * 10D) / 10D + 0D) AS operator_completion_rate")
    )


def recovery_results(r: Replays) -> DataFrame:
    """One row per pair: verdicts, metrics and the six gates. The per-run tables are small and kept."""
    facts = materialise(run_facts(r))
    figures = materialise(run_figures(r, facts))
    wide = figures.join(facts.select(*KEYS, "success", "trigger_source", "trigger_type", "trigger_step"), list(KEYS))
    side = lambda v, names: wide.filter(F.col("variant") == v).select(*PAIR, *[F.col(n).alias(f"{v[0]}_{n}") for n in names])
    f = side("failure", ["success", "shared_path", "peak_force", "final_grasped"])
    c = side("recovered", ["success", "shared_path", "peak_force", "final_grasped", "restored", "post_peak", "begin_at", "fps", "success_time", "frames", "unsafe_frames",
                           "frames_after", "unsafe_after", "peak_after", "trigger_source", "trigger_type", "trigger_step"])
    plan = completion_rate(plan_steps(figures))
    both = f.join(c, PAIR).join(pair_integrity(r, facts), PAIR).join(plan, PAIR)
    both = both.selectExpr(
        "*", "NOT f_success AND r_success AS failure_control", "completed = steps AS plan_complete",
        "greatest(0D, r_success_time - r_begin_at / r_fps) AS _latency", "r_shared_path - f_shared_path AS _overhead",
    )
    return both.selectExpr(
        *PAIR, "pair_integrity", "failed_pair_checks", "fingerprint", "failure_control", "r_success AS task_success", "r_restored AS predicate_restored", "plan_complete",
        f"coalesce((rint(r_post_peak * 1000D) / 1000D + 0D) <= {FORCE_LIMIT}, false) AS post_recovery_force",
        "pair_integrity AND failure_control AND r_success AND r_restored AND plan_complete AS task_recovery",
        "r_frames > 0 AND r_unsafe_frames = 0 AS episode_safety", "r_frames_after > 0 AND r_unsafe_after = 0 AS post_intervention_safety",
        "coalesce(r_trigger_source = 'online-predicate-monitor', false) AND r_trigger_step IS NOT NULL AS online_trigger", "r_trigger_type AS trigger_type",
        "int(r_success) - int(f_success) AS success_delta", "(rint(_latency * 1000D) / 1000D + 0D) AS recovery_latency", "(rint(_overhead * 10000D) / 10000D + 0D) AS path_overhead",
        "(rint((_overhead / greatest(f_shared_path, 1e-9) * 100) * 10D) / 10D + 0D) AS path_overhead_rate", "operator_completion_rate",
        "(rint(r_peak_force * 1000D) / 1000D + 0D) AS episode_peak_force_n", "(rint(r_peak_after * 1000D) / 1000D + 0D) AS post_intervention_peak_force_n",
    ).selectExpr("*", "pair_integrity AND failure_control AND task_success AND predicate_restored AND plan_complete AND post_recovery_force AS passed")


# ---- aggregates -----------------------------------------------------------------------------------


def wilson_interval(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Struct (lower, upper) of the Wilson score interval; nulls when there are no trials."""
    p = successes / total
    scale = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / scale
    margin = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / scale
    known = total > 0
    return F.struct(
        F.when(known, round_even(F.greatest(F.lit(0.0), centre - margin), 4)).alias("lower"),
        F.when(known, round_even(F.least(F.lit(1.0), centre + margin), 4)).alias("upper"),
    )


def rate(flag: str) -> Column:
    return F.expr(f"coalesce((rint((count_if({flag}) / count(1)) * 10000D) / 10000D + 0D), 0D)")


def numeric_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and 95th percentile (linear) of a value per group; groups of any size."""
    layout = Layout.probe(df, by) if by else Layout()
    if not by:
        df, by, layout = df.withColumn("_all", F.lit(1)), ["_all"], Layout.probe(df.withColumn("_all", F.lit(1)), ["_all"])
    mean = df.groupBy(*by).agg(round_even(F.avg(value), 4).alias("mean"))
    high = layout.quantiles(df, {"p95": (F.col(value), 0.95)})
    return mean.join(high, by).withColumn("p95", round_even("p95", 4)).drop("_all")


def _aggregates() -> list[Column]:
    flags = ("task_recovery", "pair_integrity", "online_trigger", "episode_safety", "post_intervention_safety")
    ci = wilson_interval(count_if(F.col("task_recovery")), F.count(F.lit(1)))
    return [
        F.count(F.lit(1)).alias("trials"), *[rate(f).alias(f) for f in flags], ci["lower"].alias("ci_lower"), ci["upper"].alias("ci_upper"),
        round_even(F.avg("recovery_latency"), 4).alias("latency_mean"), round_even(F.avg("path_overhead"), 4).alias("path_mean"),
        round_even(F.avg("operator_completion_rate"), 2).alias("completion_mean"),
    ]


def recovery_benchmark(results: DataFrame) -> DataFrame:
    """Rates with intervals, latency and path figures: one row per scenario and one (``all``) for everything."""
    results = materialise(results)
    parts = []
    for data in (results, results.withColumn("scenario", F.lit("all"))):
        out = data.groupBy("scenario").agg(*_aggregates())
        for value, name in (("recovery_latency", "latency_p95"), ("path_overhead", "path_p95")):
            out = out.join(numeric_summary(data, value, ["scenario"]).select("scenario", F.col("p95").alias(name)), "scenario", "left")
        parts.append(out)
    return parts[0].unionByName(parts[1])


def seed_scenario_matrix(results: DataFrame) -> DataFrame:
    """Seeds as rows, one cell of verdicts per scenario."""
    cell = F.first(F.struct("task_recovery", "episode_safety", "post_intervention_safety", "online_trigger", "recovery_latency", "trigger_type"))
    return results.groupBy("seed").pivot("scenario", list(FAULTS)).agg(cell)
