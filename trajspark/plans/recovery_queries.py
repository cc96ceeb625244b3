"""Queries: paired recovery experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import recovery as rc
from trajspark.operators import sinks
from trajspark.operators import timeseries as ts
from trajspark.functions.layout import dense_positions
from trajspark.plans.diagnosis_queries import PARTS, r
from trajspark.plans.oracle import statement
from trajspark.plans.registry import query, scratch_path
from trajspark.plans.replays import REPLAY_PARTS, replays
from trajspark.plans.telemetry import read_table

RUN = "PARTITION BY scenario, seed, variant"
BAD = "force > 36"
STEPS = {
    "event": "seq = s", "gripper_restored": "gripper_command < -0.5 AND gripper < 0.65", "predicate": "restored AND seq = back",
    "success": "success_now", "success_safe": "success_now AND post_peak <= 36",
}


def _chain() -> dict[str, str]:
    parts, prev = {}, "pl0"
    for i in range(6):
        cases = " ".join(
            f"WHEN '{sc}' THEN " + (STEPS.get(plan[i][1]) or f"phase = '{plan[i][1]}'") for sc, plan in rc.PLANS.items() if i < len(plan)
        )
        parts[f"pl{i + 1}"] = (
            f"SELECT *, coalesce(found_{i + 1}, cursor_{i}) AS cursor_{i + 1} FROM (SELECT *, min(CASE WHEN seq >= cursor_{i} AND (CASE scenario {cases} ELSE false END) THEN seq END) OVER ({RUN}) AS found_{i + 1} FROM {prev})"
        )
        prev = f"pl{i + 1}"
    return parts


LEN = "sqrt((tcp_x - lag(tcp_x) OVER w) ** 2 + (tcp_y - lag(tcp_y) OVER w) ** 2)"
RPARTS = PARTS | REPLAY_PARTS | {
    "fr1": "SELECT f.*, rr.success AS run_success, rr.duration, CASE WHEN f.variant = 'failure' THEN 0 ELSE f.s END AS begin_at, "
    f"coalesce({LEN}, 0) AS leg FROM frames f JOIN runs_r rr ON f.u = rr.u AND f.variant = rr.variant WINDOW w AS (PARTITION BY f.u, f.variant ORDER BY f.seq)",
    "fr2": f"SELECT *, variant = 'recovered' AND run_success AND coalesce(CASE WHEN scenario = 'collision' THEN bool_and(force <= 36) FILTER (WHERE seq BETWEEN back AND back + 2) OVER ({RUN}) "
    f"ELSE bool_or(is_grasped) FILTER (WHERE seq = back) OVER ({RUN}) END, false) AS restored FROM fr1",
    "fr3": f"SELECT *, max(force) FILTER (WHERE seq >= CASE WHEN restored THEN back ELSE begin_at END) OVER ({RUN}) AS post_peak FROM fr2",
    "pl0": "SELECT *, begin_at AS cursor_0 FROM fr3",
    **_chain(),
    "rf": "SELECT scenario, seed, variant, any_value(u) AS u, count(*) AS frames, max(force) AS peak_force, max(post_peak) AS post_peak, bool_or(restored) AS restored, max(begin_at) AS begin_at, sum(leg) AS path_length, max(duration) AS duration, "
    "count(*) FILTER (WHERE is_grasped) AS grasped_frames, arg_max(is_grasped, seq) AS final_grasped, any_value(run_success) AS success, arg_min(timestamp, seq) FILTER (WHERE success_now AND seq >= begin_at) AS success_time, "
    f"count(*) FILTER (WHERE {BAD}) AS unsafe, arg_min(timestamp, seq) FILTER (WHERE {BAD}) AS unsafe_time, count(*) FILTER (WHERE {BAD} AND seq >= begin_at) AS unsafe_after, count(*) FILTER (WHERE seq >= begin_at) AS frames_after, "
    "max(force) FILTER (WHERE seq >= begin_at) AS peak_after, " + ", ".join(f"max(found_{i}) AS found_{i}" for i in range(1, 7)) + " FROM pl6 GROUP BY 1, 2, 3",
    "psteps": " UNION ALL ".join(
        f"SELECT scenario, seed, {i} AS step, '{op}' AS operator, found_{i} AS frame FROM rf WHERE variant = 'recovered' AND scenario = '{sc}'" for sc, plan in rc.PLANS.items() for i, (op, _) in enumerate(plan, 1)
    ),
    "done_s": "SELECT scenario, seed, count(frame) AS completed, count(*) AS steps, round_even(count(frame) / count(*) * 100, 1) AS operator_completion_rate FROM psteps GROUP BY 1, 2",
    "res0": "SELECT f.scenario, f.seed, f.u, (f.u % 11 <> 0 AND f.u % 19 <> 5) AS pair_integrity, NOT f.success AND c.success AS failure_control, c.success AS task_success, c.restored AS predicate_restored, completed = steps AS plan_complete, "
    "round_even(c.post_peak, 3) <= 36 AS post_recovery_force, c.unsafe = 0 AS episode_safety, c.unsafe_after = 0 AND c.frames_after > 0 AS post_intervention_safety, f.u % 6 <> 5 AS online_trigger, c.success::INT - f.success::INT AS success_delta, "
    "round_even(greatest(0, c.success_time - c.begin_at / 20), 3) AS recovery_latency, round_even(c.path_length - f.path_length, 4) AS path_overhead, round_even((c.path_length - f.path_length) / greatest(f.path_length, 1e-9) * 100, 1) AS path_overhead_rate, operator_completion_rate "
    "FROM rf f JOIN rf c ON f.u = c.u JOIN done_s d ON d.scenario = f.scenario AND d.seed = f.seed WHERE f.variant = 'failure' AND c.variant = 'recovered'",
    "res": "SELECT *, pair_integrity AND failure_control AND task_success AND predicate_restored AND plan_complete AS task_recovery FROM res0",
    "kept_seed": "SELECT seed FROM res GROUP BY 1 HAVING bool_and(pair_integrity) AND count(DISTINCT scenario) = 3",
}


def check(final: str) -> str:
    return statement(RPARTS, final)


def figures(spark, sf):
    rep = replays(spark, sf)
    facts = rc.run_facts(rep)
    return rep, facts, rc.run_figures(rep, facts)


@query(
    "read_replays",
    "SELECT cast(label AS VARCHAR) AS scenario, vec_id AS seed, 'failure' AS variant, 64 AS frames, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) AS force_sum, 1 AS events FROM embeddings",
)
def read_replays(spark, sf):
    """Embeddings as replay documents, written and read as JSON, then flattened."""
    path = scratch_path(spark, "replays")
    e = "embedding"
    documents = read_table(spark, sf, "embeddings").selectExpr(
        "cast(label AS STRING) AS scenario", "vec_id AS seed", "'failure' AS variant", "20 AS fps", "size(embedding) AS rows", "size(embedding) / 20 AS duration", "false AS success",
        "named_struct('env_id', 'x', 'steps', 140, 'width', 320, 'height', 240) AS config", "named_struct('trigger_step', 3L) AS recovery",
        f"transform({e}, (x, i) -> i / 20) AS timestamps", f"transform({e}, x -> array(cast(x AS DOUBLE), 0D, 0D)) AS tcp", f"transform({e}, x -> cast(x AS DOUBLE)) AS force",
        f"transform({e}, x -> 'reach') AS phases", "array(named_struct('time', 1D, 'type', 'recovery-start', 'source', 'recovery-monitor', 'label', 'x')) AS events",
    )
    sinks.write_json(documents, path)
    rep = rc.read_replays(spark, path, multi_line=False)
    keys = list(rc.KEYS)
    n = rep.events.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("events"))
    return rep.frames.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("frames"), r(F.sum("force"), 4).alias("force_sum")).join(n, keys)


@query("pair_join", check("SELECT f.scenario, f.seed, f.rows AS failure_rows, c.rows AS recovered_rows, f.success AS failure_success, c.success AS recovered_success FROM runs_r f JOIN runs_r c ON f.u = c.u WHERE f.variant = 'failure' AND c.variant = 'recovered'"))
def pair_join(spark, sf):
    runs = replays(spark, sf).runs
    side = lambda v: runs.filter(F.col("variant") == v).select(*rc.PAIR, F.col("rows").alias(f"{v}_rows"), F.col("success").alias(f"{v}_success"))
    return side("failure").join(side("recovered"), rc.PAIR)


@query("pair_integrity", check("SELECT scenario, seed, true AS controlled_variables, true AS initial_state, u % 11 <> 0 AND u % 19 <> 5 AS fault_signature, u % 11 <> 0 AND u % 19 <> 5 AS pair_integrity FROM runs_r WHERE variant = 'failure'"))
def pair_integrity(spark, sf):
    rep = replays(spark, sf)
    return rc.pair_integrity(rep, rc.run_facts(rep)).select(*rc.PAIR, "controlled_variables", "initial_state", "fault_signature", "pair_integrity")


@query("admit_seeds", check("SELECT seed, scenario, true AS kept FROM res WHERE seed IN (SELECT seed FROM kept_seed) UNION ALL SELECT seed, scenario, false FROM res WHERE NOT pair_integrity"))
def admit_seeds(spark, sf):
    kept, excluded = rc.admit_seeds(rc.recovery_results(replays(spark, sf)))
    return kept.select("seed", "scenario", F.lit(True).alias("kept")).unionByName(excluded.select("seed", "scenario", F.lit(False).alias("kept")))


@query(
    "frame_at_time",
    check(
        "SELECT f.scenario, f.seed, f.variant, 1.234 ::DOUBLE AS time, max(f.seq) AS frame, arg_max(f.phase, f.seq) AS phase FROM frames f WHERE f.seq = least(n - 1, 25) OR (f.seq > least(n - 1, 25) AND f.timestamp <= 1.234) GROUP BY 1, 2, 3"
    ),
)
def frame_at_time(spark, sf):
    rep = replays(spark, sf)
    cursors = rep.runs.select(*rc.KEYS, F.lit(1.234).alias("time"))
    return rc.frame_at_time(rep.frames, cursors, rep.runs).drop("force")


@query("shared_interval", check("SELECT scenario, seed, variant, count(*) AS rows FROM frames WHERE timestamp <= 1.5 + 1e-9 GROUP BY 1, 2, 3"))
def shared_interval(spark, sf):
    return replays(spark, sf).frames.filter(F.col("timestamp") <= 1.5 + 1e-9).groupBy(*rc.KEYS).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "path_length",
    "SELECT label AS episode_id, round(sum(coalesce(sqrt(list_sum(list_transform(list_zip(embedding, before), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 0)), 6) AS path_length "
    "FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) GROUP BY 1",
)
def path_length(spark, sf):
    """Path through all 64 coordinates of the vectors of a label."""
    axes = [f"x_{i}" for i in range(64)]
    rows = read_table(spark, sf, "embeddings").selectExpr("label AS episode_id", "vec_id", *[f"double(embedding[{i}]) AS {c}" for i, c in enumerate(axes)])
    rows, layout = dense_positions(rows, "episode_id", ["vec_id"])
    return ts.path_length(rows, layout, axes).select("episode_id", r("path_length").alias("path_length"))


@query("first_true_time", check("SELECT scenario, seed, variant, round(success_time, 6) AS success_time FROM rf"))
def first_true_time(spark, sf):
    return figures(spark, sf)[2].select(*rc.KEYS, r("success_time").alias("success_time"))


@query("ordered_match", check("SELECT scenario, seed, step, operator, frame, CASE WHEN frame IS NULL THEN 'failed' ELSE 'completed' END AS status FROM psteps"))
def ordered_match(spark, sf):
    return rc.plan_steps(figures(spark, sf)[2])


@query(
    "rolling_hold",
    check(
        "SELECT scenario, seed, variant, min(seq) AS restored_index FROM (SELECT *, max(force) OVER w AS peak, count(*) OVER w AS wide FROM frames WINDOW w AS (PARTITION BY u, variant ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) "
        "WHERE seq >= s AND starts_with(phase, 'recovery_') AND wide = 3 AND peak <= 36 GROUP BY 1, 2, 3"
    ),
)
def rolling_hold(spark, sf):
    rep = replays(spark, sf)
    facts = rc.run_facts(rep).select(*rc.KEYS, "start_at")
    return rc.rolling_hold(rep.layout.attach(rep.frames, facts), rep.layout, "start_at")


@query(
    "variant_summary",
    check("SELECT scenario, seed, variant, success, frames AS rows, round_even(duration, 3) AS duration, round_even(peak_force, 3) AS peak_force, round_even(post_peak, 3) AS post_recovery_peak_force, round_even(path_length, 4) AS path_length, grasped_frames, final_grasped FROM rf"),
)
def variant_summary(spark, sf):
    _, facts, figs = figures(spark, sf)
    return rc.variant_summary(figs, facts)


@query(
    "force_safety",
    check("SELECT scenario, seed, variant, unsafe = 0 AS episode_safety, unsafe AS unsafe_frames, round_even(unsafe_time, 3) AS first_violation_time, frames_after > 0 AND unsafe_after = 0 AS post_intervention_safety, frames_after AS evaluated_frames, unsafe_after AS unsafe_frames_after FROM rf"),
)
def force_safety(spark, sf):
    return rc.force_safety(figures(spark, sf)[2])


@query("predicate_restored", check("SELECT scenario, seed, restored FROM rf WHERE variant = 'recovered'"))
def predicate_restored(spark, sf):
    return figures(spark, sf)[2].filter("variant = 'recovered'").select(*rc.PAIR, "restored")


RESULT = [
    "scenario", "seed", "pair_integrity", "failure_control", "task_success", "predicate_restored", "plan_complete", "post_recovery_force", "task_recovery", "episode_safety", "post_intervention_safety",
    "online_trigger", "success_delta", "recovery_latency", "path_overhead", "path_overhead_rate", "operator_completion_rate",
]


@query("recovery_result", check(f"SELECT {', '.join(RESULT)} FROM res"))
def recovery_result(spark, sf):
    return rc.recovery_results(replays(spark, sf)).select(*RESULT)


def _rate_sql(flag: str) -> str:
    return f"round_even(count(*) FILTER (WHERE {flag}) / count(*), 4) AS {flag}"


P_ = "(count(*) FILTER (WHERE task_recovery) / count(*))"
Z2 = "(1.96::DOUBLE * 1.96::DOUBLE)"
CENTRE, MARGIN = f"(({P_} + {Z2} / (2 * count(*))) / (1 + {Z2} / count(*)))", f"(1.96::DOUBLE * sqrt({P_} * (1 - {P_}) / count(*) + {Z2} / (4 * count(*) * count(*))) / (1 + {Z2} / count(*)))"
AGG = (
    "count(*) AS trials, " + ", ".join(_rate_sql(f) for f in ("task_recovery", "pair_integrity", "online_trigger", "episode_safety", "post_intervention_safety"))
    + f", round_even(greatest(0, {CENTRE} - {MARGIN}), 4) AS ci_lower, round_even(least(1, {CENTRE} + {MARGIN}), 4) AS ci_upper, round_even(avg(recovery_latency), 4) AS latency_mean, round_even(avg(path_overhead), 4) AS path_mean, "
    "round_even(avg(operator_completion_rate), 2) AS completion_mean, round_even(quantile_cont(recovery_latency, 0.95), 4) AS latency_p95, round_even(quantile_cont(path_overhead, 0.95), 4) AS path_p95"
)


@query("recovery_benchmark", check(f"SELECT scenario, {AGG} FROM res WHERE seed IN (SELECT seed FROM kept_seed) GROUP BY 1 UNION ALL SELECT 'all', {AGG} FROM res WHERE seed IN (SELECT seed FROM kept_seed)"))
def recovery_benchmark(spark, sf):
    """Verdict rates over the seeds whose every pair is sound."""
    kept, _ = rc.admit_seeds(rc.recovery_results(replays(spark, sf)))
    return rc.recovery_benchmark(kept)


CELLS = {s: s.replace("-", "_") for s in rc.FAULTS}


@query("seed_scenario_matrix", check("SELECT seed, " + ", ".join(f"bool_or(task_recovery) FILTER (WHERE scenario = '{s}') AS {c}, max(recovery_latency) FILTER (WHERE scenario = '{s}') AS {c}_latency" for s, c in CELLS.items()) + " FROM res GROUP BY 1"))
def seed_scenario_matrix(spark, sf):
    out = rc.seed_scenario_matrix(rc.recovery_results(replays(spark, sf)))
    return out.select("seed", *[x for s, c in CELLS.items() for x in (F.col(f"`{s}`.task_recovery").alias(c), F.col(f"`{s}`.recovery_latency").alias(f"{c}_latency"))])


@query("completion_rate", check("SELECT scenario, seed, completed, steps, operator_completion_rate FROM done_s"))
def completion_rate(spark, sf):
    return rc.completion_rate(rc.plan_steps(figures(spark, sf)[2]))


_P = "(sum(won) / count(*))"


@query(
    "wilson_interval",
    "SELECT c_nationkey AS nation, cast(sum(won) AS BIGINT) AS successes, count(*) AS total, "
    f"round_even(greatest(0, (({_P} + {Z2} / (2 * count(*))) / (1 + {Z2} / count(*))) - (1.96::DOUBLE * sqrt({_P} * (1 - {_P}) / count(*) + {Z2} / (4 * count(*) * count(*))) / (1 + {Z2} / count(*)))), 4) AS lower, "
    f"round_even(least(1, (({_P} + {Z2} / (2 * count(*))) / (1 + {Z2} / count(*))) + (1.96::DOUBLE * sqrt({_P} * (1 - {_P}) / count(*) + {Z2} / (4 * count(*) * count(*))) / (1 + {Z2} / count(*)))), 4) AS upper "
    "FROM (SELECT c_nationkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1",
)
def wilson_interval(spark, sf):
    """Share of finished orders per nation with its interval."""
    orders = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("won"))
    joined = orders.join(read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey")
    out = joined.groupBy("nation").agg(F.count_if("won").alias("successes"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("ci", rc.wilson_interval(F.col("successes"), F.col("total"))).select("nation", "successes", "total", "ci.lower", "ci.upper")


@query("numeric_summary", "SELECT o_orderpriority AS priority, round_even(avg(o_totalprice), 4) AS mean, round_even(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1")
def numeric_summary(spark, sf):
    return rc.numeric_summary(read_table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority"), "o_totalprice", ["priority"])
