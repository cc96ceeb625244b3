"""Sources that are message logs: typed streams and their as-of merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.layout import DEFAULT_CHUNK_ROWS, Layout, dense_positions, range_buckets
from trajspark.functions.lineage import materialise
from trajspark.operators.steps import validate_steps

# Which stream leads, and how far a merged sample may be.
STREAM_PRIORITY = ("joint", "pose", "camera", "wrench", "scalar")
LEAST_TOLERANCE, TOLERANCE_PERIODS = 0.1, 3
PAYLOAD = "position array<double>, x double, y double, z double, data string"


def route_messages(messages: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """Decoded messages (topic, msgtype, ts_ns, payload JSON) -> one typed row each, in one pass.

    ``stream`` is joint, pose, wrench, camera, scalar, success or null; ``timestamp`` is seconds since the
    first message of the log.
    """
    first = messages.groupBy(*keys).agg(F.min("ts_ns").alias("_first"))
    rows = messages.join(first, list(keys)).withColumn("p", F.from_json("payload", PAYLOAD))
    kind, topic = F.col("msgtype"), F.lower("topic")
    ends = lambda *names: reduce(lambda a, b: a | b, [F.endswith(kind, F.lit(n)) for n in names])
    holds = lambda *parts: reduce(lambda a, b: a | b, [F.contains(topic, F.lit(p)) for p in parts])
    scalar = F.col("p.data").isNotNull()
    stream = (
        F.when(ends("JointState"), "joint")
        .when(ends("PoseStamped", "PoseWithCovarianceStamped", "Odometry", "TransformStamped"), "pose")
        .when(ends("WrenchStamped", "Wrench"), "wrench")
        .when(ends("Image"), "image")
        .when(scalar & holds("success") & F.lower("p.data").isin("true", "false"), "success")
        .when(scalar & holds("gripper", "object_distance", "target_distance"), "scalar")
        .when(scalar & holds("camera_motion"), "camera")
        .when(scalar & holds("phase", "task_state"), "scalar")
    )
    number = F.col("p.data").try_cast("double")
    is_gripper, is_distance = holds("gripper"), holds("object_distance", "target_distance")
    rows = rows.withColumn("stream", stream)
    here = lambda name, value: F.when(F.col("stream") == name, value)
    return rows.select(
        *keys, "topic", "stream", ((F.col("ts_ns") - F.col("_first")) / 1e9).alias("timestamp"), "ts_ns",
        here("joint", F.col("p.position")).alias("position"),
        *[here("pose", F.col(f"p.{a}")).alias(f"ee_{a}") for a in "xyz"],
        *[here("wrench", F.col(f"p.{a}")).alias(f"force_{a}") for a in "xyz"],
        here("camera", number).alias("camera_motion"),
        here("scalar", F.when(is_gripper, number)).alias("gripper"),
        here("scalar", F.when(~is_gripper & is_distance, number)).alias("object_distance"),
        here("scalar", F.when(~is_gripper & ~is_distance, F.col("p.data"))).alias("phase"),
        here("success", F.lower("p.data") == "true").alias("success"),
    )


def stream_counts(messages: DataFrame, by: str = "topic") -> DataFrame:
    return messages.groupBy(by).agg(F.count(F.lit(1)).alias("messages"))


def last_known(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per time: the last non-null value of each column."""
    values = [c for c in stream.columns if c not in (*keys, "timestamp", order)]
    return stream.groupBy(*keys, "timestamp").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    )


def tolerance(stream: DataFrame, key: str, limit: int) -> DataFrame:
    """max(0.1 s, three median periods) per log."""
    numbered, layout = dense_positions(stream.select(key, "timestamp"), key, ["timestamp"], limit=limit)
    steps = layout.local(numbered, lambda w: {"dt": F.col("timestamp") - F.lag("timestamp").over(w)}, before=1)
    period = layout.quantiles(steps, {"_period": (F.when(F.col("dt") > 0, F.col("dt")), 0.5)})
    return period.select(
        key, F.greatest(F.lit(LEAST_TOLERANCE), F.coalesce(F.col("_period") * TOLERANCE_PERIODS, F.lit(0.0))).alias("_tolerance")
    )


def asof_merge_streams(
    streams: Mapping[str, DataFrame], key: str = "episode_id", order: str = "seq", limit: int = DEFAULT_CHUNK_ROWS
) -> DataFrame:
    """Merge streams onto the leading one by nearest time.

    All streams are laid side by side and searched in one pass: each row of the leading stream takes the
    nearest sample before or after it (the earlier one on ties) if it is within that stream's tolerance. A log too long for one
    task is cut into sampled ranges of its samples, however close in time they lie; the edges of ranges are carried over.
    ``streams``: name -> (key, timestamp, order, values...).
    """
    present = [n for n in STREAM_PRIORITY if n in streams] + [n for n in streams if n not in STREAM_PRIORITY]
    if not present:
        raise ValueError("no stream to merge")
    lead = present[0]
    known = {n: last_known(streams[n], [key], order) for n in present}
    taken = set(known[lead].columns)
    merged = known[lead].withColumn("_kind", F.lit(1))
    samples: dict[str, list[str]] = {}
    limits: DataFrame | None = None
    for name in present[1:]:
        values = [c for c in known[name].columns if c not in taken]
        taken |= set(values)
        if not values:
            continue
        samples[name] = values
        packed = F.struct(F.col("timestamp").alias("t"), *values)
        merged = merged.unionByName(
            known[name].select(key, "timestamp", F.lit(0).alias("_kind"), packed.alias(f"_s_{name}")), allowMissingColumns=True
        )
        mine = tolerance(known[name], key, limit).withColumnRenamed("_tolerance", f"_tol_{name}")
        limits = mine if limits is None else limits.join(mine, key, "full")
    if limits is None:
        return merged.drop("_kind")
    layout = Layout.probe(merged, (key,), "_at", limit)
    merged = merged.withColumn("_at", F.struct("timestamp", "_kind"))
    if not layout.whole:
        merged = range_buckets(merged, [key, "timestamp", "_kind"])
    layout = Layout(layout.chunk_rows, (key,), "_at", None if layout.whole else "_bucket")
    found = layout.carry(merged, {f"_b_{n}": F.col(f"_s_{n}") for n in samples}, {f"_a_{n}": F.col(f"_s_{n}") for n in samples})
    found = found.filter("_kind = 1")
    found = found.join(limits, key, "left") if layout.whole else _attach_by_bucket(found, limits, key)
    columns = [c for c in known[lead].columns]
    for name, values in samples.items():
        b, a = F.col(f"_b_{name}"), F.col(f"_a_{name}")
        back, ahead = F.col("timestamp") - b["t"], a["t"] - F.col("timestamp")
        near = F.when(a.isNull() | (back <= ahead), b).otherwise(a)
        ok = F.least(back, ahead) <= F.col(f"_tol_{name}")
        found = found.withColumns({v: F.when(ok, near[v]) for v in values})
        columns += values
    return found.select(*columns)


def _attach_by_bucket(rows: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    homes = rows.select(key, "_bucket").distinct().join(figures, key, "left")
    return rows.join(homes, [key, "_bucket"])


def message_log_steps(messages: DataFrame, key: str = "log_id") -> DataFrame:
    """Decoded messages -> step table: one episode per log, on the times of its leading stream.

    The leading stream of a log is the first of ``STREAM_PRIORITY`` that it has. Joint positions become ``joint_1..n`` with the
    widest message's n (one small job); the last success message of a log holds for all its rows.
    """
    routed = materialise(route_messages(messages, (key,)).withColumn("episode_id", F.col(key).cast("string")).drop("topic"))
    width = routed.agg(F.max(F.size("position"))).first()[0] or 0
    joints = [F.get("position", F.lit(i)).cast("double").alias(f"joint_{i + 1}") for i in range(max(0, width))]
    values = {
        "joint": joints, "pose": [F.col(f"ee_{a}") for a in "xyz"], "camera": [F.col("camera_motion")],
        "wrench": [F.col(f"force_{a}") for a in "xyz"], "scalar": [F.col(c) for c in ("gripper", "object_distance", "phase")],
    }
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(STREAM_PRIORITY) for x in (n, i)])
    led = routed.filter(F.col("stream").isin(*STREAM_PRIORITY)).groupBy("episode_id").agg(F.min(ranks[F.col("stream")]).alias("_lead"))
    led = materialise(led)
    merged = []
    for first in sorted(r["_lead"] for r in led.select("_lead").distinct().collect()):  # one of five numbers each
        mine = routed.join(led.filter(F.col("_lead") == first), "episode_id")
        streams = {n: mine.filter(F.col("stream") == n).select("episode_id", "timestamp", "ts_ns", *values[n]) for n in STREAM_PRIORITY[first:] if values[n]}
        merged.append(asof_merge_streams(streams, order="ts_ns"))
    if not merged:
        raise ValueError("no joint, pose, camera, wrench or scalar messages in the log")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), merged)
    told = routed.filter(F.col("success").isNotNull()).groupBy("episode_id").agg(F.max_by("success", "ts_ns").alias("success"))
    rows = rows.join(told, "episode_id", "left").withColumn("success_known", F.col("success").isNotNull())
    steps, layout = dense_positions(rows, "episode_id", ["timestamp"])
    return validate_steps(steps, layout)
