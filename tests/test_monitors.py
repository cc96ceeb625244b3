"""The stream processors: order within and between micro-batches, late frames, timers and expiry of state."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trajspark.functions.layout import Layout
from trajspark.streaming import monitors as mo
from trajspark.streaming.monitors import FrameMotion, RunMonitor


class Held:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


    def clear(self):
        self.value = None

    put = update


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return Held()

    def getListState(self, name, schema):
        return Held()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def batches(processor, key, frames):
    processor.init(Handle())
    return [list(processor.handleInputRows(key, iter([f]), None)) for f in frames]


def frame(seq, force):
    return pd.DataFrame({"seq": seq, "force": force, "is_grasped": False, "gripper": 0.5, "gripper_command": 0.0, "success_now": False, "phase": "reach"})


def test_late_frames_come_out_as_rows():
    got = batches(RunMonitor(), ("collision", 1, "base"), [frame([2, 0, 1], [0.0, 0.0, 0.0]), frame([4, 1, 3], [50.0, 99.0, 0.0])])
    assert got[0] == []
    assert [(r.type, r.step, r.late) for out in got[1] for r in out.itertuples()] == [("late-frame", 1, 1), ("predicate-violated", 4, 1)]


def test_frame_motion_over_batches():
    shown = lambda seq: pd.DataFrame({"seq": seq, "pixels": [[float(51 * s)] * 4 for s in seq]})
    first, second = batches(FrameMotion(), (7,), [shown([1, 0]), shown([0, 4, 2, 3])])
    assert first[0].camera_motion.tolist() == [0.0, 0.2]
    assert second[0].seq.tolist() == [0] and np.isnan(second[0].camera_motion).all()
    assert np.allclose(second[1].camera_motion, [0.2, 0.2, 0.2])


def test_frames_wait_for_their_turn():
    got = batches(RunMonitor(), ("collision", 1, "base"), [frame([5, 3, 4], [0.0, 50.0, 0.0]), frame([1, 2], [0.0, 0.0]), frame([0, 2, 4], [0.0, 9.0, 9.0])])
    assert got[:2] == [[], []]
    assert [(r.type, r.step, r.late) for out in got[2] for r in out.itertuples()] == [("late-frame", 2, 2), ("late-frame", 4, 2), ("predicate-violated", 3, 2)]


def test_timers_give_up_missing_frames_and_forget_runs():
    monitor, handle = RunMonitor(patience=1000, idle=5000), Handle()
    monitor.init(handle)
    timed = lambda seq, force: frame(seq, force).assign(event_time=pd.to_datetime([100 * s for s in seq], unit="ms"))
    fire = lambda ms: (handle.timers.discard(ms), list(monitor.handleExpiredTimer(("collision", 1, "base"), Now(ms), None)))[1]
    assert list(monitor.handleInputRows(("collision", 1, "base"), iter([timed([0, 1, 4, 3, 9], [0.0, 0.0, 0.0, 50.0, 0.0])]), None)) == []
    assert handle.timers == {300 + 1000}
    (out,) = fire(1300)  # frame 2 is given up; 3 and 4 are judged, 9 goes on waiting
    assert [(r.type, r.step) for r in out.itertuples()] == [("predicate-violated", 3)]
    assert handle.timers == {900 + 1000} and [r[0] for r in monitor.waiting.get()] == [9]
    (late,) = list(monitor.handleInputRows(("collision", 1, "base"), iter([timed([2], [0.0])]), None))
    assert late.type.tolist() == ["late-frame"]
    assert fire(1900) == [] and not monitor.waiting.exists() and handle.timers == {900 + 5000}
    assert fire(5900) == [] and not monitor.state.exists() and handle.timers == set()


SCHEMA = "scenario string, seed bigint, variant string, seq bigint, force double, gripper double, gripper_command double, is_grasped boolean, success_now boolean, phase string"


def run_frames(spark, runs, n=60):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(runs):
        peak = int(rng.integers(5, 30))
        for i in range(n):
            rows.append(
                (["collision", "gripper-failure", "object-slip"][k % 3], k, "recovered", i, 50.0 if i in (peak, peak + 1) else float(rng.integers(5, 36)), 0.9 if peak <= i < peak + 6 else 0.1,
                 -1.0, peak - 4 < i < peak or i > peak + 20, i > n - 3, "recovery_hold" if i > peak + 3 else "reach")
            )
    return spark.createDataFrame(rows, SCHEMA)


def test_shuffled_stream_gives_the_batch_rows(spark, tmp_path):
    mo.use_rocksdb(spark)
    frames = run_frames(spark, 9)
    source = str(tmp_path / "in")
    timed = frames.withColumn("event_time", F.timestamp_millis(F.lit(10**12) + F.col("seq") * 50))
    for k in range(4):
        timed.filter(F.pmod(F.xxhash64("seq", "seed"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(source)
    mo.run_to_files(mo.monitor_runs(stream, "1 hour"), str(tmp_path / "out"))
    got = spark.read.schema(mo.EVENTS).parquet(str(tmp_path / "out")).select(*mo.KEYS, "type", "step").collect()
    want = mo.batch_events(frames, Layout(keys=tuple(mo.KEYS))).select(*mo.KEYS, "type", "step").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["type"] for r in got} == {"predicate-violated", "predicate-restored", "recovery-success"}


def test_state_falls_behind_the_watermark(spark, tmp_path):
    mo.use_rocksdb(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frames = run_frames(spark, 6, 10).withColumn("event_time", F.timestamp_millis(F.lit(10**12) + F.col("seq") * 50))
    later = lambda hours: frames.filter("seed = 5").withColumns({"seed": F.lit(100 + hours), "event_time": F.col("event_time") + F.expr(f"INTERVAL {hours} HOURS")})
    for part in (frames, later(1), later(2), later(3)):
        part.withColumn("seed", F.col("seed").cast("long")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(source)
    job = mo.monitor_runs(stream, "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    job.awaitTermination()
    runs = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    assert max(runs) >= 6 and runs[-1] < max(runs) and runs[-1] <= 4


def test_integer_commands_that_wait_for_their_turn(spark, tmp_path):
    mo.use_rocksdb(spark)
    rows = [("gripper-failure", 1, "failure", k, 0.0, 0.9, -1 if k >= 4 else 1, False, False, "grasp") for k in range(12)]
    schema = "scenario string, seed bigint, variant string, seq bigint, force double, gripper double, gripper_command int, is_grasped boolean, success_now boolean, phase string"
    source = str(tmp_path / "frames")
    for part in (rows[1::2], rows[0::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "events")
    mo.run_to_files(mo.monitor_runs(stream), out)
    got = spark.read.schema(mo.EVENTS).parquet(out).collect()
    assert [(r["type"], r["step"]) for r in got] == [("predicate-violated", 7)]
