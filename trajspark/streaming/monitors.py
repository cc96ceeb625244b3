"""Online monitors: per-run state over a stream of frames, and batch versions that give the same events.

Frames of a run carry dense numbers ``seq`` = 0, 1, 2, ... A frame that comes before its turn waits in the state until the frames before it
are there, so a stream in any order gives the rows of the batch versions. With an event time, two timers bound the state: frames that wait
go on without the missing ones once the watermark has passed them by ``PATIENCE_MS``, and a run without frames for ``IDLE_MS`` is
forgotten. A frame whose turn is over (a repeated one, or one that was given up) can't be judged any more; it comes out as a row of
its own (type ``late-frame``, or a null motion). Frames behind the watermark are dropped and counted by Spark.

Bound the size of a micro-batch at the source (for files, ``maxFilesPerTrigger``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajspark.functions.layout import Layout

# Workers may not have this package: send the processors themselves, not their name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["scenario", "seed", "variant"]
# Force limit, command and opening of an ignored close command, frames until it counts.
FORCE_LIMIT, CLOSE, OPEN, MISMATCH_FRAMES, HOLD_FRAMES = 36.0, -0.5, 0.75, 4, 3
EVENTS = "scenario string, seed bigint, variant string, type string, step bigint, late bigint"
PATIENCE_MS, IDLE_MS = 10_000, 600_000  # event time that waiting frames, and runs without frames, are given


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def _trailing(mask: np.ndarray, before: int) -> np.ndarray:
    """Length of the run of true values that ends at each position, going on from ``before``."""
    index = np.arange(len(mask))
    last_false = np.maximum.accumulate(np.where(mask, -1, index))
    return np.where(mask, np.where(last_false < 0, index + 1 + before, index - last_false), 0)


def _first(mask: np.ndarray) -> int | None:
    return int(mask.argmax()) if mask.any() else None


class OrderedFrames(StatefulProcessor):
    """Hands the frames of a key on in the order of ``seq``, whatever the order they come in; subclasses judge them in ``advance``."""

    STATE: str  # fields of the subclass' own state
    START: tuple
    FRAME: str  # columns of a frame, ``seq`` first
    TIMES = "next bigint, latest bigint, timer bigint"  # next seq, largest event time, timer that is set

    def __init__(self, patience: int = PATIENCE_MS, idle: int = IDLE_MS):
        self.patience, self.idle = patience, idle
        self.columns = [c.split()[0] for c in self.FRAME.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", f"{self.TIMES}, {self.STATE}")
        self.waiting = handle.getListState("waiting", f"{self.FRAME}, event_ms bigint")

    def close(self) -> None:
        pass

    def advance(self, key, state: tuple, frames: pd.DataFrame) -> tuple[tuple, pd.DataFrame | None]:
        """New state and output for frames that follow those seen so far."""
        raise NotImplementedError

    def late(self, key, state: tuple, seq: pd.Series) -> tuple[tuple, pd.DataFrame]:
        """New state and output for frames whose turn is over."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (following, latest, timer), own = self._read()
        came = pd.concat(list(rows))
        timed = "event_time" in came.columns
        came["event_ms"] = came["event_time"].astype("datetime64[ms]").astype("int64") if timed else 0
        came = came[[*self.columns, "event_ms"]].sort_values("seq", kind="stable")
        waited = self._waiting()
        known = set(waited["seq"]) if len(waited) else set()
        over = (came["seq"] < following) | came["seq"].duplicated() | came["seq"].isin(known)
        if over.any():
            own, out = self.late(key, own, came["seq"][over])
            yield out
        frames = pd.concat([waited, came[~over]]).sort_values("seq", kind="stable") if len(waited) else came[~over]
        seq = frames["seq"].to_numpy()
        ready = int(np.argmin(np.append(seq == following + np.arange(len(seq)), False)))
        if ready:
            own, out = self.advance(key, own, frames.iloc[:ready])
            following = int(seq[ready - 1]) + 1
            if out is not None:
                yield out
        left = frames.iloc[ready:]
        if len(left) or len(waited):
            self._wait(left)
        if timed:
            latest = max(latest, int(came["event_ms"].max()))
            timer = self._set(timer, left, latest)
        self.state.update((following, latest, timer, *own))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (following, latest, _), own = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        left = self._waiting().sort_values("seq", kind="stable")
        gone = np.maximum.accumulate((left["event_ms"].to_numpy() + self.patience <= now)[::-1])[::-1] if len(left) else np.zeros(0, bool)
        if gone.any():  # with those right behind the last of them, which are no longer held up
            n = int(gone.sum())
            seq = left["seq"].to_numpy()
            n += int(np.argmin(np.append(seq[n:] == seq[n - 1] + 1 + np.arange(len(seq) - n), False)))
            own, out = self.advance(key, own, left.iloc[:n])
            following, left = int(seq[n - 1]) + 1, left.iloc[n:]
            self._wait(left)
            if out is not None:
                yield out
        if not len(left) and latest + self.idle <= now:
            self.state.clear()
        else:
            self.state.update((following, latest, self._set(None, left, latest), *own))

    def _read(self) -> tuple[tuple, tuple]:
        if not self.state.exists():
            return (0, 0, None), self.START
        held = self.state.get()
        return tuple(held[:3]), tuple(held[3:])

    def _waiting(self) -> pd.DataFrame:
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        return pd.DataFrame([tuple(r) for r in rows], columns=[*self.columns, "event_ms"])

    def _wait(self, frames: pd.DataFrame) -> None:
        if len(frames):
            plain = [frames[c].astype(object).where(frames[c].notna(), None).tolist() if c != "pixels" else [list(p) for p in frames[c]] for c in [*self.columns, "event_ms"]]
            self.waiting.put(list(zip(*plain, strict=True)))
        elif self.waiting.exists():
            self.waiting.clear()

    def _set(self, timer: int | None, left: pd.DataFrame, latest: int) -> int:
        """One timer for each key: when the first waiting frame is given no more time, else when the run counts as over."""
        wanted = int(left["event_ms"].min()) + self.patience if len(left) else latest + self.idle
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        return wanted


class RunMonitor(OrderedFrames):
    """Violation, restoration and success of each run, each reported once."""

    STATE = "trigger bigint, mismatch int, grasped boolean, restored boolean, won boolean, calm int, calm_phase array<boolean>, late bigint"
    START = (None, 0, False, False, False, 0, [], 0)
    FRAME = "seq bigint, force double, gripper double, gripper_command double, is_grasped boolean, success_now boolean, phase string"

    def late(self, key, state: tuple, seq: pd.Series) -> tuple[tuple, pd.DataFrame]:
        late = state[-1] + len(seq)
        return (*state[:-1], late), self._events(key, [("late-frame", int(s)) for s in seq], late)

    @staticmethod
    def _events(key, events: list[tuple[str, int]], late: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, kind, step, late) for kind, step in events], columns=["scenario", "seed", "variant", "type", "step", "late"])

    def advance(self, key, state: tuple, frames: pd.DataFrame) -> tuple[tuple, pd.DataFrame | None]:
        scenario = key[0]
        trigger, mismatch, grasped, restored, won, calm, calm_phase, late = state
        events: list[tuple[str, int]] = []
        seq = frames["seq"].to_numpy()
        force = frames["force"].to_numpy(dtype=float)
        flag = lambda c: frames[c].astype(object).where(frames[c].notna(), False).to_numpy(dtype=bool)
        held = flag("is_grasped")
        if trigger is None:
            if scenario == "collision":
                at = _first(force > FORCE_LIMIT)
            elif scenario == "gripper-failure":
                ignored = (frames["gripper_command"].to_numpy(dtype=float) < CLOSE) & (frames["gripper"].to_numpy(dtype=float) > OPEN)
                lengths = _trailing(ignored, mismatch or 0)
                at, mismatch = _first(lengths >= MISMATCH_FRAMES), int(lengths[-1])
            else:
                ever = np.logical_or.accumulate(np.concatenate(([bool(grasped)], held)))[:-1]
                at = _first(ever & ~held)
            if at is not None:
                trigger = int(seq[at]) + 1
                events.append(("predicate-violated", int(seq[at])))
        grasped = bool(grasped) or bool(held.any())
        if trigger is not None:
            after = seq >= trigger
            if not restored:
                if scenario == "collision":
                    # A recovery frame that opens three calm frames; known two frames later.
                    lengths = _trailing((force <= FORCE_LIMIT) & after, calm or 0)
                    in_phase = frames["phase"].fillna("").str.startswith("recovery_").to_numpy(dtype=bool)
                    known = np.concatenate((np.array(list(calm_phase or []), dtype=bool), in_phase & after))
                    shift = len(known) - len(seq)
                    opener = np.arange(len(seq)) + shift - (HOLD_FRAMES - 1)
                    opened = np.where(opener >= 0, known[np.maximum(opener, 0)], False)
                    at = _first((lengths >= HOLD_FRAMES) & opened)
                    step = None if at is None else int(seq[at]) - (HOLD_FRAMES - 1)
                    calm, calm_phase = int(lengths[-1]), [bool(x) for x in known[-(HOLD_FRAMES - 1):]]
                else:
                    at = _first(held & after)
                    step = None if at is None else int(seq[at])
                if step is not None:
                    restored = True
                    events.append(("predicate-restored", step))
            if not won:
                at = _first(flag("success_now") & after)
                if at is not None:
                    won = True
                    events.append(("recovery-success", int(seq[at])))
        return (trigger, mismatch, grasped, restored, won, calm, calm_phase, late), self._events(key, events, late) if events else None


class FrameMotion(OrderedFrames):
    """Mean change between consecutive frames; the last frame of each topic is kept. Late frames have no motion."""

    STATE = "pixels array<double>"
    START = (None,)
    FRAME = "seq bigint, pixels array<double>"

    def late(self, key, state: tuple, seq: pd.Series) -> tuple[tuple, pd.DataFrame]:
        return state, pd.DataFrame({"topic": key[0], "seq": seq.to_numpy(), "camera_motion": np.nan})

    def advance(self, key, state: tuple, frames: pd.DataFrame) -> tuple[tuple, pd.DataFrame | None]:
        (before,) = state
        shown = np.stack([np.asarray(p, dtype=float) for p in frames["pixels"]])
        start = shown[:1] if before is None else np.asarray(before, dtype=float)[None]
        motion = np.abs(np.diff(np.concatenate([start, shown]), axis=0)).mean(axis=1) / 255
        return (shown[-1].tolist(),), pd.DataFrame({"topic": key[0], "seq": frames["seq"].to_numpy(), "camera_motion": motion})


def _processed(frames: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, delay: str | None) -> DataFrame:
    """``delay`` names how much later than others a frame may come, where there is an ``event_time``.

    Frames get the types of the state they may wait in: an integer that waits as a double would come back as null.
    """
    typed = [f"cast(`{name}` AS {kind}) AS `{name}`" for name, kind in (c.split() for c in processor.FRAME.split(", "))]
    frames = frames.selectExpr(*[f"`{c}`" for c in frames.columns if c not in processor.columns], *typed)
    if delay is not None:
        frames = frames.withWatermark("event_time", delay)
    return frames.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="None" if delay is None else "EventTime"
    )


def monitor_runs(frames: DataFrame, delay: str | None = None, patience: int = PATIENCE_MS, idle: int = IDLE_MS) -> DataFrame:
    """Streaming events of ``RunMonitor`` over frames keyed by scenario, seed and variant; with a ``delay``, by their ``event_time``."""
    return _processed(frames, KEYS, RunMonitor(patience, idle), EVENTS, delay)


def stream_frame_motion(frames: DataFrame, delay: str | None = None, patience: int = PATIENCE_MS, idle: int = IDLE_MS) -> DataFrame:
    """Streaming frame motion over (topic, seq, pixels); with a ``delay``, by their ``event_time``."""
    return _processed(frames, ["topic"], FrameMotion(patience, idle), "topic int, seq bigint, camera_motion double", delay)


def run_to_files(stream: DataFrame, path: str) -> None:
    """Run a stream over what its source holds now and write its rows."""
    job = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    job.awaitTermination()


# ---- batch versions -------------------------------------------------------------------------------


def first_violations(frames: DataFrame, layout: Layout) -> DataFrame:
    """The step at which each run first violates the predicate of its scenario."""
    rows = layout.running(frames, {"_grasps": F.expr("int(coalesce(is_grasped, false))")})
    ignored = f"int(coalesce(gripper_command < {CLOSE} AND gripper > {OPEN}, false))"
    rows = layout.local(
        rows, lambda w: {"_ignored": F.sum(F.expr(ignored)).over(w.rowsBetween(1 - MISMATCH_FRAMES, 0))}, before=MISMATCH_FRAMES - 1
    )
    hit = (
        f"CASE scenario WHEN 'collision' THEN force > {FORCE_LIMIT} WHEN 'gripper-failure' THEN _ignored = {MISMATCH_FRAMES} "
        "ELSE _grasps > 0 AND NOT coalesce(is_grasped, false) END"
    )
    return rows.groupBy(*KEYS).agg(F.expr(f"min(seq) FILTER (WHERE {hit}) AS violation_step"))


def batch_events(frames: DataFrame, layout: Layout) -> DataFrame:
    """The same events as the stream: violation, restoration, success."""
    violated = first_violations(frames, layout)
    rows = layout.attach(frames, violated.withColumn("trigger", F.col("violation_step") + 1))
    rows = layout.local(
        rows,
        lambda w: {"_peak": F.max("force").over(w.rowsBetween(0, HOLD_FRAMES - 1)), "_full": F.lead("seq", HOLD_FRAMES - 1).over(w).isNotNull()},
        after=HOLD_FRAMES - 1,
    )
    restored = f"CASE scenario WHEN 'collision' THEN startswith(phase, 'recovery_') AND _full AND _peak <= {FORCE_LIMIT} ELSE is_grasped END"
    sums = rows.groupBy(*KEYS).agg(
        F.max("violation_step").alias("violated"),
        F.expr(f"min(seq) FILTER (WHERE seq >= trigger AND {restored}) AS restored"),
        F.expr("min(seq) FILTER (WHERE seq >= trigger AND success_now) AS won"),
    )
    entries = "array(named_struct('type', 'predicate-violated', 'step', violated), named_struct('type', 'predicate-restored', 'step', restored), named_struct('type', 'recovery-success', 'step', won))"
    return sums.selectExpr(*KEYS, f"inline({entries})").filter("step IS NOT NULL")
