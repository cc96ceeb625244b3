"""Files to steps and digests, with what real inputs bring: other column orders, nested folders, bad values."""

import hashlib

import numpy as np
import pytest

from trajspark.functions.layout import Layout
from trajspark.operators import readiness, score, sinks
from trajspark.operators import timeseries as ts
from trajspark.operators.steps import validate_steps
from trajspark.sources import messages as ms
from trajspark.sources import tables as tb


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,joint_1,episode_id,seq\n0.1,1.5,7,1\nbad,2.5,7,0\n0.2,3.5,7,2\n")
    rows = tb.read_csv_steps(spark, str(tmp_path / "a.csv"), "seq long, episode_id string, timestamp double, joint_1 double").orderBy("seq").collect()
    assert [(r.seq, r.episode_id, r.timestamp, r.joint_1) for r in rows] == [(0, "7", 0.1, 1.5), (1, "7", 0.2, 3.5)]
    with pytest.raises(ValueError, match="force_z"):
        tb.read_csv_steps(spark, str(tmp_path / "a.csv"), "episode_id string, timestamp double, force_z double")
    (tmp_path / "b.csv").write_text("timestamp,episode_id\nbad,7\n")
    with pytest.raises(ValueError, match="no valid time"):
        tb.read_csv_steps(spark, str(tmp_path / "b.csv"), "episode_id string, timestamp double")


def test_csv_without_positions_to_diagnosis(spark, tmp_path):
    lines = [f"{0.1 * k:.1f},{'a' if k % 2 else 'b'},{0.01 * k}" for k in range(40)]
    (tmp_path / "a.csv").write_text("\n".join(["timestamp,episode_id,joint_1", *lines]) + "\n")
    steps = tb.load_steps(spark, str(tmp_path / "a.csv"), "episode_id string, timestamp double, joint_1 double")
    assert sorted((r.episode_id, r.seq, r.timestamp) for r in steps.collect())[:3] == [("a", 0, 0.1), ("a", 1, 0.3), ("a", 2, 0.5)]
    assert sorted((r.episode_id, r.rows) for r in score.diagnose(steps).collect()) == [("a", 20), ("b", 20)]


def test_folder_to_diagnosis(spark, tmp_path):
    root = tmp_path / "robot" / "data" / "robot"
    rows = [(e, k, [0.01 * k, 0.02 * k]) for e in range(2) for k in range(30)]
    frame = spark.createDataFrame(rows, "episode_index int, frame_index int, `action` array<double>")
    frame.coalesce(1).write.parquet(str(root / "data" / "chunk-000"))
    spark.createDataFrame([(1, "x")], "task_index int, task string").coalesce(1).write.parquet(str(root / "meta"))
    files = tb.data_files(spark, str(root))
    assert files and all("/data/chunk-000/" in f for f in files)
    steps = tb.load_steps(spark, str(root))
    assert sorted(r.seq for r in steps.where("episode_id = '1'").collect()) == list(range(30))
    assert score.diagnose(steps).count() == 2


def test_dropped_rows_leave_no_holes(spark):
    rows = [("e", k, None if k == 1 else 0.1 * k, v) for k, v in enumerate([5.0, 9.0, None, 6.0])]
    steps = validate_steps(spark.createDataFrame(rows, "episode_id string, seq long, timestamp double, joint_1 double"))
    filled = ts.interpolate_positional(steps, Layout(), ["joint_1"]).orderBy("seq").collect()
    assert [(r.seq, r["joint_1__fill"]) for r in filled] == [(0, 5.0), (1, 5.5), (2, 6.0)]


def test_later_frames_may_be_wider(spark):
    rows = [("traj_1", [[1.0], [1.0, 2.0]], [[0.5], [0.5, 0.7, 0.9]])]
    out = tb.explode_trajectory_arrays(spark.createDataFrame(rows, "traj string, qpos array<array<double>>, actions array<array<double>>"))
    assert {"joint_2", "action_3"} <= set(out.columns)


def test_catalog_counts_nested_files(spark):
    entries = spark.createDataFrame([("a", "sets/a", 1, 2), ("b", "sets/b", 1, 2)], "id string, path string, episode_count long, row_count long")
    files = spark.createDataFrame([("sets/a/data/chunk-000/x.parquet", 5), ("sets/a/info.json", 2), ("sets/ab/y", 9)], "path string, length long")
    assert {r.id: (r.available, r.size_bytes) for r in tb.catalog_summary(entries, files).collect()} == {"a": (True, 7), "b": (False, 0)}


def test_digests_by_relative_path(spark, tmp_path):
    (tmp_path / "one" / "x").mkdir(parents=True)
    (tmp_path / "two" / "y").mkdir(parents=True)
    (tmp_path / "one" / "x" / "file-000.bin").write_bytes(b"1")
    (tmp_path / "one" / "file-000.bin").write_bytes(b"2")
    (tmp_path / "two" / "y" / "file-000.bin").write_bytes(b"1")
    (tmp_path / "two" / "file-000.bin").write_bytes(b"2")
    digest = {n: hashlib.sha256(c).hexdigest() for n, c in (("x/file-000.bin", b"1"), ("file-000.bin", b"2"))}
    actual = sinks.source_sha256(spark, str(tmp_path / "one"))
    assert {r.file: r.sha256 for r in actual.collect()} == digest
    pinned = spark.createDataFrame([*digest.items(), ("gone", "0")], "file string, sha256 string")
    assert [r.file for r in sinks.verify_checksums(actual, pinned).collect()] == ["gone"]
    one, two = (sinks.directory_sha256(spark, str(tmp_path / n)).first().sha256 for n in ("one", "two"))
    assert one != two


@pytest.mark.parametrize("layout", [Layout(), Layout(chunk_rows=8)])
def test_quantiles_of_finite_values(spark, layout):
    values = [float(k) for k in range(60)] + [float("nan")] * 30 + [float("inf"), None]
    rows = spark.createDataFrame([("e", k, v) for k, v in enumerate(values)], "episode_id string, seq long, v double")
    assert layout.quantiles(rows, {"m": (rows.v, 0.5)}).first().m == 29.5


def test_infinite_values_are_gaps(spark):
    rows = [("e", k, 0.1 * k, v) for k, v in enumerate([1.0, float("inf"), 3.0])]
    out = ts.short_gap_interpolate(spark.createDataFrame(rows, "episode_id string, seq long, timestamp double, joint_1 double"), Layout(), ["joint_1"])
    assert [round(r.joint_1, 9) for r in out.orderBy("seq").collect()] == [1.0, 2.0, 3.0]


def test_long_episodes_go_their_own_way(spark, monkeypatch):
    rows = [(e, k, 0.1 * k, 0.01 * k, "reach", True) for e, n in (("long", 90), ("a", 12), ("b", 9)) for k in range(n)]
    steps = spark.createDataFrame(rows, "episode_id string, seq long, timestamp double, joint_1 double, phase string, success boolean")
    parts = Layout.split(steps, limit=20)
    assert [(way.whole, rows.select("episode_id").distinct().count()) for rows, way in parts] == [(True, 2), (False, 1)]
    whole = readiness.readiness(steps, Layout()).select("episode_id", "rows", "score", "status")
    split = [readiness.readiness(r, way).select("episode_id", "rows", "score", "status") for r, way in parts]
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for p in split for r in p.collect())


def test_lag_of_slow_and_fast_episodes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for episode, n, period, lag in (("slow", 60, 0.1, 2), ("fast", 400, 0.01, 25), ("short", 25, 0.1, 0)):
        signal = rng.normal(size=n + lag)
        rows += [(episode, k, period * k, float(signal[k + lag]), float(signal[k])) for k in range(n)]
    steps = spark.createDataFrame(rows, "episode_id string, seq long, timestamp double, speed double, camera double")
    for layout in (Layout(), Layout(chunk_rows=50)):
        timed = ts.with_period(ts.step_interval(steps, layout), layout)
        found = {r.episode_id: (r.lag, round(r.confidence, 6)) for r in ts.sync_offset(timed, layout, "speed", "camera", 0.5).collect()}
        assert found == {"slow": (2, 1.0), "fast": (25, 1.0), "short": (0, 1.0)}


def test_message_log_to_steps(spark):
    rows = []
    add = lambda log, ns, topic, kind, payload: rows.append((log, topic, kind, ns * 50_000_000, payload))
    for k in range(40):
        add("a", k, "/joint_states", "sensor_msgs/JointState", f'{{"position": [{k}.0, {2 * k}.0{", 5.0" if k == 30 else ""}]}}')
        add("a", k, "/tool/pose", "geometry_msgs/PoseStamped", f'{{"x": {k}.5, "y": 0.0, "z": 1.0}}')
        add("b", k, "/tool/pose", "geometry_msgs/PoseStamped", f'{{"x": {k}.5, "y": 0.0, "z": 1.0}}')
    add("a", 20, "/gripper/state", "std_msgs/Float64", '{"data": "0.5"}')
    add("a", 39, "/task/success", "std_msgs/Bool", '{"data": "false"}')
    add("a", 40, "/task/success", "std_msgs/Bool", '{"data": "true"}')
    log = spark.createDataFrame(rows, "log_id string, topic string, msgtype string, ts_ns long, payload string")
    steps = ms.message_log_steps(log).orderBy("episode_id", "seq").collect()
    assert [(r.episode_id, r.seq) for r in steps] == [(e, k) for e in "ab" for k in range(40)]
    assert [(r.joint_1, r.joint_2, r.ee_x) for r in steps[:40]] == [(k, 2 * k, k + 0.5) for k in map(float, range(40))]
    assert [r.seq for r in steps[:40] if r.joint_3 is not None] == [30]
    assert {19, 20, 21} <= {r.seq for r in steps[:40] if r.gripper is not None} <= {18, 19, 20, 21, 22}
    assert {(r.episode_id, r.success, r.success_known) for r in steps} == {("a", True, True), ("b", None, False)}
    assert all(r.joint_1 is None and r.ee_x == r.seq + 0.5 for r in steps[40:])
