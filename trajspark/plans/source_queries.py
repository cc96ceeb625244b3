"""Queries: sources, merges and set operations over the shared tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from trajspark.functions.layout import dense_positions
from trajspark.operators import detect, score, sinks, steps
from trajspark.plans.diagnosis_queries import EVENTS_SQL, PARTS, check, diagnosed, inspected, r, supplier_steps
from trajspark.plans.oracle import EP, statement
from trajspark.plans.registry import query, scratch_path
from trajspark.plans.telemetry import read_table, telemetry
from trajspark.sources import messages as ms
from trajspark.sources import tables as tb

STEP_SQL = check("SELECT episode_id, seq, timestamp, phase, joint_1, joint_2, ee_x, force_z, success FROM tele")
STEP_COLUMNS = ["episode_id", "seq", "timestamp", "phase", "joint_1", "joint_2", "ee_x", "force_z", "success"]


@query("read_csv_steps", STEP_SQL)
def read_csv_steps(spark, sf):
    """The telemetry view through CSV files."""
    path = scratch_path(spark, "csv")
    rows, _ = telemetry(spark, sf)
    rows = rows.select(*STEP_COLUMNS)
    sinks.write_csv(rows, path)
    return tb.read_csv_steps(spark, path, rows.schema)


@query("read_parquet_steps", STEP_SQL)
def read_parquet_steps(spark, sf):
    """A data folder beside a metadata folder: only the samples are read."""
    path = scratch_path(spark, "dataset")
    rows, _ = telemetry(spark, sf)
    rows = rows.select(*STEP_COLUMNS)
    rows.withColumn("observation.image", F.lit(b"x")).write.parquet(f"{path}/data/chunk-000")
    rows.groupBy("episode_id").count().write.parquet(f"{path}/meta/episodes")
    return tb.read_parquet_steps(spark, path)


@query("drop_media_columns", "SELECT page_id, url FROM pages")
def drop_media_columns(spark, sf):
    return tb.drop_media_columns(read_table(spark, sf, "pages").withColumnRenamed("html", "page_bytes"))


@query("resolve_episode_id", "SELECT cast(user_id AS VARCHAR) AS episode_id, count(*) AS rows FROM events GROUP BY 1")
def resolve_episode_id(spark, sf):
    rows = tb.resolve_episode_id(read_table(spark, sf, "events").withColumnRenamed("user_id", "episode_index"))
    return rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "derive_timestamp",
    "SELECT cast(l_suppkey AS VARCHAR) AS episode_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, "
    "round((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) / 30, 6) AS timestamp FROM lineitem",
)
def derive_timestamp(spark, sf):
    rows, _ = supplier_steps(spark, sf)
    return tb.derive_timestamp(rows.select("episode_id", "seq")).select("episode_id", "seq", r("timestamp").alias("timestamp"))


@query("expand_vector", "SELECT vec_id, " + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS joint_{i}" for i in range(1, 65)) + " FROM embeddings")
def expand_vector(spark, sf):
    rows = tb.expand_vector(read_table(spark, sf, "embeddings"), "embedding", "joint")
    return rows.select("vec_id", *[r(f"joint_{i}").alias(f"joint_{i}") for i in range(1, 65)])


@query("apply_aliases", "SELECT event_id, value AS force_z, event_type AS phase FROM events")
def apply_aliases(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", F.col("value").alias("observation.force_z"), F.col("event_type").alias("task_phase"))
    return tb.apply_aliases(events).select("event_id", "force_z", "phase")


@query("resolve_success_label", "SELECT o_orderkey, o_orderstatus = 'F' AS success, true AS success_known FROM orders")
def resolve_success_label(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("next.success"))
    return tb.resolve_success_label(orders).select("o_orderkey", "success", "success_known")


@query("join_task_names", "SELECT o_orderkey AS episode_id, n_name AS task FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_task_names(spark, sf):
    """Orders with the task (nation) of their customer."""
    customers = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("task_index"))
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode_id"), "o_custkey").join(customers, "o_custkey")
    tasks = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_index"), F.col("n_name").alias("task"))
    return tb.join_task_names(orders, tasks).select("episode_id", "task")


@query(
    "media_segments",
    "WITH f AS (SELECT printf('videos/cam/chunk-%03d/file-%03d.mp4', p_partkey // 100, p_partkey % 100) AS path FROM part), "
    "o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS no, count(*) OVER () AS n FROM f), "
    "e AS (SELECT o_orderkey AS episode_index, o_custkey // 100 % 30 AS chunk, o_custkey % 100 AS file, o_totalprice FROM orders "
    "UNION ALL SELECT -o_orderkey, 1000000000 + o_custkey // 100 % 30, o_custkey % 100, o_totalprice FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT episode_index, coalesce(f.path, o.path) AS path, round(o_totalprice / 1000, 6) AS start, greatest(0, 500 - round(o_totalprice / 1000, 6)) AS duration FROM e "
    "LEFT JOIN f ON f.path = printf('videos/cam/chunk-%03d/file-%03d.mp4', chunk, file) LEFT JOIN o ON o.no = least(file, n - 1)",
)
def media_segments(spark, sf):
    """All parts as media files; orders as episodes, every third once more with the name of a file that isn't there."""
    part, cust = F.col("p_partkey"), F.col("o_custkey")
    files = read_table(spark, sf, "part").select(F.format_string("videos/cam/chunk-%03d/file-%03d.mp4", F.floor(part / 100), part.cast("long") % 100).alias("path"))
    episodes = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("episode_index"), (F.floor(cust / 100) % 30).alias("chunk_index"), (cust % 100).alias("file_index"),
        F.round(F.col("o_totalprice") / 1000, 6).alias("from_timestamp"), F.lit(500.0).alias("to_timestamp"),
    )
    gone = episodes.filter("episode_index % 3 = 0").withColumns({"episode_index": -F.col("episode_index"), "chunk_index": F.col("chunk_index") + 1000000000})
    out = tb.media_segments(episodes.unionByName(gone), files, "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4", "cam")
    return out.select("episode_index", "path", "start", "duration")


@query("read_json_metadata", "SELECT c_custkey AS episode_id, CASE WHEN c_custkey % 4 = 0 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS fps, c_acctbal > 0 AS success FROM customer")
def read_json_metadata(spark, sf):
    """One side-car document per customer, written and read as JSON."""
    path = scratch_path(spark, "metadata")
    documents = read_table(spark, sf, "customer").selectExpr(
        "if(c_custkey % 4 = 0, NULL, 10D) AS fps", "array(named_struct('episode_id', c_custkey, 'success', c_acctbal > 0)) AS episodes"
    )
    sinks.write_json(documents, path)
    return tb.read_json_metadata(spark, path, "fps double, episodes array<struct<episode_id: bigint, success: boolean>>", multi_line=False)


TRAJ_SQL = (
    "SELECT cast(vec_id AS VARCHAR) AS episode_id, cast(i AS BIGINT) AS seq, round(i / 20, 6) AS timestamp, round(embedding[i + 1]::DOUBLE, 6) AS joint_1, round(embedding[i + 1]::DOUBLE * 2, 6) AS joint_2, "
    "round(embedding[i + 1]::DOUBLE + 1, 6) AS action_1, round(CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END, 6) AS phase, embedding[n + label % 3]::DOUBLE > 0 AS success "
    "FROM (SELECT *, 64 - label % 3 AS n FROM embeddings), range(64) t(i) WHERE i < n"
)


def trajectories(spark, sf):
    """Embeddings as trajectories of 64 rows: actions have label % 3 rows more and poses one, which the shortest array, qpos, leaves out."""
    return read_table(spark, sf, "embeddings").selectExpr(
        "concat('traj_', vec_id) AS traj",
        "transform(concat(embedding, slice(embedding, 1, coalesce(label % 3, 0))), x -> array(cast(x AS DOUBLE) + 1)) AS actions",
        "transform(embedding, x -> array(cast(x AS DOUBLE), cast(x AS DOUBLE) * 2)) AS qpos",
        "transform(concat(embedding, slice(embedding, 1, 1)), x -> array(cast(x AS DOUBLE), 0D, 0D)) AS tcp_pose",
        "transform(embedding, x -> array(1D, cast(x AS DOUBLE), 0.5D)) AS goal_pos",
        "transform(embedding, x -> int(x > 0)) AS success",
    )


@query(
    "explode_trajectory_arrays",
    "SELECT cast(vec_id AS VARCHAR) AS episode_id, cast(i AS BIGINT) AS seq, round(i / 20, 6) AS timestamp, round(embedding[i + 1]::DOUBLE, 6) AS joint_1, round(embedding[i + 1]::DOUBLE * 2, 6) AS joint_2, "
    "round(embedding[i + 1]::DOUBLE + 1, 6) AS action_1, round(i / 63, 6) AS phase, embedding[64]::DOUBLE > 0 AS success FROM embeddings, range(64) t(i)",
)
def explode_trajectory_arrays(spark, sf):
    rows = tb.explode_trajectory_arrays(trajectories(spark, sf))
    return rows.select(
        "episode_id", "seq", *[r(c).alias(c) for c in ("timestamp", "joint_1", "joint_2", "action_1")], r(F.col("phase").cast("double")).alias("phase"), "success"
    )


@query(
    "object_distance",
    "SELECT cast(vec_id AS VARCHAR) AS episode_id, cast(i AS BIGINT) AS seq, round(sqrt((1 - e) ** 2 + e ** 2 + 0.25), 6) AS object_distance FROM "
    "(SELECT vec_id, i, embedding[i + 1]::DOUBLE AS e FROM embeddings, range(64) t(i))",
)
def object_distance(spark, sf):
    rows = tb.explode_trajectory_arrays(trajectories(spark, sf))
    return rows.select("episode_id", "seq", r("object_distance").alias("object_distance"))


def message_log(spark, sf):
    """Events as a message log: one log per user, one topic and type per event type."""
    return read_table(spark, sf, "events").selectExpr(
        "user_id AS log_id", "event_id",
        "CASE event_type WHEN 'view' THEN '/joint_states' WHEN 'click' THEN '/tool/pose' WHEN 'error' THEN '/wrench' WHEN 'signup' THEN '/gripper/state' ELSE '/task/phase' END AS topic",
        "CASE event_type WHEN 'view' THEN 'sensor_msgs/JointState' WHEN 'click' THEN 'geometry_msgs/PoseStamped' WHEN 'error' THEN 'geometry_msgs/WrenchStamped' WHEN 'signup' THEN 'std_msgs/Float64' ELSE 'std_msgs/String' END AS msgtype",
        "unix_micros(cast(ts AS timestamp)) * 1000 AS ts_ns",
        "CASE event_type WHEN 'view' THEN to_json(named_struct('position', array(value, value + 1))) WHEN 'click' THEN to_json(named_struct('x', value, 'y', 1D, 'z', 2D)) "
        "WHEN 'error' THEN to_json(named_struct('x', 0D, 'y', 0D, 'z', value)) ELSE to_json(named_struct('data', cast(value AS STRING))) END AS payload",
    )


@query(
    "route_messages",
    "SELECT user_id AS log_id, CASE event_type WHEN 'view' THEN 'joint' WHEN 'click' THEN 'pose' WHEN 'error' THEN 'wrench' ELSE 'scalar' END AS stream, count(*) AS messages, "
    "round(sum((epoch_us(ts) - first_us) / 1e6), 3) AS seconds, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS joint_sum, round(sum(value) FILTER (WHERE event_type = 'error'), 4) AS force_sum, "
    "round(sum(value) FILTER (WHERE event_type = 'signup'), 4) AS gripper_sum FROM events JOIN (SELECT user_id, epoch_us(min(ts)) AS first_us FROM events GROUP BY 1) USING (user_id) GROUP BY 1, 2",
)
def route_messages(spark, sf):
    routed = ms.route_messages(message_log(spark, sf))
    return routed.groupBy("log_id", "stream").agg(
        F.count(F.lit(1)).alias("messages"), r(F.sum("timestamp"), 3).alias("seconds"), r(F.sum(F.get("position", F.lit(0))), 4).alias("joint_sum"),
        r(F.sum("force_z"), 4).alias("force_sum"), r(F.sum("gripper"), 4).alias("gripper_sum"),
    )


@query("stream_counts", "SELECT CASE event_type WHEN 'view' THEN '/joint_states' WHEN 'click' THEN '/tool/pose' WHEN 'error' THEN '/wrench' WHEN 'signup' THEN '/gripper/state' ELSE '/task/phase' END AS topic, count(*) AS messages FROM events GROUP BY 1")
def stream_counts(spark, sf):
    return ms.stream_counts(message_log(spark, sf))


@query("message_log_steps")
def message_log_steps(spark, sf):
    """The message logs as step tables."""
    return ms.message_log_steps(message_log(spark, sf))


MOTION_SQL = (
    "SELECT label AS topic, vec_id, round(coalesce(list_sum(list_transform(list_zip(embedding, before), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / 64 / 255, 0), 9) AS camera_motion "
    "FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)"
)


@query("frame_motion", MOTION_SQL)
def frame_motion(spark, sf):
    """Embeddings as grey frames, one topic per label."""
    frames = read_table(spark, sf, "embeddings").selectExpr("label AS topic", "vec_id", "transform(embedding, x -> cast(x AS DOUBLE)) AS pixels")
    frames, layout = dense_positions(frames, "topic", ["vec_id"])
    return tb.frame_motion(frames, layout).select("topic", "vec_id", r("camera_motion", 9).alias("camera_motion"))


@query("catalog_summary", check("SELECT phase AS id, true AS available, count(DISTINCT episode_id) AS episode_count, count(*) AS row_count FROM tele GROUP BY 1"))
def catalog_summary(spark, sf):
    """One data set per phase, written as files; sizes come from the file listing."""
    path = scratch_path(spark, "catalog")
    rows, _ = telemetry(spark, sf)
    rows.select("episode_id", "seq", "timestamp", "phase").write.partitionBy("phase").parquet(path)
    back = spark.read.parquet(path)
    entries = back.groupBy(F.col("phase").alias("id")).agg(F.count_distinct("episode_id").alias("episode_count"), F.count(F.lit(1)).alias("row_count"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "(phase=.*)", 1).alias("path"), "length")
    out = tb.catalog_summary(entries.withColumn("path", F.concat(F.lit("phase="), "id")), files)
    return out.select("id", (F.col("available") & (F.col("size_bytes") > 0)).alias("available"), "episode_count", "row_count")


@query("source_sha256", "SELECT doc_id, octet_length(encode(text)) AS length, sha256(text) AS sha256 FROM documents")
def source_sha256(spark, sf):
    """Every document as one file: its size and digest."""
    content = F.encode("text", "UTF-8")
    return read_table(spark, sf, "documents").select("doc_id", F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("sha256"))


@query(
    "verify_checksums",
    "SELECT cast(doc_id AS VARCHAR) AS file, sha256(text) AS actual FROM documents WHERE doc_id % 7 = 0 "
    "UNION ALL SELECT 'gone-' || cast(doc_id AS VARCHAR), NULL FROM documents WHERE doc_id % 20 = 0",
)
def verify_checksums(spark, sf):
    """All documents against a pinned list in which every seventh digest is stale; for every twentieth it names one more file, which isn't there."""
    files = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "doc_id")
    expected = files.select("file", F.when(F.col("doc_id") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = files.filter("doc_id % 20 = 0").select(F.concat(F.lit("gone-"), "file").alias("file"), "sha256")
    return sinks.verify_checksums(files, expected.unionByName(gone)).select("file", "actual")


# ---- joins and sets -------------------------------------------------------------------------------

TOL = "(SELECT episode_id, greatest(0.1, coalesce(3 * quantile_cont(d, 0.5) FILTER (WHERE d > 0), 0)) AS tol FROM (SELECT episode_id, t - lag(t) OVER (PARTITION BY episode_id ORDER BY t) AS d FROM {}) GROUP BY 1)"
MERGE_PARTS = PARTS | {
    "lead_s": "SELECT episode_id, t, arg_max(joint_1, seq) FILTER (WHERE joint_1 IS NOT NULL) AS joint_1 FROM (SELECT episode_id, timestamp AS t, seq, joint_1 FROM tele "
    "UNION ALL SELECT episode_id, timestamp + 1000000, seq, joint_1 FROM tele WHERE seq % 5 = 0) GROUP BY 1, 2",
    "wr_s": "SELECT episode_id, timestamp + 0.015625::DOUBLE AS t, arg_max(force_z, seq) AS force_z FROM tele GROUP BY 1, 2",
    "sc_s": "SELECT episode_id, timestamp - 0.28125::DOUBLE AS t, arg_max(gripper, seq) AS gripper FROM tele GROUP BY 1, 2",
    "j1": "SELECT l.*, w1.t AS wt1, w1.force_z AS wv1, w2.t AS wt2, w2.force_z AS wv2, s1.t AS st1, s1.gripper AS sv1, s2.t AS st2, s2.gripper AS sv2, wt.tol AS wtol, stl.tol AS stol FROM lead_s l "
    "ASOF LEFT JOIN wr_s w1 ON l.episode_id = w1.episode_id AND l.t >= w1.t ASOF LEFT JOIN wr_s w2 ON l.episode_id = w2.episode_id AND l.t <= w2.t "
    "ASOF LEFT JOIN sc_s s1 ON l.episode_id = s1.episode_id AND l.t >= s1.t ASOF LEFT JOIN sc_s s2 ON l.episode_id = s2.episode_id AND l.t <= s2.t "
    f"LEFT JOIN {TOL.format('wr_s')} wt ON wt.episode_id = l.episode_id LEFT JOIN {TOL.format('sc_s')} stl ON stl.episode_id = l.episode_id",
}


def _nearest(t1: str, v1: str, t2: str, v2: str, tol: str) -> str:
    return f"CASE WHEN least(t - {t1}, {t2} - t) <= {tol} THEN CASE WHEN {t2} IS NULL OR t - {t1} <= {t2} - t THEN {v1} ELSE {v2} END END"


@query(
    "asof_merge_streams",
    statement(MERGE_PARTS, f"SELECT episode_id, t AS timestamp, joint_1, {_nearest('wt1', 'wv1', 'wt2', 'wv2', 'wtol')} AS force_z, {_nearest('st1', 'sv1', 'st2', 'sv2', 'stol')} AS gripper FROM j1"),
)
def asof_merge_streams(spark, sf):
    """All samples of three streams, two of them shifted in time; the joint stream has samples after the others' end, too."""
    rows, _ = telemetry(spark, sf)
    whole = lambda column, shift: rows.select("episode_id", (F.col("timestamp") + F.lit(shift)).alias("timestamp"), "seq", column)
    late = whole("joint_1", 1e6).filter("seq % 5 = 0")
    joint = rows.select("episode_id", "timestamp", "seq", "joint_1").unionByName(late)
    return ms.asof_merge_streams({"scalar": whole("gripper", -0.28125), "joint": joint, "wrench": whole("force_z", 0.015625)})


@query("last_non_null", "SELECT user_id AS episode_id, date_trunc('day', ts)::DATE AS day, arg_max(value, event_id) FILTER (WHERE value > 20) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2")
def last_non_null(spark, sf):
    """The last known value per user and day."""
    rows = read_table(spark, sf, "events").select(
        F.col("user_id").alias("episode_id"), F.to_date("ts").alias("timestamp"), "event_id", F.when(F.col("value") > 20, F.col("value")).alias("value"), "event_type"
    )
    return ms.last_known(rows, ["episode_id"], "event_id").withColumnRenamed("timestamp", "day")


@query("concat_frames", check("SELECT episode_id, seq, joint_1, NULL::DOUBLE AS force_z FROM tele WHERE seq % 2 = 0 UNION ALL SELECT episode_id, seq, NULL, force_z FROM tele WHERE seq % 2 = 1"))
def concat_frames(spark, sf):
    rows, _ = telemetry(spark, sf)
    even, odd = rows.filter("seq % 2 = 0").select("episode_id", "seq", "joint_1"), rows.filter("seq % 2 = 1").select("episode_id", "seq", "force_z")
    return even.unionByName(odd, allowMissingColumns=True)


@query("first_seen_episodes", "SELECT cast(user_id AS VARCHAR) AS episode_id, min(event_id) AS first_row FROM events GROUP BY 1")
def first_seen_episodes(spark, sf):
    """Distinct episodes in the order in which they first occur."""
    events = read_table(spark, sf, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("episode_id")).agg(F.min("event_id").alias("first_row")).orderBy("first_row")


# ---- document sinks -------------------------------------------------------------------------------


@query(
    "audit_csv",
    check(
        "SELECT episode_id, quality_score, grade, success, true AS success_known, duration, round_even(missing_rate * 100, 3) AS missing_rate, cast(issue_count AS INT) AS issue_count, cast(critical_count AS INT) AS critical_count, "
        "primary_cause, issue_codes, completeness, temporal, motion, sync, safety, 'none' AS source_sha256 FROM eps"
    ),
)
def audit_csv(spark, sf):
    path = scratch_path(spark, "audit")
    table = sinks.audit_table(diagnosed(spark, sf), "none")
    sinks.write_csv(table, path)
    return spark.read.csv(path, header=True, schema=table.schema)


@query("audit_json", check("SELECT episode_id, quality_score, grade, len(string_split(issue_codes, ';')) AS issues, string_split(issue_codes, ';')[1] AS first_code FROM eps"))
def audit_json(spark, sf):
    """Episode documents written as text and parsed again."""
    path = scratch_path(spark, "analysis")
    sinks.write_text(sinks.analysis_json(diagnosed(spark, sf)), "json", path)
    parsed = spark.read.text(path).select(F.from_json("value", "episode_id string, quality_score double, grade string, issues array<struct<code: string>>").alias("d"))
    return parsed.selectExpr("d.episode_id", "d.quality_score", "d.grade", "cast(size(d.issues) AS BIGINT) AS issues", "d.issues[0].code AS first_code")


@query("render_report")
def render_report(spark, sf):
    return sinks.render_report(diagnosed(spark, sf), "telemetry")


@query(
    "export_signal_log",
    statement(
        PARTS | {"ev": EVENTS_SQL},
        "SELECT path, count(*) AS entries, round(sum(value), 6) AS total FROM ("
        + " UNION ALL ".join(f"SELECT 'signals/{c}' AS path, {c}::DOUBLE AS value FROM tele WHERE {c} IS NOT NULL" for c in ("force_z", "gripper", "object_distance", "camera_motion", "joint_1", "joint_2"))
        + " UNION ALL SELECT 'world/end_effector/ee_x', ee_x FROM tele UNION ALL SELECT 'world/end_effector/ee_y', ee_y FROM tele UNION ALL SELECT 'diagnostics/events', NULL FROM ev UNION ALL SELECT 'diagnostics/summary', NULL FROM eps) GROUP BY 1",
    ),
)
def export_signal_log(spark, sf):
    d = inspected(spark, sf)
    rows, _ = telemetry(spark, sf)
    log = sinks.signal_log(d, score.score_episodes(d), rows)
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), r(F.sum("value"), 6).alias("total"))
