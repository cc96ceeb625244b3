"""Sources that are tables: CSV and Parquet step files, vector columns, trajectory arrays, metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions.layout import DEFAULT_CHUNK_ROWS, Layout, dense_positions
from trajspark.functions.lineage import materialise
from trajspark.operators.steps import require_rows, validate_steps

# Names in robot data sets.
MEDIA_MARKS = ("image", "video", "jpeg", "bytes")
EPISODE_NAMES = ("episode_id", "episode_index", "episode")
STATE_NAMES = ("observation.state", "observation_state", "state")
ACTION_NAMES = ("action", "actions")
POSE_NAMES = ("observation.ee_pose", "observation.end_effector_pose", "ee_pose")
SCALAR_ALIASES = {
    "observation.gripper": "gripper",
    "observation.gripper_position": "gripper",
    "observation.force_z": "force_z",
    "observation.camera_motion": "camera_motion",
    "observation.object_distance": "object_distance",
    "task_phase": "phase",
    "next.reward": "reward",
    "next.done": "done",
}
DEFAULT_FPS, ARRAY_FPS = 30.0, 20.0
ROW_PLACE = ("_metadata.file_path", "_metadata.row_index")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def read_csv_steps(spark: SparkSession, path: str, schema: T.StructType | str, order: str = "seq") -> DataFrame:
    """CSV with a header; columns are found by their names, in any order. Headers of all files must be alike.

    Without the order column, rows count in the order of files and lines. No row with a time is an error.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.csv(path, header=True, enforceSchema=False)
    absent = sorted({f.name for f in fields} - set(lines.columns) - {order})
    if absent:
        raise ValueError(f"columns {', '.join(absent)} are not in the header of {path}")
    typed = [quoted(f.name).try_cast(f.dataType).alias(f.name) for f in fields if f.name in lines.columns]
    if order in lines.columns:
        steps = lines.select(*typed).withColumnRenamed(order, "seq")
    else:
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
        steps, _ = dense_positions(lines.select(*typed, *place), "episode_id", ["_file", "_block", "_line"])
        steps = steps.drop("_file", "_block", "_line")
    return require_rows(validate_steps(steps), f"no valid time in {path}")


def data_files(spark: SparkSession, path: str, ending: str = ".parquet") -> list[str]:
    """Sample files below a path: those in a ``data`` folder or named ``episode_*``; else all of them."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = system.makeQualified(root).toString().rstrip("/")
    found = system.listFiles(root, True)
    names = []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(ending):
            names.append(name)
    inside = lambda n: n[len(top):].lower().split("/")
    samples = [n for n in names if "data" in inside(n)[:-1] or inside(n)[-1].startswith("episode_")]
    return sorted(samples or names)


def read_parquet_steps(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    """Sample files only, media columns left out of the scan. ``with_position`` adds file and row index."""
    files = data_files(spark, path)
    if not files:
        raise ValueError(f"no Parquet sample files under {path}")
    steps = drop_media_columns(spark.read.parquet(*files))
    if with_position:
        steps = steps.select("*", *ROW_PLACE)
    return steps


def drop_media_columns(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if not any(m in c.lower() for m in MEDIA_MARKS)])


def resolve_episode_id(df: DataFrame) -> DataFrame:
    source = next((n for n in EPISODE_NAMES if n in df.columns), None)
    return df.withColumn("episode_id", quoted(source).cast("string") if source else F.lit("EP-000"))


def derive_timestamp(df: DataFrame, fps: float | None = None) -> DataFrame:
    """Keep the time; else frame_index / fps; else position / fps (needs ``seq``)."""
    rate = max(fps or DEFAULT_FPS, 1e-6)
    if "timestamp" in df.columns:
        return df.withColumn("timestamp", F.col("timestamp").try_cast("double"))
    source = "frame_index" if "frame_index" in df.columns else "seq"
    return df.withColumn("timestamp", F.col(source).try_cast("double") / rate)


def vector_width(df: DataFrame, column: str) -> int:
    """Longest vector; one small job."""
    return df.agg(F.max(F.size(quoted(column)))).first()[0] or 0


def expand_vector(df: DataFrame, source: str, prefix: str, width: int | None = None) -> DataFrame:
    """List column -> ``<prefix>_1..n``, short rows padded with null; a pose's first three are ee_x/y/z."""
    width = vector_width(df, source) if width is None else width
    names = [f"{prefix}_{i + 1}" for i in range(width)]
    if prefix == "ee" and width >= 3:
        names[:3] = ["ee_x", "ee_y", "ee_z"]
    return df.select("*", *[F.get(quoted(source), F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def apply_aliases(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    for source, target in SCALAR_ALIASES.items():
        if source in df.columns and target not in df.columns and target not in new:
            new[target] = quoted(source)
    return df.select("*", *[c.alias(t) for t, c in new.items()])


def resolve_success_label(df: DataFrame, labelled: bool = True) -> DataFrame:
    """``labelled`` is false when the source's manifest says that its labels are not real."""
    if "success" in df.columns:
        return df.withColumn("success_known", F.lit(True))
    if "next.success" in df.columns and labelled:
        return df.withColumns({"success": quoted("next.success").cast("boolean"), "success_known": F.lit(True)})
    return df.withColumn("success_known", F.lit(False))


def join_task_names(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """``tasks``: task_index, task. Spark broadcasts it when its measured size allows."""
    return df.join(tasks, "task_index", "left")


def vector_data_set(df: DataFrame, fps: float | None = None, robot_type: str = "", labelled: bool = True, tasks: DataFrame | None = None) -> DataFrame:
    """Vector-column table -> step table."""
    out = derive_timestamp(resolve_episode_id(df), fps)
    pick = lambda names: next((n for n in names if n in df.columns), None)
    state, action, pose = pick(STATE_NAMES), pick(ACTION_NAMES), pick(POSE_NAMES)
    if state:
        width = vector_width(df, state)
        prefix = "state" if width <= 3 and robot_type.lower() in ("", "unknown") and pose is None else "joint"
        out = expand_vector(out, state, prefix, width)
    if action:
        out = expand_vector(out, action, "action")
    if pose:
        out = expand_vector(out, pose, "ee")
    out = resolve_success_label(apply_aliases(out), labelled)
    if tasks is not None and "task_index" in out.columns:
        out = join_task_names(out, tasks)
    return validate_steps(out)


# ---- media ----------------------------------------------------------------------------------------


def formatted(template: str, fields: dict[str, Column]) -> Column:
    """A path template such as ``videos/{video_key}/chunk-{chunk_index:03d}`` as a column."""
    parts: list[Column] = []
    for text, name, width in re.findall(r"([^{]*)(?:\{(\w+)(?::0(\d+)d)?\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = fields[name].cast("string")
            parts.append(F.when(F.length(value) < int(width), F.lpad(value, int(width), "0")).otherwise(value) if width else value)
    return F.concat(*parts)


def numbered_paths(files: DataFrame) -> DataFrame:
    """(path, _no, _range): places from 0 in the order of the paths, over sampled ranges of the whole path, so no prefix gathers all files."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = materialise(files.select("path").repartitionByRange(n, "path").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("path")) - 1
    rows = dealt.withColumn("_row", inside).join(F.broadcast(offsets), "_range")
    return rows.select("path", (F.col("_row") + F.col("_offset")).cast("long").alias("_no"), "_range")


def media_segments(episodes: DataFrame, files: DataFrame, template: str, feature: str) -> DataFrame:
    """Media file, start, end and duration per episode.

    ``episodes``: episode_index, chunk_index, file_index, from_timestamp, to_timestamp. ``files``: relative
    ``path`` of every media file. A path that does not exist falls back to the file with that number in
    sorted order, or the last one.
    """
    fields = {"video_key": F.lit(feature), "chunk_index": F.col("chunk_index"), "file_index": F.col("file_index"), "episode_index": F.col("episode_index"), "episode_chunk": F.col("chunk_index")}
    ordered = numbered_paths(files)
    count = files.agg(F.count(F.lit(1)).alias("_files"))
    wanted = episodes.withColumn("_wanted", formatted(template, fields)).crossJoin(F.broadcast(count))
    exact = files.select(F.col("path").alias("_wanted"), F.col("path").alias("_exact"))
    wanted = wanted.join(exact, "_wanted", "left").withColumn("_no", F.least(F.col("file_index").cast("long"), F.col("_files") - 1))
    spare = ordered.select("_no", F.col("path").alias("_spare"))
    return wanted.join(spare, "_no", "left").select(
        "episode_index", F.lit(feature).alias("feature"), F.coalesce("_exact", "_spare").alias("path"),
        F.col("from_timestamp").alias("start"), F.col("to_timestamp").alias("end"),
        F.greatest(F.lit(0.0), F.col("to_timestamp") - F.col("from_timestamp")).alias("duration"),
    )


# ---- JSON metadata, catalogues --------------------------------------------------------------------


def read_json_metadata(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Side-car documents with fps and per-episode outcomes, one row per episode."""
    documents = spark.read.schema(schema).json(path, multiLine=multi_line)
    return documents.select(F.coalesce("fps", F.lit(ARRAY_FPS)).alias("fps"), F.explode("episodes").alias("e")).select("fps", "e.*")


def catalog_summary(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Data sets with availability and size. ``entries``: id, path, episode_count, row_count; ``files``: path, length.

    Duplicate ids are an error.
    """
    if not entries.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("data set ids must be unique")
    # A file counts for every folder above it.
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = files.where(F.instr("path", "/") > 0).select(F.explode(folders).alias("path"), "length")
    sizes = inside.groupBy("path").agg(F.sum("length").alias("size_bytes"))
    return entries.join(sizes, "path", "left").select(
        "id", F.col("size_bytes").isNotNull().alias("available"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "episode_count", "row_count"
    )


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.filter("available").agg(
        F.count(F.lit(1)).alias("available_count"), F.sum("episode_count").alias("episode_count"), F.sum("row_count").alias("row_count")
    )


# ---- trajectory arrays ----------------------------------------------------------------------------


def explode_trajectory_arrays(
    trajectories: DataFrame, widths: dict[str, int] | None = None, fps: float = ARRAY_FPS, outcomes: DataFrame | None = None
) -> DataFrame:
    """One row per trajectory with arrays -> step table. All arrays are cut to the shortest of actions, qpos,
    tcp_pose and timestamps. ``widths`` gives the channels of qpos and actions (else one small job each)."""
    has = lambda c: c in trajectories.columns
    leading = [c for c in ("actions", "qpos", "tcp_pose", "timestamps") if has(c)]
    if not leading:
        raise ValueError("no time arrays found")
    widths = dict(widths or {})
    for c in ("qpos", "actions"):
        if has(c) and c not in widths:
            widths[c] = trajectories.agg(F.max(F.array_max(F.transform(c, F.size)))).first()[0] or 0
    sizes = [F.size(c) for c in leading]
    n = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    rows = trajectories.withColumn("_n", n).filter("_n > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    at = lambda c, j=None: F.get(F.col(c), F.col("_i")) if j is None else F.get(F.get(F.col(c), F.col("_i")), F.lit(j))
    out = {
        "episode_id": F.regexp_replace(F.col("traj").cast("string"), "^traj_", ""),
        "seq": F.col("_i").cast("long"),
        "timestamp": at("timestamps") - F.get(F.col("timestamps"), F.lit(0)) if has("timestamps") else F.col("_i") / max(fps, 1e-6),
    }
    for source, prefix in (("qpos", "joint"), ("actions", "action")):
        if has(source):
            out |= {f"{prefix}_{j + 1}": at(source, j) for j in range(widths[source])}
    axes = ("x", "y", "z")
    if has("tcp_pose"):
        out |= {f"ee_{a}": at("tcp_pose", j) for j, a in enumerate(axes)}
    if has("obj_pose"):
        out |= {f"object_{a}": at("obj_pose", j) for j, a in enumerate(axes)}
    if has("goal_pos") and (has("obj_pose") or has("tcp_pose")):
        body = "obj_pose" if has("obj_pose") else "tcp_pose"
        out["object_distance"] = point_distance(F.get(F.col("goal_pos"), F.col("_i")), F.get(F.col(body), F.col("_i")))
    if has("force"):
        out["force_z"] = F.when(F.size(at("force")) >= 3, at("force", 2)).otherwise(at("force", 0))
    for c in ("camera_motion", "frame_valid", "gripper", "gripper_command", "reward"):
        if has(c):
            out[c] = at(c)
    if has("is_grasped"):
        out["is_grasped"] = at("is_grasped").cast("boolean")
    share = F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    out["phase"] = at("phase") if has("phase") else share.cast("string")
    last = F.element_at("success", -1).cast("boolean") if has("success") else F.lit(None).cast("boolean")
    if outcomes is not None:
        rows = rows.withColumn("_id", out["episode_id"]).join(outcomes.select(F.col("episode_id").alias("_id"), F.col("success").alias("_told")), "_id", "left")
        last = F.coalesce(F.col("_told"), last)
    out["success"] = last
    out["success_known"] = last.isNotNull()
    return rows.select(*[v.alias(k) for k, v in out.items()])


def point_distance(a: Column, b: Column, axes: int = 3) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(F.slice(a, 1, axes), F.slice(b, 1, axes), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def frame_motion(frames: DataFrame, layout: Layout, pixels: str = "pixels") -> DataFrame:
    """Mean absolute change of the pixels of consecutive frames over 255; 0 on the first frame."""
    rows = layout.local(frames, lambda w: {"_last": F.lag(pixels).over(w)}, before=1)
    change = F.aggregate(F.zip_with(pixels, "_last", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(pixels) / 255
    return rows.withColumn("camera_motion", F.coalesce(change, F.lit(0.0))).drop("_last")


# ---- choice of reader -----------------------------------------------------------------------------


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``seq``: the place of each row in its episode, by file and row; kept where the source has it."""
    if "seq" not in rows.columns:
        rows, _ = dense_positions(resolve_episode_id(rows), "episode_id", ["file_path", "row_index"])
    return rows.drop("file_path", "row_index")


def load_steps(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Choose the reader by the file ending."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        if schema is None:
            raise ValueError("CSV needs a schema")
        return read_csv_steps(spark, path, schema)
    if lower.endswith((".parquet", ".pq")):
        return vector_data_set(numbered_rows(drop_media_columns(spark.read.parquet(path)).select("*", *ROW_PLACE)))
    if data_files(spark, path):
        return vector_data_set(numbered_rows(read_parquet_steps(spark, path, with_position=True)))
    raise ValueError("unknown format; supported: .csv, .parquet, .pq, folder with Parquet files")
