"""Documents, paths, layout, and reading back what was written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import query, r6, spread, sql_r6
from armature.operators import metadata as D
from armature.operators import quality as A
from armature.schema import CAMERA_FIRST_PATH, CHUNK_FIRST_PATH, KEYS, POS
from armature.session import new_dir
from armature.sources import scan, sink

FRAME = [*KEYS, POS]


def _documents(fx):
    """One info document per part, with fields present or missing by its numbers."""
    key, size = F.col("p_partkey"), F.col("p_size")
    some = lambda n, text: F.when(key % n == 0, F.lit(text)).otherwise(F.lit(""))
    codec = F.when(key % 4 == 0, "h264").otherwise("av1")
    shape = F.when(key % 13 == 0, "[480, 640]").otherwise("[480, 640, 3]")
    height = some(3, ', "video.height": 120')
    text = F.concat(
        F.lit('{"codebase_version": "'),
        F.when(key % 2 == 0, "v3.0").otherwise("v2.1"),
        F.lit('", "robot_type": "arm", "fps": 30, "total_episodes": '),
        size.cast("string"),
        F.lit(', "video_path": "'),
        F.when(key % 3 == 0, CAMERA_FIRST_PATH).otherwise(CHUNK_FIRST_PATH),
        F.lit('"'),
        some(5, ', "total_videos": 7'),
        some(7, ', "total_chunks": 3'),
        some(11, ', "data_files_size_in_mb": 100'),
        F.lit(', "features": {"action": {"dtype": "float32", "shape": [6]}, '),
        F.lit('"observation.images.front": {"dtype": "video", "shape": [480, 640, 3], "info": {"video.fps": 30.5, "video.codec": "'),
        codec,
        F.lit('"'),
        height,
        F.lit('}}, "observation.images.wrist": {"dtype": "video", "shape": '),
        shape,
        F.lit("}}}"),
    )
    return fx.table("part").select(key.alias("dataset"), text.alias("info"))


def _get(path: str) -> Column:
    return F.try_variant_get(F.col("_info"), path, "string")


_FRONT = "$.features['observation.images.front'].info"
_WRIST = "$.features['observation.images.wrist'].info"


@query(
    "patch_info",
    f"""SELECT p_partkey AS dataset,
      CAST(p_partkey % 2 = 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AS INTEGER) + CAST(p_partkey % 5 <> 0 AS INTEGER)
      + CAST(p_partkey % 7 <> 0 AS INTEGER) + CAST(p_partkey % 11 = 0 AS INTEGER) + CAST(p_partkey % 4 = 0 AS INTEGER)
      + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END + CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 3 END AS changes,
      'v2.1' AS version, '{CHUNK_FIRST_PATH}' AS video_path,
      CAST(CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE 2 * p_size END AS VARCHAR) AS total_videos,
      CASE WHEN p_partkey % 7 = 0 THEN '3' ELSE '1' END AS total_chunks, CAST(NULL AS VARCHAR) AS dropped,
      CASE WHEN p_partkey % 4 = 0 THEN 'avc1' ELSE 'av1' END AS codec, '30.5' AS video_fps,
      CASE WHEN p_partkey % 3 = 0 THEN '120' ELSE '480' END AS front_height, '640' AS front_width,
      CASE WHEN p_partkey % 13 <> 0 THEN '3' END AS wrist_channels, 'arm' AS robot_type, '[6]' AS action_shape FROM part""",
)
def patch_info(fx):
    patched = D.patch_info(_documents(fx)).withColumn("_info", F.parse_json("info"))
    return patched.select(
        "dataset",
        F.size("changes").alias("changes"),
        _get("$.codebase_version").alias("version"),
        _get("$.video_path").alias("video_path"),
        _get("$.total_videos").alias("total_videos"),
        _get("$.total_chunks").alias("total_chunks"),
        _get("$.data_files_size_in_mb").alias("dropped"),
        _get(f"{_FRONT}['video.codec']").alias("codec"),
        _get(f"{_FRONT}['video.fps']").alias("video_fps"),
        _get(f"{_FRONT}['video.height']").alias("front_height"),
        _get(f"{_FRONT}['video.width']").alias("front_width"),
        _get(f"{_WRIST}['video.channels']").alias("wrist_channels"),
        _get("$.robot_type").alias("robot_type"),
        _get("$.features.action.shape").alias("action_shape"),
    )


@query(
    "patch_info_log",
    """WITH c AS (
      SELECT p_partkey AS dataset, 'codebase_version' AS field, 'v3.0' AS old, 'v2.1' AS "new" FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, 'video_path', 'v3.0 format', 'v2.1 format' FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'total_videos', 'missing', CAST(2 * p_size AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0
      UNION ALL SELECT p_partkey, 'total_chunks', 'missing', '1' FROM part WHERE p_partkey % 7 <> 0
      UNION ALL SELECT p_partkey, 'data_files_size_in_mb', 'present', 'removed' FROM part WHERE p_partkey % 11 = 0
      UNION ALL SELECT p_partkey, 'observation.images.front.video.codec', 'h264', 'avc1' FROM part WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey, 'observation.images.front.video.height', 'missing', '480' FROM part WHERE p_partkey % 3 <> 0
      UNION ALL SELECT p_partkey, 'observation.images.front.video.' || n.column0, 'missing', n.column1 FROM part, (VALUES ('width', '640'), ('channels', '3')) n(column0, column1)
      UNION ALL SELECT p_partkey, 'observation.images.wrist.video.' || n.column0, 'missing', n.column1
        FROM part, (VALUES ('height', '480'), ('width', '640'), ('channels', '3')) n(column0, column1) WHERE p_partkey % 13 <> 0)
    SELECT * FROM c""",
)
def patch_info_log(fx):
    # For `inline`, Spark would filter empty logs first, by making all of them once more below the shuffle.
    return D.patch_info(_documents(fx)).select("dataset", F.inline_outer("changes")).filter("field is not null")


@query(
    "set_codec_and_paths",
    f"""SELECT p_partkey AS dataset, 'h264' AS front, CAST(NULL AS VARCHAR) AS wrist,
    'data/chunk-{{episode_chunk:03d}}/episode_{{episode_index:06d}}.parquet' AS data_path, '{CAMERA_FIRST_PATH}' AS video_path FROM part""",
)
def set_codec_and_paths(fx):
    done = D.set_episode_paths(D.set_codec(_documents(fx))).withColumn("_info", F.parse_json("info"))
    return done.select(
        "dataset",
        _get(f"{_FRONT}['video.codec']").alias("front"),
        _get(f"{_WRIST}['video.codec']").alias("wrist"),
        _get("$.data_path").alias("data_path"),
        _get("$.video_path").alias("video_path"),
    )


_FEATURES = (
    '{"action": {"dtype": "float32", "shape": [6]}, "observation.images.front": {"dtype": "video", "shape": [480, 640, 3]}, '
    '"observation.images.wrist": {"dtype": "video", "shape": [480, 640, 3]}}'
)


@query(
    "info_document",
    f"""WITH {Q.TWO_DATASETS} SELECT dataset, 'v2.1' AS version, '30' AS fps, CAST(count(DISTINCT episode_index) AS VARCHAR) AS episodes,
    CAST(count(*) AS VARCHAR) AS frames, CAST(2 * count(DISTINCT episode_index) AS VARCHAR) AS videos, 2 AS video_features,
    CAST(count(DISTINCT episode_index // 1000) AS VARCHAR) AS chunks, '{CHUNK_FIRST_PATH}' AS video_path FROM ab GROUP BY dataset""",
)
def info_document(fx):
    """Documents written from the totals of two datasets with two cameras."""
    totals = A.dataset_info(fx.two_datasets(), video_features=2)
    features = totals.select("dataset", F.lit(_FEATURES).alias("features"))
    docs = D.info_document(totals, features).withColumn("_info", F.parse_json("info"))
    return docs.select(
        "dataset",
        _get("$.codebase_version").alias("version"),
        _get("$.fps").alias("fps"),
        _get("$.total_episodes").alias("episodes"),
        _get("$.total_frames").alias("frames"),
        _get("$.total_videos").alias("videos"),
        D.video_feature_count(F.get_json_object("info", "$.features")).alias("video_features"),
        _get("$.total_chunks").alias("chunks"),
        _get("$.video_path").alias("video_path"),
    )


VIDEO_PATHS = """
vp AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '.cache' WHEN p_size % 2 = 0 THEN 'observation.images.scene' ELSE 'observation.images.wrist' END AS camera,
  CASE WHEN p_partkey % 19 = 0 THEN 'old' ELSE printf('chunk-%03d', p_partkey // 100) END AS chunk,
  CASE WHEN p_partkey % 23 = 0 THEN printf('file-%03d.mp4', p_partkey) ELSE printf('episode_%06d.mp4', p_partkey) END AS file FROM part)"""


def _video_paths(fx):
    key = F.col("p_partkey")
    camera = (
        F.when(key % 17 == 0, ".cache")
        .when(F.col("p_size") % 2 == 0, "observation.images.scene")
        .otherwise("observation.images.wrist")
    )
    chunk = F.when(key % 19 == 0, "old").otherwise(F.format_string("chunk-%03d", F.floor(key / 100)))
    file = F.when(key % 23 == 0, F.format_string("file-%03d.mp4", key)).otherwise(F.format_string("episode_%06d.mp4", key))
    return fx.table("part").select(key, F.concat_ws("/", F.lit("data/set/videos"), camera, chunk, file).alias("path"))


@query(
    "parse_video_paths",
    f"""WITH {VIDEO_PATHS} SELECT p_partkey, camera, chunk, file, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey END AS episode_index
    FROM vp WHERE camera <> '.cache' AND chunk <> 'old'""",
)
def parse_video_paths(fx):
    return D.parse_video_paths(_video_paths(fx)).drop("path", "camera_first")


@query(
    "video_moves",
    f"""WITH {VIDEO_PATHS} SELECT 'data/set/videos/' || camera || '/' || chunk || '/' || file AS source,
    'data/set/videos/' || chunk || '/' || camera || '/' || file AS target, chunk, camera, p_partkey AS episode_index
    FROM vp WHERE camera <> '.cache' AND chunk <> 'old' AND p_partkey % 23 <> 0""",
)
def video_moves(fx):
    return D.video_moves(_video_paths(fx))


@query(
    "video_counts",
    f"""WITH {VIDEO_PATHS} SELECT chunk, camera, count(*) AS videos FROM vp
    WHERE camera <> '.cache' AND chunk <> 'old' AND p_partkey % 23 <> 0 GROUP BY ALL""",
)
def video_counts(fx):
    return D.video_counts(D.video_moves(_video_paths(fx)))


def _modality(fx):
    """Arm slices end at 4, 5 or 6 and gripper slices at 6 or 7, so some overlap, leave gaps or run over."""
    key = F.col("p_partkey")
    arm = (F.lit(4) + key % 3).cast("string")
    grip = (F.lit(6) + key % 2).cast("string")
    text = F.concat(
        F.lit('{"state": {"single_arm": {"start": 0, "end": '), arm,
        F.lit('}, "gripper": {"start": 5, "end": '), grip,
        F.lit('}}, "video": {"wrist": {"original_key": "observation.images.wrist"}}}'),
    )
    return fx.table("part").select(key.alias("dataset"), text.alias("modality"))


@query(
    "modality_issues",
    """WITH m AS (SELECT p_partkey AS dataset, 4 + p_partkey % 3 AS a, 6 + p_partkey % 2 AS g FROM part)
    SELECT dataset, 'state' AS kind, 'gripper' AS name, 5::BIGINT AS start, g AS "end", 'overlap' AS issue FROM m WHERE a > 5
    UNION ALL SELECT dataset, 'state', 'gripper', 5, g, 'joints missing before' FROM m WHERE a < 5
    UNION ALL SELECT dataset, 'state', 'gripper', 5, g, 'past the end' FROM m WHERE g > 6""",
)
def modality_issues(fx):
    rows = D.modality_rows(_modality(fx))
    dims = rows.select("dataset", F.lit("state").alias("kind"), F.lit(6).alias("dim")).distinct()
    return D.modality_issues(rows, dims)


@query(
    "modality_document",
    """SELECT p_partkey AS dataset, CAST(4 + p_partkey % 3 AS VARCHAR) AS arm_end, CAST(6 + p_partkey % 2 AS VARCHAR) AS gripper_end,
    'observation.images.wrist' AS wrist FROM part""",
)
def modality_document(fx):
    """Rows of the documents, written as documents again."""
    docs = D.modality_document(D.modality_rows(_modality(fx)))
    get = lambda p: F.get_json_object("modality", p)
    return docs.select(
        "dataset",
        get("$.state.single_arm.end").alias("arm_end"),
        get("$.state.gripper.end").alias("gripper_end"),
        get("$.video.wrist.original_key").alias("wrist"),
    )


@query(
    "joint_coverage",
    """WITH n AS (SELECT DISTINCT p_partkey // 8 AS dataset, p_size % 7 AS j FROM part),
    names AS (SELECT dataset, ['shoulder_pan', 'shoulder_lift', 'elbow_flex', 'wrist_flex', 'wrist_roll', 'gripper', 'jaw'][j + 1] AS joint FROM n),
    w AS (SELECT DISTINCT dataset, unnest(['shoulder_pan', 'shoulder_lift', 'elbow_flex', 'wrist_flex', 'wrist_roll', 'gripper']) AS joint FROM names)
    SELECT dataset, joint FROM w ANTI JOIN names USING (dataset, joint)""",
)
def joint_coverage(fx):
    names = F.array(*[F.lit(n) for n in ("shoulder_pan", "shoulder_lift", "elbow_flex", "wrist_flex", "wrist_roll", "gripper", "jaw")])
    named = fx.table("part").select(F.floor(F.col("p_partkey") / 8).alias("dataset"), F.get(names, F.col("p_size") % 7).alias("joint"))
    return D.joint_coverage(named)


@query(
    "default_modality",
    """WITH d AS (SELECT DISTINCT p_brand AS dataset FROM part), m AS (SELECT * FROM (VALUES
      ('state', 'single_arm', 0, 5, NULL), ('state', 'gripper', 5, 6, NULL), ('action', 'single_arm', 0, 5, NULL), ('action', 'gripper', 5, 6, NULL),
      ('video', 'scene', NULL, NULL, 'observation.images.scene'), ('video', 'wrist', NULL, NULL, 'observation.images.wrist'),
      ('annotation', 'human.task_description', NULL, NULL, 'task_index')) v(kind, name, s, e, original_key))
    SELECT dataset, kind, name, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", original_key FROM d, m""",
)
def default_modality(fx):
    return D.default_modality(fx.table("part").select(F.col("p_brand").alias("dataset")).distinct())


# ---- written and read back ----


def _stored(fx):
    return fx.frames_with_state().withColumn("index", F.col("event_id"))


_AS_FLOAT = f"""WITH {Q.WITH_STATE} SELECT 'again' AS dataset, episode_index, frame_index, event_id AS index, task_index,
{sql_r6("frame_index / 30.0::DOUBLE", "timestamp")}, {", ".join(f"CAST(CAST(a{i} AS FLOAT) AS DOUBLE) AS a{i}" for i in range(6))},
{", ".join(f"CAST(CAST(s{i} AS FLOAT) AS DOUBLE) AS s{i}" for i in range(6))} FROM fs"""


def _flat(df):
    return df.select(
        *FRAME, "index", "task_index", r6("timestamp").alias("timestamp"), *spread("action", "a", 6, False), *spread("state", "s", 6, False)
    )


@query("write_and_scan_chunked", _AS_FLOAT)
def write_and_scan_chunked(fx):
    root = new_dir(fx.spark, "chunked")
    sink.write_chunked(_stored(fx), root, chunks_size=20)
    return _flat(scan.scan_frames(fx.spark, root, "again"))


@query(
    "per_episode_manifest",
    f"""WITH {Q.FRAMES} SELECT DISTINCT episode_index, printf('episode_%06d', episode_index) AS episode_name FROM fx""",
)
def per_episode_manifest(fx):
    """Episodes that have files of their own after writing one unit per episode."""
    root = new_dir(fx.spark, "episodes")
    sink.write_per_episode(_stored(fx), root)
    return sink.manifest(fx.spark, root).select("episode_index", "episode_name").distinct()


@query(
    "episodes_jsonl",
    f"""WITH {Q.FRAMES} SELECT episode_index, count(*) AS length, CAST(min(task_index) AS VARCHAR) AS task, 1 AS n_tasks FROM fx GROUP BY episode_index""",
)
def episodes_jsonl(fx):
    path = new_dir(fx.spark, "episodes-jsonl")
    sink.write_episodes_jsonl(A.episode_summary(fx.frames()), path)
    again = fx.spark.read.schema("episode_index long, length long, tasks array<string>").json(path)
    return again.select("episode_index", "length", F.get("tasks", F.lit(0)).alias("task"), F.size("tasks").alias("n_tasks"))


@query(
    "tasks_jsonl",
    """SELECT DISTINCT 'cust' AS dataset, o_custkey AS task_index, 'order for ' || o_custkey AS task FROM orders""",
)
def tasks_jsonl(fx):
    path = new_dir(fx.spark, "tasks") + ".jsonl"
    tasks = fx.table("orders").select(
        F.col("o_custkey").alias("task_index"), F.concat(F.lit("order for "), F.col("o_custkey").cast("string")).alias("task")
    )
    sink.write_tasks_jsonl(tasks.distinct(), path)
    return scan.scan_tasks(fx.spark, path, "cust")


@query(
    "documents_roundtrip",
    "SELECT p_brand AS dataset, CAST(count(*) AS VARCHAR) AS total_episodes FROM part GROUP BY p_brand",
)
def documents_roundtrip(fx):
    """One document per brand, written to a new path and read again."""
    docs = fx.table("part").groupBy(F.col("p_brand").alias("dataset")).agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("total_episodes"))).alias("info")
    )
    path = new_dir(fx.spark, "documents")
    sink.write_documents(docs, path)
    again = fx.spark.read.schema("value string, dataset string").text(path)
    return again.select("dataset", F.get_json_object("value", "$.total_episodes").alias("total_episodes"))


@query(
    "resume_recording",
    f"""WITH {Q.TWO_DATASETS}, n AS (SELECT max(episode_index) + 1 AS added, max(event_id) + 1 AS shift FROM ab WHERE dataset = 'A')
    SELECT CASE WHEN dataset = 'B' THEN episode_index + added ELSE episode_index END AS episode_index, frame_index,
      CASE WHEN dataset = 'B' THEN event_id + shift ELSE event_id END AS index FROM ab, n""",
)
def resume_recording(fx):
    """A second recording appended to a first; episode and frame numbers go on."""
    root = new_dir(fx.spark, "resumed")
    both = fx.two_datasets().withColumn("state", F.col("action")).withColumn("index", F.col("event_id"))
    sink.append_episodes(fx.spark, both.filter("dataset = 'A'"), root)
    sink.append_episodes(fx.spark, both.filter("dataset = 'B'"), root, resume=True)
    return scan.scan_frames(fx.spark, root, "resumed").select("episode_index", POS, "index")
