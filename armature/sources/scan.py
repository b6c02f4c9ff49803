"""Readers for episode datasets. Every chunk and file is read; schemas are given, not inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armature.operators.metadata import parse_video_paths
from armature.schema import FRAMES


def in_chunks(episodes: Sequence[int], chunks_size: int) -> Column:
    """Whether a file lies in the chunk folder of one of some episodes; Spark drops other files before it reads any."""
    names = sorted({f"chunk-{e // chunks_size:03d}" for e in episodes})
    return F.col("_metadata.file_path").rlike(f"[/=]({'|'.join(names)})/" if names else "(?!)")


def scan_frames(spark: SparkSession, root: str, dataset: str, episodes: Sequence[int] | None = None, chunks_size: int | None = None) -> DataFrame:
    """Frames of a dataset in canonical form: vectors as doubles, `state` without dots.

    Of some `episodes` only row groups that may hold them are read, and with `chunks_size`, where
    chunk folders are numbered by episode, only files of their folders.
    """
    raw = spark.read.schema(FRAMES).option("recursiveFileLookup", "true").parquet(f"{root}/data")
    if episodes is not None:
        if chunks_size is not None:
            raw = raw.filter(in_chunks(episodes, chunks_size))
        raw = raw.filter(F.col("episode_index").isin(list(episodes)))
    return raw.select(
        F.lit(dataset).alias("dataset"),
        "episode_index",
        "frame_index",
        "index",
        "timestamp",
        "task_index",
        F.col("action").cast("array<double>").alias("action"),
        F.col("`observation.state`").cast("array<double>").alias("state"),
    )


def scan_episodes(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Episode table; columns videos/<camera>/from_timestamp and to_timestamp become a map.

    Cameras differ between datasets and between files of one, so this schema is merged from the file footers;
    a camera that an episode lacks is not in its map.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{root}/meta/episodes")
    cameras = sorted(
        c.split("/")[1] for c in raw.columns if c.startswith("videos/") and c.endswith("/from_timestamp")
    )
    kept = [c for c in cameras if f"videos/{c}/to_timestamp" in raw.columns]
    tasks = F.col("tasks") if dict(raw.dtypes)["tasks"].startswith("array") else F.array(F.col("tasks").cast("string"))
    entries = [
        F.struct(
            F.lit(c).alias("key"),
            F.struct(
                F.col(f"`videos/{c}/from_timestamp`").cast("double").alias("from_ts"),
                F.col(f"`videos/{c}/to_timestamp`").cast("double").alias("to_ts"),
            ).alias("value"),
        )
        for c in kept
    ]
    segments = (
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["from_ts"].isNotNull() | e["value"]["to_ts"].isNotNull()))
        if entries
        else F.create_map().cast("map<string,struct<from_ts:double,to_ts:double>>")
    )
    return raw.select(
        F.lit(dataset).alias("dataset"),
        F.col("episode_index").cast("long"),
        F.col("length").cast("long"),
        tasks.alias("tasks"),
        segments.alias("video_segments"),
    )


def scan_tasks(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Task table from Parquet, JSON lines, or one {"0": "text"} document."""
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
        text = "task" if "task" in raw.columns else "__index_level_0__"
        rows = raw.select(F.col("task_index").cast("long"), F.col(text).cast("string").alias("task"))
    elif path.endswith(".jsonl"):
        rows = spark.read.schema("task_index long, task string").json(path).select("task_index", "task")
    else:
        pairs = F.explode(F.from_json("value", "map<string,string>"))
        rows = spark.read.text(path, wholetext=True).select(pairs.alias("_index", "task"))
        rows = rows.select(F.col("_index").cast("long").alias("task_index"), "task")
    return rows.select(F.lit(dataset).alias("dataset"), "task_index", "task")


def scan_documents(spark: SparkSession, path: str, doc: str = "info") -> DataFrame:
    """JSON documents as text, one row per file, with the dataset folder they lie in."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(doc))
    return raw.withColumn("dataset", F.regexp_extract("path", r"([^/]+)/meta/[^/]+$", 1))


def scan_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows (dataset, feature, dim, min, max, mean, std) of stats documents."""
    schema = "map<string,struct<min:array<double>,max:array<double>,mean:array<double>,std:array<double>>>"
    docs = scan_documents(spark, path, "stats")
    one = docs.select("dataset", F.explode(F.from_json("stats", schema)).alias("feature", "_s"))
    zipped = F.arrays_zip(*[F.col(f"_s.{c}").alias(c) for c in ("min", "max", "mean", "std")])
    return one.select("dataset", "feature", F.posexplode(zipped).alias("dim", "_v")).select(
        "dataset", "feature", "dim", "_v.min", "_v.max", "_v.mean", "_v.std"
    )


def scan_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Rows (robot, joint, id, drive_mode, homing_offset, range_min, range_max); robot is the file name."""
    schema = "map<string,struct<id:int,drive_mode:int,homing_offset:int,range_min:int,range_max:int>>"
    raw = spark.read.text(path, wholetext=True)
    robot = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return raw.select(robot.alias("robot"), F.explode(F.from_json("value", schema)).alias("joint", "_c")).select(
        "robot", "joint", "_c.*"
    )


def scan_videos(spark: SparkSession, root: str) -> DataFrame:
    """Video files by camera, chunk and episode. File contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.mp4")
        .load(f"{root}/videos")
        .select("path", "length")
    )
    return parse_video_paths(files)


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training history rows (run, step, loss, eval_loss, learning_rate) of trainer-state files."""
    entry = T.StructType(
        [
            T.StructField("step", T.LongType()),
            T.StructField("loss", T.DoubleType()),
            T.StructField("eval_loss", T.DoubleType()),
            T.StructField("learning_rate", T.DoubleType()),
        ]
    )
    schema = T.StructType([T.StructField("log_history", T.ArrayType(entry))])
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(run.alias("run"), F.inline("log_history"))
