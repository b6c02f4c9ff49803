"""Writers. Output goes to new paths; inputs are never changed or deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.plans.blocks import BLOCK, block_of
from armature.schema import CHUNK_EPISODES


def stored_frames(df: DataFrame) -> DataFrame:
    """Canonical frames in storage form: float vectors, the dotted state name."""
    return df.select(
        "index",
        "frame_index",
        "episode_index",
        "timestamp",
        "task_index",
        F.col("action").cast("array<float>").alias("action"),
        F.col("state").cast("array<float>").alias("observation.state"),
    )


def write_per_episode(
    df: DataFrame, root: str, mode: str = "errorifexists", chunks_size: int = CHUNK_EPISODES, size: int = BLOCK
) -> None:
    """One folder per episode below its chunk folder, rows in frame order.

    Rows are shuffled by (episode, block): a normal episode is one file, an episode longer
    than a block is several, so no single task writes it all.
    """
    episode = F.format_string("episode_%06d", "episode_index")
    chunk = F.format_string("chunk-%03d", F.floor(F.col("episode_index") / chunks_size).cast("long"))
    placed = stored_frames(df).withColumns({"chunk": chunk, "episode": episode, "_block": block_of("frame_index", size)})
    (
        placed.repartition("episode_index", "_block")
        .sortWithinPartitions("chunk", "episode", "frame_index")
        .drop("_block")
        .write.mode(mode)
        .partitionBy("chunk", "episode")
        .parquet(f"{root}/data")
    )


def write_chunked(df: DataFrame, root: str, mode: str = "errorifexists", chunks_size: int = CHUNK_EPISODES) -> None:
    """One folder per chunk of episodes, sorted by episode and frame.

    For many episodes: files are few and large, and row-group statistics on episode_index
    let a reader skip the rest of a chunk. Range partitioning cuts a long episode, too.
    """
    chunk = F.format_string("chunk-%03d", F.floor(F.col("episode_index") / chunks_size).cast("long"))
    (
        stored_frames(df)
        .withColumn("chunk", chunk)
        .repartitionByRange("episode_index", "frame_index")
        .sortWithinPartitions("chunk", "episode_index", "frame_index")
        .write.mode(mode)
        .partitionBy("chunk")
        .parquet(f"{root}/data")
    )


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Files written per episode: (episode_index, path, rows' folder name)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(f"{root}/data")
        .select("path", "length")
    )
    name = F.regexp_extract("path", r"episode=(episode_\d+)/", 1)
    return files.select(
        F.regexp_extract(name, r"(\d+)$", 1).cast("long").alias("episode_index"),
        name.alias("episode_name"),
        "path",
        "length",
    )


def write_episodes_jsonl(episodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines of episode_index, length and tasks; a single task becomes a list of one."""
    is_list = dict(episodes.dtypes)["tasks"].startswith("array")
    tasks = F.col("tasks").cast("array<string>") if is_list else F.array(F.col("tasks").cast("string"))
    episodes.select(
        F.col("episode_index").cast("long"), F.col("length").cast("long"), tasks.alias("tasks")
    ).write.mode(mode).json(path)


def write_tasks_jsonl(tasks: DataFrame | None, path: str, mode: str = "errorifexists") -> bool:
    """JSON lines of task and task_index; without a task table nothing is written."""
    if tasks is None:
        return False
    tasks.select(F.col("task").cast("string"), F.col("task_index").cast("long")).write.mode(mode).json(path)
    return True


def write_documents(docs: DataFrame, path: str, doc: str = "info", mode: str = "errorifexists") -> None:
    """Documents as text, one folder per dataset, at a new path."""
    docs.select("dataset", F.col(doc).alias("value")).write.mode(mode).partitionBy("dataset").text(path)


def append_episodes(spark: SparkSession, new: DataFrame, root: str, resume: bool = False) -> None:
    """Fresh output must not exist; resumed output must, and its numbering goes on.

    The numbers to start from are two maxima of the stored columns.
    """
    path = f"{root}/data"
    if not resume:
        write_per_episode(new, root)
        return
    stored = spark.read.parquet(path)
    episode, index = stored.agg(F.max("episode_index"), F.max("index")).first()
    shift_episode = 0 if episode is None else episode + 1
    shift_index = 0 if index is None else index + 1
    moved = new.withColumns(
        {"episode_index": F.col("episode_index") + shift_episode, "index": F.col("index") + shift_index}
    )
    write_per_episode(moved, root, mode="append")
