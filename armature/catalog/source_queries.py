"""Datasets written in the given layout from the tables, and read by the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import query, r3, r6, sql_r3, sql_r6
from armature.catalog.metadata_queries import _AS_FLOAT, _flat, _stored
from armature.operators import frames as P
from armature.operators import quality as A
from armature.session import new_dir
from armature.sources import scan, sink
from armature.sources.files import write_files

EPISODE = 7


@query("scan_one_episode", f"{_AS_FLOAT} WHERE episode_index = {EPISODE} AND frame_index >= 10")
def scan_one_episode(fx):
    """One episode from a start frame: only its chunk folder is read."""
    root = new_dir(fx.spark, "chunked")
    sink.write_chunked(_stored(fx), root, chunks_size=5)
    frames = scan.scan_frames(fx.spark, root, "again", [EPISODE], chunks_size=5)
    return _flat(P.episode_slice(frames, EPISODE, 10))


@query(
    "scan_episode_tables",
    f"""WITH {Q.FRAMES}, e AS (SELECT episode_index, count(*) AS length, CAST(min(task_index) AS VARCHAR) AS task FROM fx GROUP BY episode_index)
    SELECT 'again' AS dataset, episode_index, length, task, episode_index * 10.0::DOUBLE AS scene_from, {sql_r6("episode_index * 10.0::DOUBLE + length / 30.0::DOUBLE", "scene_to")},
      CASE WHEN episode_index % 2 = 0 THEN episode_index * 20.0::DOUBLE END AS wrist_from,
      CASE WHEN episode_index % 2 = 0 THEN {sql_r6("episode_index * 20.0::DOUBLE + length / 30.0::DOUBLE")} END AS wrist_to FROM e""",
)
def scan_episode_tables(fx):
    """Episode tables of two files, one of them without a camera."""
    root = new_dir(fx.spark, "episode-tables")
    rows = A.episode_summary(fx.frames()).select("episode_index", "length", F.col("tasks").cast("array<string>").alias("tasks"))
    seconds = F.col("length") / F.lit(30.0)

    def camera(name: str, scale: float) -> dict:
        begin = F.col("episode_index") * F.lit(scale)
        return {f"videos/{name}/from_timestamp": begin, f"videos/{name}/to_timestamp": begin + seconds}

    both = rows.filter("episode_index % 2 = 0").withColumns({**camera("scene", 10.0), **camera("wrist", 20.0)})
    both.write.parquet(f"{root}/meta/episodes/chunk-000")
    rows.filter("episode_index % 2 = 1").withColumns(camera("scene", 10.0)).write.parquet(f"{root}/meta/episodes/chunk-001")
    again = scan.scan_episodes(fx.spark, root, "again")
    times = [r6(F.col("video_segments")[c][f"{at}_ts"]).alias(f"{c}_{at}") for c in ("scene", "wrist") for at in ("from", "to")]
    return again.select("dataset", "episode_index", "length", F.get("tasks", F.lit(0)).alias("task"), *times)


_FACTS = "SELECT o_orderstatus AS dataset, CAST({0} AS DOUBLE) AS v FROM orders"


@query(
    "scan_stats_documents",
    " UNION ALL ".join(
        f"""SELECT dataset, 'order' AS feature, CAST({dim} AS INTEGER) AS dim, min(v) AS min, max(v) AS max, {sql_r3("avg(v)", "mean")}, {sql_r3("stddev_samp(v)", "std")}
        FROM ({_FACTS.format(column)}) GROUP BY dataset"""
        for dim, column in enumerate(("o_custkey", "o_orderkey"))
    ),
)
def scan_stats_documents(fx):
    """A stats document for each dataset folder."""
    root = new_dir(fx.spark, "stats")
    values = [F.col(c).cast("double") for c in ("o_custkey", "o_orderkey")]
    lists = [F.array(*[f(v) for v in values]).alias(name) for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
    docs = fx.table("orders").groupBy(F.col("o_orderstatus").alias("dataset")).agg(*lists)
    text = F.to_json(F.create_map(F.lit("order"), F.struct("min", "max", "mean", "std")))
    write_files(docs.select(F.concat("dataset", F.lit("/meta/stats.json")).alias("path"), text.alias("content")), root)
    again = scan.scan_stats(fx.spark, f"{root}/*/meta/stats.json")
    return again.select("dataset", "feature", "dim", "min", "max", r3("mean").alias("mean"), r3("std").alias("std"))


_CALIBRATION = """SELECT user_id % 8 AS r, event_id % 6 AS j, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL"""


@query(
    "scan_calibration_documents",
    f"""SELECT 'arm_' || r AS robot, 'joint_' || (j + 1) AS joint, CAST(j + 1 AS INTEGER) AS id, CAST(r % 2 AS INTEGER) AS drive_mode, CAST(-n AS INTEGER) AS homing_offset,
    CAST(lo AS INTEGER) AS range_min, CAST(hi AS INTEGER) AS range_max FROM ({_CALIBRATION})""",
)
def scan_calibration_documents(fx):
    """A calibration document for each robot, named by it."""
    root = new_dir(fx.spark, "calibration")
    rows = fx.table("events").groupBy((F.col("user_id") % 8).alias("r"), (F.col("event_id") % 6).alias("j"))
    rows = rows.agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    fields = {"id": F.col("j") + 1, "drive_mode": F.col("r") % 2, "homing_offset": -F.col("n"), "range_min": F.col("lo"), "range_max": F.col("hi")}
    motor = F.struct(F.concat(F.lit("joint_"), F.col("j") + 1).alias("key"), F.struct(*[v.cast("int").alias(k) for k, v in fields.items()]).alias("value"))
    docs = rows.groupBy("r").agg(F.to_json(F.map_from_entries(F.collect_list(motor))).alias("content"))
    write_files(docs.select(F.concat(F.lit("robots/arm_"), "r", F.lit(".json")).alias("path"), "content"), root)
    return scan.scan_calibration(fx.spark, f"{root}/robots")


@query(
    "scan_video_files",
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'scene' ELSE 'wrist' END AS camera, printf('chunk-%03d', p_partkey // 1000) AS chunk, printf('episode_%06d.mp4', p_size) AS file,
    CAST(p_size AS BIGINT) AS episode_index, count(*) AS length FROM part GROUP BY ALL""",
)
def scan_video_files(fx):
    """Files of both cameras in chunk folders, and one in a hidden folder that does not count."""
    root = new_dir(fx.spark, "videos")
    camera = F.when(F.col("p_size") % 2 == 0, "scene").otherwise("wrist")
    chunk = F.format_string("chunk-%03d", F.floor(F.col("p_partkey") / 1000).cast("long"))
    path = F.concat_ws("/", F.lit("videos"), camera, chunk, F.format_string("episode_%06d.mp4", F.col("p_size").cast("long")))
    files = fx.table("part").groupBy(path.alias("path")).agg(F.expr("repeat('v', int(count(*)))").alias("content"))
    hidden = files.agg(F.lit("videos/.cache/chunk-000/episode_000000.mp4").alias("path"), F.lit("v").alias("content"))
    write_files(files.unionByName(hidden), root)
    return scan.scan_videos(fx.spark, root).select("camera", "chunk", "file", "episode_index", "length")


@query(
    "scan_training_history",
    """SELECT 'run_' || o_orderstatus AS run, CAST(o_custkey % 50 * 10 AS BIGINT) AS step, count(*) / 1000.0::DOUBLE AS loss,
    CASE WHEN o_custkey % 50 % 5 = 0 THEN max(o_custkey) / 1000.0::DOUBLE END AS eval_loss, 0.0001::DOUBLE AS learning_rate FROM orders GROUP BY o_orderstatus, o_custkey % 50""",
)
def scan_training_history(fx):
    """A trainer's state for each run; steps without evaluation have no evaluation loss."""
    root = new_dir(fx.spark, "history")
    at = F.col("o_custkey") % 50
    rows = fx.table("orders").groupBy(F.concat(F.lit("run_"), "o_orderstatus").alias("run"), at.alias("at")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("top"))
    evaluated = F.when(F.col("at") % 5 == 0, F.col("top") / F.lit(1000.0))
    entry = F.struct((F.col("at") * 10).alias("step"), (F.col("n") / F.lit(1000.0)).alias("loss"), evaluated.alias("eval_loss"), F.lit(0.0001).alias("learning_rate"))
    docs = rows.groupBy("run").agg(F.to_json(F.struct(F.collect_list(entry).alias("log_history"))).alias("content"))
    write_files(docs.select(F.concat("run", F.lit("/trainer_state.json")).alias("path"), "content"), root)
    return scan.scan_metrics(fx.spark, f"{root}/*/trainer_state.json")
