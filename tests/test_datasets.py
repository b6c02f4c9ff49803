"""Documents, readers, writers and merging."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from armature.catalog import QUERIES
from armature.operators import episodes as W
from armature.operators import merge as M
from armature.operators import metadata as D
from armature.operators import quality as A
from armature.schema import CAMERA_FIRST_PATH, CHUNK_FIRST_PATH
from armature.sources import scan, sink
from armature.sources.files import write_files

V3_INFO = {
    "codebase_version": "v3.0",
    "fps": 30,
    "total_episodes": 50,
    "video_path": CAMERA_FIRST_PATH,
    "data_files_size_in_mb": 100,
    "video_files_size_in_mb": 200.5,
    "splits": {"train": "0:50"},
    "features": {
        "action": {"dtype": "float32", "shape": [6], "names": ["a", "b"]},
        "observation.images.scene": {
            "dtype": "video",
            "shape": [480, 640, 3],
            "info": {"video.codec": "h264", "video.fps": 30, "has_audio": False, "video.height": 240},
        },
        "observation.images.wrist": {"dtype": "video", "shape": [480, 640, 3]},
        "observation.depth": {"dtype": "video", "shape": [480, 640], "info": {"video.codec": "av1"}},
        "note": "free text",
    },
}


def patch(spark, doc, **kw):
    df = spark.createDataFrame([("d", json.dumps(doc))], "dataset string, info string")
    row = D.patch_info(df, **kw).first()
    return json.loads(row.info), {(c.field, c.old, c.new) for c in row.changes}


def test_documents_of_one_partition_are_dealt_to_many_tasks(spark):
    rows = [(i, json.dumps(V3_INFO)) for i in range(200)]
    docs = spark.createDataFrame(rows, "dataset long, info string").coalesce(1)
    for done in (D.patch_info(docs), D.set_episode_paths(D.set_codec(docs))):
        sizes = done.select("dataset", "info").rdd.glom().map(len).collect()
        assert sum(sizes) == 200 and max(sizes) < 50


def test_the_log_of_changes_is_made_once(spark, tmp_path, capsys):
    spark.range(1, 31).selectExpr("id AS p_partkey", "int(id) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    log = QUERIES["patch_info_log"](spark, str(tmp_path))
    log.explain()
    plan = capsys.readouterr().out
    assert plan.count("Filter ") == 1 and plan.index("Filter ") < plan.index("Generate")
    assert log.filter("field = 'total_videos'").count() == 24 and log.filter("field is null").count() == 0


def test_patch_changes_what_it_should_and_keeps_the_rest(spark):
    got, log = patch(spark, V3_INFO)
    assert got["codebase_version"] == "v2.1" and got["video_path"] == CHUNK_FIRST_PATH
    assert got["total_videos"] == 150 and got["total_chunks"] == 1
    assert "data_files_size_in_mb" not in got and "video_files_size_in_mb" not in got
    assert got["splits"] == {"train": "0:50"} and got["fps"] == 30
    scene = got["features"]["observation.images.scene"]["info"]
    assert scene == {"video.codec": "avc1", "video.fps": 30, "has_audio": False, "video.height": 240, "video.width": 640, "video.channels": 3}
    assert got["features"]["observation.depth"] == V3_INFO["features"]["observation.depth"]
    assert got["features"]["action"] == V3_INFO["features"]["action"]
    assert ("codebase_version", "v3.0", "v2.1") in log
    assert ("observation.images.scene.video.codec", "h264", "avc1") in log
    assert ("video_files_size_in_mb", "present", "removed") in log
    assert ("total_videos", "missing", "150") in log
    assert len(log) == 4 + 2 + 3 + 3


def test_a_video_feature_without_info_gets_one(spark):
    """Logged changes are also made here, unlike where a loose object receives them."""
    got, log = patch(spark, V3_INFO)
    assert got["features"]["observation.images.wrist"]["info"] == {"video.height": 480, "video.width": 640, "video.channels": 3}
    assert ("observation.images.wrist.video.width", "missing", "640") in log


def test_patching_twice_changes_nothing_more(spark):
    once, _ = patch(spark, V3_INFO)
    twice, log = patch(spark, once)
    assert twice == once and log == set()


def test_narrow_patch_leaves_sizes_alone(spark):
    got, log = patch(spark, V3_INFO, video_shape=False)
    assert "info" not in got["features"]["observation.images.wrist"]
    assert not any("height" in field for field, _, _ in log)


def test_other_paths_and_missing_features(spark):
    got, log = patch(spark, {"codebase_version": "v2.0", "video_path": "elsewhere"})
    assert got == {"codebase_version": "v2.0", "video_path": "elsewhere", "total_videos": 0, "total_chunks": 1}
    assert {f for f, _, _ in log} == {"total_videos", "total_chunks"}


def test_codec_only_where_info_exists(spark):
    df = spark.createDataFrame([("d", json.dumps(V3_INFO))], "dataset string, info string")
    got = json.loads(D.set_codec(D.set_episode_paths(df)).first().info)
    assert got["features"]["observation.depth"]["info"]["video.codec"] == "h264"
    assert "info" not in got["features"]["observation.images.wrist"]
    assert got["data_path"].endswith("episode_{episode_index:06d}.parquet")
    assert got["video_path"] == CAMERA_FIRST_PATH


def test_default_modality_has_no_issues(spark):
    rows = D.default_modality(spark.createDataFrame([("d",)], "dataset string"))
    dims = spark.createDataFrame([("d", "state", 6), ("d", "action", 6)], "dataset string, kind string, dim int")
    assert D.modality_issues(rows, dims).count() == 0
    wide = dims.withColumn("dim", F.lit(12))
    assert {r.issue for r in D.modality_issues(rows, wide).collect()} == {"joints missing after"}
    doc = json.loads(D.modality_document(rows).first().modality)
    assert doc["state"]["single_arm"]["start"] == 0 and doc["video"]["wrist"]["original_key"] == "observation.images.wrist"
    assert D.modality_rows(D.modality_document(rows)).count() == rows.count()


def frames(spark, episodes=3, length=12):
    rows = [(e, t, e * length + t, t / 30, e % 2, [float(t)] * 6, [float(t)] * 6) for e in range(episodes) for t in range(length)]
    return spark.createDataFrame(
        rows,
        "episode_index long, frame_index long, index long, timestamp double, task_index long, action array<double>, state array<double>",
    ).withColumn("dataset", F.lit("d"))


@pytest.mark.parametrize("write", [sink.write_per_episode, sink.write_chunked])
def test_frames_round_trip(spark, tmp_path, write):
    root = str(tmp_path / "set")
    df = frames(spark)
    write(df, root)
    for folder, _, names in os.walk(f"{root}/data"):
        for name in names:
            if name.endswith(".parquet"):
                order = pq.ParquetFile(os.path.join(folder, name)).read().select(["episode_index", "frame_index"]).to_pylist()
                assert order == sorted(order, key=lambda r: (r["episode_index"], r["frame_index"]))
    again = scan.scan_frames(spark, root, "d")
    cols = ["episode_index", "frame_index", "index", "task_index", "action", "state"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, df.select(*cols).collect()))
    with pytest.raises(AnalysisException):
        write(df, root)


def test_long_episode_is_several_files_in_order(spark, tmp_path):
    root = str(tmp_path / "set")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink.write_per_episode(frames(spark, 1, 100), root, size=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sink.manifest(spark, root).collect()
    assert len(files) > 1 and {r.episode_name for r in files} == {"episode_000000"}
    assert os.path.isdir(f"{root}/data/chunk=chunk-000/episode=episode_000000")


def test_resume_needs_existing_output_and_continues(spark, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(AnalysisException):
        sink.append_episodes(spark, frames(spark), root, resume=True)
    sink.append_episodes(spark, frames(spark), root)
    sink.append_episodes(spark, frames(spark, 2), root, resume=True)
    got = scan.scan_frames(spark, root, "d")
    assert sorted(r[0] for r in got.select("episode_index").distinct().collect()) == [0, 1, 2, 3, 4]
    assert sorted(r[0] for r in got.select("index").collect()) == list(range(60))


def test_reads_a_folder_of_plain_files(spark, tmp_path):
    """Several chunks and files, float32 vectors, the dotted state column."""
    for chunk in range(2):
        folder = tmp_path / "data" / f"chunk-{chunk:03d}"
        folder.mkdir(parents=True)
        for file in range(2):
            n = 5
            table = pa.table(
                {
                    "index": pa.array(range(n), pa.int64()),
                    "frame_index": pa.array(range(n), pa.int64()),
                    "episode_index": pa.array([chunk * 2 + file] * n, pa.int64()),
                    "timestamp": pa.array([t / 30 for t in range(n)], pa.float64()),
                    "task_index": pa.array([0] * n, pa.int64()),
                    "action": pa.array([[0.5] * 6] * n, pa.list_(pa.float32())),
                    "observation.state": pa.array([[0.25] * 6] * n, pa.list_(pa.float32())),
                }
            )
            pq.write_table(table, folder / f"file-{file:03d}.parquet")
    got = scan.scan_frames(spark, str(tmp_path), "d")
    assert got.count() == 20 and got.first().state == [0.25] * 6
    pruned = got.filter("episode_index = 3").select("timestamp")
    plan = pruned._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(episode_index), EqualTo(episode_index,3)]" in plan
    assert "ReadSchema: struct<episode_index:bigint,timestamp:double>" in plan


def test_episode_table_folds_video_columns(spark, tmp_path):
    folder = tmp_path / "meta" / "episodes" / "chunk-000"
    folder.mkdir(parents=True)
    table = pa.table(
        {
            "episode_index": [0, 1],
            "length": [125, 9],
            "tasks": [["Pick up the bread"], ["Pick up the bread"]],
            "videos/observation.images.front/from_timestamp": [0.0, 4.166],
            "videos/observation.images.front/to_timestamp": [4.166, 4.466],
            "videos/observation.images.wrist/from_timestamp": [0.0, 0.0],
        }
    )
    pq.write_table(table, folder / "file-000.parquet")
    rows = scan.scan_episodes(spark, str(tmp_path), "d")
    cuts = W.cut_manifest(rows).orderBy("episode_index").collect()
    assert [(r.camera, r.from_ts, round(r.duration, 3)) for r in cuts] == [
        ("observation.images.front", 0.0, 4.166),
        ("observation.images.front", 4.166, 0.3),
    ]
    assert cuts[1].target == "videos/observation.images.front/chunk-000/episode_000001.mp4"


def test_task_tables_in_three_forms(spark, tmp_path):
    pq.write_table(pa.table({"task_index": [0], "__index_level_0__": ["bread"]}), tmp_path / "tasks.parquet")
    (tmp_path / "tasks.jsonl").write_text('{"task": "bread", "task_index": 0}\n')
    (tmp_path / "tasks.json").write_text('{\n "0": "bread"\n}')
    for name in ("tasks.parquet", "tasks.jsonl", "tasks.json"):
        assert scan.scan_tasks(spark, str(tmp_path / name), "d").collect() == [("d", 0, "bread")]
    assert not sink.write_tasks_jsonl(None, str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")


def test_documents_stats_calibration_and_metrics(spark, tmp_path):
    meta = tmp_path / "cheese" / "meta"
    meta.mkdir(parents=True)
    (meta / "info.json").write_text(json.dumps(V3_INFO, indent=2))
    (meta / "stats.json").write_text(json.dumps({"action": {"min": [0, 1], "max": [2, 3], "mean": [1, 2], "std": [0.5, 0.5]}}))
    info = scan.scan_documents(spark, str(meta / "info.json")).first()
    assert info.dataset == "cheese" and json.loads(info.info) == V3_INFO
    stats = scan.scan_stats(spark, str(meta / "stats.json")).orderBy("dim").collect()
    assert [(r.feature, r.dim, r.min, r.max) for r in stats] == [("action", 0, 0.0, 2.0), ("action", 1, 1.0, 3.0)]
    arm = tmp_path / "follower.json"
    arm.write_text(json.dumps({"shoulder_pan": {"id": 1, "drive_mode": 0, "homing_offset": -156, "range_min": 1024, "range_max": 3072}}))
    assert scan.scan_calibration(spark, str(arm)).collect() == [("follower", "shoulder_pan", 1, 0, -156, 1024, 3072)]
    run = tmp_path / "run1"
    run.mkdir()
    (run / "trainer_state.json").write_text(json.dumps({"log_history": [{"step": 10, "loss": 0.5, "learning_rate": 1e-4}, {"step": 20, "eval_loss": 0.25}]}))
    history = scan.scan_metrics(spark, str(run / "trainer_state.json")).orderBy("step").collect()
    assert [(r.run, r.step, r.loss, r.eval_loss) for r in history] == [("run1", 10, 0.5, None), ("run1", 20, None, 0.25)]


def test_video_inventory_reads_no_content(spark, tmp_path):
    for name in ("wrist/chunk-000/episode_000000.mp4", "wrist/chunk-001/file-000.mp4", ".cache/chunk-000/episode_000001.mp4",
                 "wrist/old/episode_000002.mp4", "chunk-000/scene/episode_000003.mp4", "wrist/chunk-000/notes.txt"):
        path = tmp_path / "videos" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"1234567")
    got = scan.scan_videos(spark, str(tmp_path))
    rows = sorted((r.camera, r.chunk, r.episode_index, r.length) for r in got.collect() if r.episode_index is not None)
    assert rows == [("scene", "chunk-000", 3, 7), ("wrist", "chunk-000", 0, 7)]
    assert got.count() == 3
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    sizes = A.video_sizes(got, ["camera"]).collect()
    assert {(r.camera, r.bytes) for r in sizes} == {("wrist", 14), ("scene", 7)}


def test_episode_list_with_a_single_task(spark, tmp_path):
    path = str(tmp_path / "episodes.jsonl")
    sink.write_episodes_jsonl(spark.createDataFrame([(0, 284, "bread")], "episode_index long, length long, tasks string"), path)
    assert spark.read.json(path).first().tasks == ["bread"]


def test_documents_are_written_to_a_new_path(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"fps": 30}')], "dataset string, info string")
    path = str(tmp_path / "docs")
    sink.write_documents(docs, path)
    with pytest.raises(AnalysisException):
        sink.write_documents(docs, path)
    assert spark.read.text(path).first().value == '{"fps": 30}'


def test_merge_continues_numbers_and_joins_tasks_by_text(spark):
    a, b = frames(spark, 2, 4), frames(spark, 3, 2)
    tasks_a = spark.createDataFrame([(0, "bread"), (1, "cheese")], "task_index long, task string")
    tasks_b = spark.createDataFrame([(0, "cheese"), (1, "patty")], "task_index long, task string")
    dictionary = M.merged_tasks([tasks_a, tasks_b])
    merged = M.merge_frames([a, b], dictionary)
    assert sorted({r.episode_index for r in merged.collect()}) == [0, 1, 2, 3, 4]
    assert sorted(r["index"] for r in merged.select("index").collect()) == list(range(14))
    new = {(r.source, r.task): r.new_index for r in dictionary.collect()}
    assert new == {(0, "bread"): 0, (0, "cheese"): 1, (1, "cheese"): 1, (1, "patty"): 2}
    got = {(r.episode_index, r.task_index) for r in merged.collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 1)}
    empty = M.merge_frames([a.limit(0), b], M.merged_tasks([tasks_a, tasks_b]))
    assert sorted({r.episode_index for r in empty.collect()}) == [0, 1, 2]


def test_missing_files_accept_either_task_file(spark):
    files = spark.createDataFrame([("a", "meta/info.json"), ("a", "meta/tasks.parquet"), ("b", "meta/stats.json")], "dataset string, path string")
    got = {tuple(r) for r in A.missing_files(files, files.select("dataset").distinct()).collect()}
    assert got == {("a", "meta/stats.json"), ("b", "meta/info.json"), ("b", "meta/tasks.json or meta/tasks.parquet")}


def test_merge_plan_grows_with_the_datasets_not_their_square(spark):
    part = spark.range(3).select(F.col("id").alias("episode_index"), F.col("id").alias("frame_index"), F.col("id").alias("index"), F.lit(0).cast("long").alias("task_index"))
    tasks = spark.createDataFrame([(0, "pick")], "task_index long, task string")
    sizes = []
    for n in (10, 40):
        merged = M.merge_frames([part] * n, M.merged_tasks([tasks] * n, rows=n))
        assert sorted(r["index"] for r in merged.select("index").collect()) == list(range(3 * n))
        assert sorted(r.episode_index for r in M.merge_episodes([part] * n, [part] * n).collect()) == list(range(3 * n))
        sizes.append(len(merged._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 5 * sizes[0]


def files_read(df):
    """Files that the scan below a DataFrame has left after pruning."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.selectedPartitions().totalNumberOfFiles()


def test_an_episode_filter_reads_one_chunk(spark, tmp_path):
    rows = [(e * 3 + f, f, e, f / 30, 0, [float(e)] * 6, [0.0] * 6) for e in range(12) for f in range(3)]
    df = spark.createDataFrame(rows, "index long, frame_index long, episode_index long, timestamp double, task_index long, action array<double>, state array<double>")
    root = str(tmp_path / "set")
    sink.write_chunked(df, root, chunks_size=4)
    everything = scan.scan_frames(spark, root, "a")
    few = scan.scan_frames(spark, root, "a", [5, 6], chunks_size=4)
    assert sorted((r.episode_index, r.frame_index) for r in few.collect()) == [(e, f) for e in (5, 6) for f in range(3)]
    in_chunk = {p for p in everything.inputFiles() if "chunk-001" in p}
    assert 0 < files_read(few) <= len(in_chunk) < files_read(everything)
    assert "PushedFilters: [In(episode_index, [5,6])" in few._jdf.queryExecution().toString()
    assert scan.scan_frames(spark, root, "a", [], chunks_size=4).count() == 0
    assert scan.scan_frames(spark, root, "a", [5]).count() == 3


def test_named_files_hold_their_content(spark, tmp_path):
    df = spark.createDataFrame([("a/x y.json", b"{}"), ("b/é.bin", b"\x00\x01"), ("b/é.bin", b"\x00\x01")], "path string, content binary")
    assert write_files(df, str(tmp_path)) == 3
    assert (tmp_path / "a/x y.json").read_bytes() == b"{}" and sorted(p.name for p in (tmp_path / "b").iterdir()) == ["é.bin"]
    assert write_files(df.limit(0), str(tmp_path)) == 0
