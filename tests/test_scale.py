"""Results that must not follow the size of the input, and code that must reach other processes."""

import os
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.operators import episodes, quality, sampling
from armature.plans.lookups import TIDY, settled
from armature.session import shared_dir
from armature.sources import scan

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_mixture_is_the_same_beyond_the_bounded_top(spark):
    df = spark.range(4000).select(F.lit("a").alias("dataset"), (F.col("id") % 7).alias("episode_index"), F.col("id").alias("frame_index"), F.exp(-F.col("id") % 40).alias("weight"))
    draws = [sorted(r.frame_index for r in sampling.draw_mixture(df, 700, 3, top_rows=top).collect()) for top in (100_000, 10)]
    assert draws[0] == draws[1] and len(draws[0]) == 700


def test_quantiles_are_exact_on_skewed_values(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in np.floor(rng.lognormal(0, 3, 20_000))] + [("b", float(v)) for v in rng.normal(size=999)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "stage string, latency_ms double")
    got = {(r.stage, r._share): r.value for r in quality.quantile_values(df, ["stage"], "latency_ms", [0.5, 0.95]).collect()}
    for stage in "abc":
        own = sorted(v for s, v in rows if s == stage)
        for share in (0.5, 0.95):
            assert got[stage, share] == own[int(np.ceil(len(own) * share - 1e-9)) - 1]
    assert len(got) == 6


def test_chunks_keep_the_place_of_missing_actions(spark):
    rows = [("d", 0, i, None if i in (1, 4) else [float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, frame_index long, action array<double>")
    got = {r.frame_index: (r.chunk, r.chunk_is_pad) for r in episodes.action_chunks(df, horizon=3).collect()}
    assert got[0] == ([[0.0], None, [2.0]], [False, False, False])
    assert got[3] == ([[3.0], None, None], [False, False, True])
    assert got[4] == ([None, None, None], [False, True, True])


def test_cameras_of_all_files(spark, tmp_path):
    def episode(i, cameras):
        names = "".join(f", `videos/{c}/from_timestamp` double, `videos/{c}/to_timestamp` double" for c in cameras)
        spark.createDataFrame([(i, 10, ["t"], *[float(x) for c in cameras for x in (0, i + 1)])], f"episode_index long, length long, tasks array<string>{names}").write.mode("append").parquet(f"{tmp_path}/meta/episodes")

    episode(0, ["front"])
    episode(1, ["front", "wrist"])
    got = {r.episode_index: sorted(r.video_segments) for r in scan.scan_episodes(spark, str(tmp_path), "d").collect()}
    assert got == {0: ["front"], 1: ["front", "wrist"]}


def test_local_folders_are_refused_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        def __init__(self, named, **more):
            self.conf = Conf({"spark.checkpoint.dir": named, **more})
            self.sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    for named in ("/tmp/x", "file:///tmp/x", "file:/tmp/x"):
        with pytest.raises(ValueError):
            shared_dir(Session(named))
        assert shared_dir(Session(named, **{"spark.armature.sharedFolderIsMounted": "true"})) == named
    assert shared_dir(Session("hdfs://host/x")) == "hdfs://host/x"


def _on_a_cluster(spark, conf, writes=lambda path: path):
    """A session that takes itself for one on a cluster; `writes` says where its executors' files end up."""

    class Writer:
        def __init__(self, df):
            self.write, self.df = self, df

        def parquet(self, path):
            self.df.write.parquet(writes(path))

    context = type("Context", (), {"master": "spark://host:7077", "applicationId": str(conf), "defaultParallelism": 2, "getConf": lambda _: {}, "getCheckpointDir": lambda _: None})()
    return type("Session", (), {"conf": conf, "sparkContext": context, "read": spark.read, "range": lambda _, *a: Writer(spark.range(*a))})()


def test_a_path_that_all_executors_see_is_taken_on_a_cluster(spark, tmp_path):
    for named in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        assert shared_dir(_on_a_cluster(spark, {"spark.checkpoint.dir": named})) == named
    assert shared_dir(_on_a_cluster(spark, {"spark.sql.warehouse.dir": f"{tmp_path}/w"})) == f"{tmp_path}/w/armature-work"


def test_a_path_that_executors_write_elsewhere_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        shared_dir(_on_a_cluster(spark, {"spark.checkpoint.dir": f"{tmp_path}/a"}, writes=lambda path: f"{path}-elsewhere"))


def test_workers_get_the_package(tmp_path):
    """Python workers find the package though it is installed nowhere and the session starts elsewhere."""
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_point", {os.path.join(ROOT, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
queries = entry.queries()
print("ROWS", queries["ema"](spark, "/root/testdata/sf0.001").count(), queries["stream_smooth"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    line = [x for x in out.stdout.splitlines() if x.startswith("ROWS")]
    assert line and all(int(n) > 0 for n in line[0].split()[1:]), out.stderr[-2000:]


def test_a_settled_table_leaves_no_shuffle_files(spark):
    """The files that an execution has shuffled go when its result is written, and the setting is as it was."""
    folders = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(TIDY, None)
    groups = spark.range(100_000).groupBy((F.col("id") % 997).alias("k")).count()
    table = settled(groups)
    for _ in range(50):  # executors remove them a little later
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(TIDY, None) == setting
    assert table.agg(F.sum("count"), F.count("*")).first() == (100_000, 997)
    assert groups.agg(F.sum("count")).first()[0] == 100_000
