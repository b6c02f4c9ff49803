"""Several micro-batches give what one batch over all rows gives."""

import collections
import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armature.plans.blocks import position
from armature.session import new_dir
from armature.streaming import telemetry as S

SCHEMA = T.StructType(
    [
        T.StructField("robot", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("joints", T.ArrayType(T.DoubleType())),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)
START = dt.datetime(2024, 1, 1)


def rows(n=120):
    rng = np.random.default_rng(4)
    keys = [None, None, None, "B", "N", "R", "left"]
    return [
        (
            f"r{i % 3}",
            START + dt.timedelta(milliseconds=33 * i),
            i,
            keys[rng.integers(len(keys))],
            [float(v) for v in rng.normal(0, 20, 2)],
            float(rng.integers(5, 60)),
        )
        for i in range(n)
    ]


LATE = "1 second"


@pytest.fixture(params=["in order", "shuffled"])
def files(request, spark, tmp_path):
    """Six files, read one per micro-batch; rows in time order, or out of it within the watermark."""
    path = str(tmp_path / "in")
    data = rows()
    if request.param == "shuffled":
        rng = np.random.default_rng(5)
        data = [data[i] for i in np.argsort(np.arange(len(data)) + rng.uniform(0, 25, len(data)))]
    for i in range(6):
        part = spark.createDataFrame(data[i * 20 : (i + 1) * 20], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def passed():
    """Rows that the last watermark has passed, in time order."""
    end = max(r[1] for r in rows()) - dt.timedelta(seconds=1)
    end = end.replace(microsecond=end.microsecond // 1000 * 1000)
    return [r for r in rows() if r[1] < end]


def finish(spark, df, label):
    S.use_rocksdb(spark)
    path = new_dir(spark, label)
    S.write_stream(df, path, new_dir(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def test_smoother_keeps_state_between_batches(spark, files):
    live = S.read_telemetry(spark, files, SCHEMA, LATE, files_per_trigger=1)
    got = {r.order_id: r.smoothed for r in finish(spark, S.smooth_stream(live, "event_id", 0.4, 5.0), "smooth").collect()}
    state = {}
    for robot, _, i, _, joints, _ in passed():
        x = np.array(joints)
        if robot in state:
            e, limited = state[robot]
            e = 0.4 * x + 0.6 * e
            limited = limited + np.clip(e - limited, -5, 5)
        else:
            e = limited = x
        state[robot] = (e, limited)
        np.testing.assert_allclose(got[i], limited)
    assert len(got) == len(passed()) > 80


def test_recorder_matches_the_batch_state_machine(spark, files):
    live = S.read_telemetry(spark, files, SCHEMA, LATE, files_per_trigger=1)
    streamed = {tuple(r) for r in S.kept_episodes(finish(spark, S.record_stream(live, "event_id"), "record")).select("robot", "episode", "frames", "first_id", "verdict").collect()}
    table = position(spark.createDataFrame(passed(), SCHEMA), ["robot"], ["ts", "event_id"])
    for size in (8, 1000):
        labelled = S.label_episodes(table, size=size)
        batch = S.recorded_episodes(labelled).join(
            table.select("robot", F.col("position").alias("first_position"), "event_id"), ["robot", "first_position"]
        )
        assert streamed == {(r.robot, r.episode, r.frames, r.event_id, r.verdict) for r in batch.collect()}
    assert streamed


def whole(spark, df, label, tail):
    """What the stream wrote with what its tail finds."""
    S.use_rocksdb(spark)
    path, state = new_dir(spark, label), new_dir(spark, f"{label}-state")
    S.write_stream(df, path, state).awaitTermination()
    done, rest = spark.read.schema(df.schema).parquet(path), tail(state)
    return done.count(), rest.count(), done.unionByName(rest)


@pytest.mark.parametrize("late", [LATE, "10 minutes"])
def test_finite_streams_come_out_whole(spark, files, late):
    """Also with a delay longer than the whole table, when the stream itself gives nothing."""
    live = S.read_telemetry(spark, files, SCHEMA, late, files_per_trigger=1)
    written, waited, smooth = whole(spark, S.smooth_stream(live, "event_id", 0.4, 5.0), "smooth", lambda at: S.tail(spark, at, S.OnlineSmoother(0.4, 5.0), S.SMOOTHED))
    assert written + waited == len(rows()) and (written == 0) == (late != LATE) and waited > 0
    got, state = {r.order_id: r.smoothed for r in smooth.collect()}, {}
    for robot, _, i, _, joints, _ in rows():
        x = np.array(joints)
        e, limited = state.get(robot, (x, x))
        if robot in state:
            e = 0.4 * x + 0.6 * e
            limited = limited + np.clip(e - limited, -5, 5)
        state[robot] = (e, limited)
        np.testing.assert_allclose(got[i], limited)

    _, _, recorded = whole(spark, S.record_stream(live, "event_id"), "record", lambda at: S.tail(spark, at, S.EpisodeRecorder(), S.RECORDED))
    table = position(spark.createDataFrame(rows(), SCHEMA), ["robot"], ["ts", "event_id"])
    ids = table.select("robot", F.col("position").alias("first_position"), F.col("event_id").alias("first_id"))
    batch = S.recorded_episodes(S.label_episodes(table)).join(ids, ["robot", "first_position"])
    columns = ["robot", "episode", "frames", "first_id", "verdict"]
    assert sorted(map(tuple, S.kept_episodes(recorded).select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))

    signal = F.col("latency_ms") > 30
    _, _, first = whole(spark, S.first_grasps(live, signal, "robot", "event_id"), "grasp", lambda at: S.first_tail(spark, at))
    batch = S.first_grasps(spark.createDataFrame(rows(), SCHEMA), signal, "robot", "event_id")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, batch.collect()))


def test_rate_closes_windows_behind_the_watermark(spark, files):
    live = S.read_telemetry(spark, files, SCHEMA, late="1 second", files_per_trigger=1)
    got = {(r.robot, r.window_start): r.events for r in finish(spark, S.loop_rate(live), "rate").collect()}
    table = S.loop_rate(spark.read.schema(SCHEMA).parquet(files))
    want = {(r.robot, r.window_start): r.events for r in table.collect()}
    assert got and got.items() <= want.items()


def test_first_grasp_once_per_robot(spark, files):
    live = S.read_telemetry(spark, files, SCHEMA, LATE, files_per_trigger=1)
    signal = F.col("latency_ms") > 30
    got = {tuple(r) for r in finish(spark, S.first_grasps(live, signal, "robot", "event_id"), "grasp").collect()}
    table = S.first_grasps(spark.createDataFrame(rows(), SCHEMA), signal, "robot", "event_id")
    assert got == {tuple(r) for r in table.collect()} and len(got) == 3


def test_worked_state_machine(spark):
    keys = ["B", None, None, "N", None, "B", "B", None, "R", "N", "B", None, "left", "B", None]
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(keys)], "robot string, position long, key string")
    for size in (3, 100):
        got = sorted(tuple(r) for r in S.recorded_episodes(S.label_episodes(df, size=size)).collect())
        assert got == [("r", 0, 2, 0, "success"), ("r", 1, 1, 5, "fail")]


def test_recorder_keys_in_batch(spark):
    keys = ["left", "B", None, "N", "left", "B", None, None, "right", "B", None, "esc", "left", "B", None, "R", None, "left", "left", "B", None, "N", "quit", "left"]
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(keys)], "robot string, position long, key string")
    for size in (3, 100):
        got = sorted(tuple(r) for r in S.recorded_episodes(S.label_episodes(df, size=size)).collect())
        assert got == [("r", 1, 2, 5, "success"), ("r", 4, 1, 19, "success")]


def test_median_is_exact(spark):
    values = [float(v) for v in np.random.default_rng(6).lognormal(3, 2, 5000)]
    df = spark.createDataFrame([("r0", START, v) for v in values], "robot string, ts timestamp, latency_ms double")
    assert S.loop_rate(df).first().p50_ms == sorted(values)[2499]


def test_joint_renaming(spark):
    df = spark.createDataFrame([("joint_1",), ("joint_6",), ("other",)], "joint string")
    assert [r.joint for r in S.rename_joints(df).collect()] == ["Rotation", "Jaw", None]


@pytest.mark.parametrize("tolerance, us", [("20 milliseconds", 20_000), ("1 second", 1_000_000)])
def test_pairs_of_one_robot_and_joint_spread_over_keys(spark, tolerance, us):
    rng = np.random.default_rng(2)
    at = [sorted(int(v) for v in rng.integers(-2_000_000, 3_000_000, 150)) + [0, 20_000, 1_000_000] for _ in "ab"]
    sides = [
        spark.createDataFrame([("r", "j", v, float(v)) for v in side], "robot string, joint string, us long, value double").withColumn("ts", F.timestamp_micros("us")).drop("us")
        for side in at
    ]
    got = sorted((int(r.leader_value), int(r.follower_value)) for r in S.pair_by_time(*sides, tolerance).collect())
    assert got == sorted((a, b) for a in at[0] for b in at[1] if abs(a - b) <= us)
    plan = S.pair_by_time(*sides, tolerance)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "_near" in plan


class Memory:
    """Handle, states and timers of a stateful processor, kept as the state store does, outside of the processor."""

    def __init__(self, watermark=0):
        self.maps, self.values, self.watermark = {}, {}, watermark

    def getMapState(self, name, key, value):
        rows = self.maps.setdefault(name, {})
        return SimpleNamespace(updateValue=rows.__setitem__, getValue=rows.__getitem__, removeKey=rows.pop)

    def getValueState(self, name, schema):
        rows = self.values
        return SimpleNamespace(exists=lambda: name in rows, get=lambda: rows[name], update=lambda v: rows.__setitem__(name, v), clear=lambda: rows.pop(name))

    def registerTimer(self, at):
        self.timer = at

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Collects(S.InOrder):
    row = "order_ts long, order_id long, key string"
    kept = "last string"

    def take(self, key, rows):
        yield rows


def frames(rows, piece):
    for i in range(0, len(rows), piece):
        yield pd.DataFrame(rows[i : i + piece], columns=["order_ts", "order_id", "key"])


@pytest.mark.parametrize("run, page, fan", [(65_536, 4096, 256), (50, 7, 256), (50, 7, 3), (10, 1, 2)])
def test_rows_that_wait_come_in_order_and_once(monkeypatch, run, page, fan):
    for name, value in (("RUN", run), ("PAGE", page), ("FAN", fan)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(3)
    rows = [(int(t), int(i), str(n)) for n, (t, i) in enumerate(zip(rng.integers(0, 400, 900) * 500, rng.integers(0, 5, 900), strict=True))]
    memory = Memory()
    told = Collects()
    told.init(memory)
    got, left = [], list(rows)
    for turn, watermark in enumerate((0, 40, 40, 90, 1000)):
        memory.watermark = watermark
        some, left = (left[:300], left[300:]) if turn else (left[:0], left)
        out = [r for f in told.handleInputRows(("r",), frames(some, 40), memory) for r in f.itertuples(index=False, name=None)]
        assert all(r[0] < watermark * 1000 for r in out)
        assert out == sorted(out, key=lambda r: r[:2])
        got.append(out)
    seen = [r for out in got for r in out]
    assert collections.Counter(seen) == collections.Counter(rows) and not memory.maps["waiting"] and "listed" not in memory.values
    # Rows of one time and id that come at once keep their order.
    assert got[1] == sorted((r for r in rows[:300] if r[0] < 40_000), key=lambda r: r[:2])


def test_rows_without_a_time_wait_to_the_end():
    memory = Memory(10)
    told = Collects()
    told.init(memory)
    out = list(told.handleInputRows(("r",), iter([pd.DataFrame({"order_ts": [None, 5000.0], "order_id": [1, 2], "key": [None, "B"]})]), memory))
    assert [tuple(r) for f in out for r in f.itertuples(index=False)] == [(5000, 2, "B")] and len(memory.maps["waiting"]) == 1


def test_memory_does_not_follow_the_rows_of_a_key():
    """One robot's rows come at once in any order; they are neither held nor given as a whole."""
    memory, n = Memory(), 400_000
    told = Collects()
    told.init(memory)
    at = np.random.default_rng(1).permutation(n)

    def sent():
        for i in range(0, n, 10_000):
            yield pd.DataFrame({"order_ts": at[i : i + 10_000], "order_id": at[i : i + 10_000], "key": [f"key {v}" for v in at[i : i + 10_000]]})

    assert list(told.handleInputRows(("r",), sent(), memory)) == []
    memory.watermark, tops, total = n, [], 0
    stored = sum(len(v[0]) for v in memory.maps["waiting"].values())
    for f in told.handleExpiredTimer(("r",), memory, None):
        assert (np.diff(f["order_ts"]) > 0).all()
        tops.append(len(f))
        total += len(f)
    assert total == n and max(tops) < 140_000 and stored > 10_000_000
