"""Structured Streaming over the event files, run to the end of what is there.

Each query starts a stream with an available-now trigger, writes to the shared folder and
returns the written table.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import query, r6, spread, sql_r6
from armature.catalog.window_queries import recursion
from armature.operators.frames import name_joints
from armature.plans.blocks import position
from armature.schema import KEYS, POS
from armature.session import new_dir
from armature.streaming import telemetry as S

FRAME = [*KEYS, POS]


def _events(fx, late: str = S.LATE) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of files."""
    path = f"{fx.dir}/events.parquet"
    root, glob = (path, None) if not os.path.isfile(path) else (fx.dir, "events.parquet")
    return S.read_telemetry(fx.spark, root, fx.table("events").schema, late, glob=glob)


def _run(fx, df: DataFrame, label: str, tail: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """What the stream has written, and what `tail` finds in its state when it has ended."""
    S.use_rocksdb(fx.spark)
    path, state = new_dir(fx.spark, label), new_dir(fx.spark, f"{label}-state")
    with _state_partitions(fx.spark):
        S.write_stream(df, path, state).awaitTermination()
    done = fx.spark.read.schema(df.schema).parquet(path)
    return done if tail is None else done.unionByName(tail(state))


@contextmanager
def _state_partitions(spark):
    """On a local session as many state partitions as cores; a cluster's setting is left alone."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _robot():
    return (F.col("user_id") % 8).cast("string").alias("robot")


def _joints():
    e = F.col("event_id")
    arm = [((e * (7 * j + 3)) % 2001) / F.lit(10.0) - F.lit(100.0) for j in range(1, 5)]
    return F.array(F.col("value"), *arm, ((e * 31) % 1001) / F.lit(10.0)).alias("joints")


_ROBOTS = f"""{Q.FRAMES},
rb AS (SELECT CAST(episode_index % 8 AS VARCHAR) AS robot, row_number() OVER (PARTITION BY episode_index % 8 ORDER BY ts, event_id) - 1 AS n,
  event_id, {Q.ACTION} FROM fx)"""


@query(
    "stream_smooth",
    f"WITH {recursion([('ema', 0.3), ('limit', 5.0)], _ROBOTS, 'rb', ('robot',), 'n')} SELECT robot, event_id, "
    + ", ".join(sql_r6(f"z1_{i}", f"y{i}") for i in range(6))
    + " FROM r JOIN src USING (robot, n)",
)
def stream_smooth(fx):
    """All rows, smoothed in event-time order: most in the stream, those that wait at its end in its tail."""
    live = _events(fx).select(_robot(), "ts", "event_id", _joints())
    done = _run(fx, S.smooth_stream(live, "event_id"), "stream-smooth", lambda at: S.tail(fx.spark, at, S.OnlineSmoother(), S.SMOOTHED))
    return done.select("robot", F.col("order_id").alias("event_id"), *spread("smoothed", "y", 6))


_RATE = """
w AS (SELECT CAST(user_id % 8 AS VARCHAR) AS robot, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, count(*) AS events,
  avg(value) AS mean, quantile_disc(value, 0.5) AS p50_ms FROM events GROUP BY ALL)"""


@query(
    "stream_rate",
    f"""WITH {_RATE} SELECT robot, window_us, events, {sql_r6("mean", "mean_ms")}, p50_ms FROM w
    WHERE window_us + 3600000000 <= (SELECT epoch_us(max(ts)) - 10000000 FROM events)""",
)
def stream_rate(fx):
    """Hourly windows that the watermark has closed."""
    live = _events(fx).select(_robot(), "ts", F.col("value").alias("latency_ms"))
    done = _run(fx, S.loop_rate(live, width="1 hour"), "stream-rate")
    return done.select(
        "robot", F.unix_micros("window_start").alias("window_us"), "events", r6("mean_ms").alias("mean_ms"), "p50_ms"
    )


@query("loop_rate", f"WITH {_RATE} SELECT robot, window_us, events, {sql_r6('mean', 'mean_ms')}, p50_ms FROM w")
def loop_rate(fx):
    """The same windows over the table."""
    rows = fx.table("events").select(
        _robot(), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms")
    )
    return S.loop_rate(rows, width="1 hour").select(
        "robot", F.unix_micros("window_start").alias("window_us"), "events", r6("mean_ms").alias("mean_ms"), "p50_ms"
    )


_MACHINE = """
k AS (SELECT CAST(user_id % 8 AS VARCHAR) AS robot, event_id, ts, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS position,
  CASE event_type WHEN 'signup' THEN 'B' WHEN 'purchase' THEN 'N' WHEN 'error' THEN 'R' END AS key FROM events),
b AS (SELECT *, coalesce(last_value(key IGNORE NULLS) OVER (PARTITION BY robot ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'B', false) AS on_before FROM k),
s AS (SELECT *, coalesce(key = 'B', false) AND NOT on_before AS starts FROM b),
n AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY robot ORDER BY position ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM s),
ep AS (SELECT robot, CAST(episode AS BIGINT) AS episode, count(*) FILTER (on_before AND key IS NULL) AS frames, min(position) AS first_position,
  arg_min(event_id, position) AS first_id,
  max(CASE WHEN on_before AND key = 'N' THEN 'success' WHEN on_before AND key = 'R' THEN 'fail' END) AS verdict
  FROM n WHERE on_before OR starts GROUP BY ALL)"""


def _key():
    kind = F.col("event_type")
    return F.when(kind == "signup", "B").when(kind == "purchase", "N").when(kind == "error", "R").alias("key")


def _keyed(fx):
    rows = fx.table("events").select(_robot(), "ts", "event_id", _key())
    return position(rows, ["robot"], ["ts", "event_id"], fx.time_buckets())


@query(
    "recorded_episodes",
    f"WITH {_MACHINE} SELECT robot, episode, frames, first_position, verdict FROM ep WHERE verdict IS NOT NULL",
)
def recorded_episodes(fx):
    """The recording state machine over the table."""
    return S.recorded_episodes(S.label_episodes(_keyed(fx), longest=fx.rows))


@query(
    "recorded_episodes_blocked",
    f"WITH {_MACHINE} SELECT robot, episode, frames, first_position, verdict FROM ep WHERE verdict IS NOT NULL",
)
def recorded_episodes_blocked(fx):
    """The plan for long histories, forced by a block of 64 rows."""
    return S.recorded_episodes(S.label_episodes(_keyed(fx), size=64))


@query(
    "stream_episodes",
    f"WITH {_MACHINE} SELECT robot, episode, frames, first_id, verdict FROM ep WHERE verdict IS NOT NULL",
)
def stream_episodes(fx):
    """Episodes that the stream or its tail has finished."""
    live = _events(fx).select(_robot(), "ts", "event_id", _key())
    return _run(fx, S.record_stream(live, "event_id"), "stream-episodes", lambda at: S.tail(fx.spark, at, S.EpisodeRecorder(), S.RECORDED))


_PRESSED = """CASE WHEN event_id % 17 = 0 THEN 'left' WHEN event_id % 23 = 0 THEN 'right' WHEN event_id % 29 = 0 THEN 'esc'
  WHEN event_id % 31 = 0 THEN 'quit' WHEN event_type = 'signup' THEN 'B' WHEN event_type = 'purchase' THEN 'N' WHEN event_type = 'error' THEN 'R' END"""


# Episodes that were finished and not taken back, with every key of the recorder.
_RECORDER = f"""
k AS (SELECT CAST(user_id % 8 AS VARCHAR) AS robot, event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS position,
  {_PRESSED} AS key FROM events),
b AS (SELECT *, coalesce(last_value(key IGNORE NULLS) OVER (PARTITION BY robot ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last FROM k),
n AS (SELECT *, sum(CASE WHEN key = 'B' AND last <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY robot ORDER BY position ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM b),
ep AS (SELECT robot, CAST(episode AS BIGINT) AS episode, count(*) FILTER (last = 'B' AND key IS NULL) AS frames, arg_min(event_id, position) FILTER (last = 'B' OR key = 'B') AS first_id,
  max(CASE WHEN last = 'B' AND key IN ('N', 'right') THEN 'success' WHEN last = 'B' AND key = 'R' THEN 'fail' END) AS verdict,
  coalesce(bool_or(key = 'left' AND last IN ('N', 'R', 'right')), false) AS taken FROM n WHERE episode >= 0 GROUP BY ALL)
SELECT robot, episode, frames, first_id, verdict FROM ep WHERE verdict IS NOT NULL AND NOT taken"""


def _pressed():
    e, kind = F.col("event_id"), F.col("event_type")
    odd = F.when(e % 17 == 0, "left").when(e % 23 == 0, "right").when(e % 29 == 0, "esc").when(e % 31 == 0, "quit")
    return odd.when(kind == "signup", "B").when(kind == "purchase", "N").when(kind == "error", "R").alias("key")


@query("recorder_keys", f"WITH {_RECORDER}")
def recorder_keys(fx):
    """The state machine over the table with every key: also next, stop, quit and taking back."""
    rows = fx.table("events").select(_robot(), "ts", "event_id", _pressed())
    placed = position(rows, ["robot"], ["ts", "event_id"], fx.time_buckets())
    found = S.recorded_episodes(S.label_episodes(placed, longest=fx.rows))
    ids = placed.select("robot", F.col("position").alias("first_position"), F.col("event_id").alias("first_id"))
    return found.join(ids, ["robot", "first_position"]).select("robot", "episode", "frames", "first_id", "verdict")


@query("stream_recorder_keys", f"WITH {_RECORDER}")
def stream_recorder_keys(fx):
    """The same on the stream and its tail."""
    live = _events(fx).select(_robot(), "ts", "event_id", _pressed())
    found = _run(fx, S.record_stream(live, "event_id"), "stream-recorder", lambda at: S.tail(fx.spark, at, S.EpisodeRecorder(), S.RECORDED))
    return S.kept_episodes(found)


_FIRST = "SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(min(ts)) AS order_ts, arg_min(event_id, ts) AS order_id FROM events WHERE value > 150 GROUP BY user_id"


@query("stream_first_grasp", _FIRST)
def stream_first_grasp(fx):
    live = _events(fx).select("user_id", "ts", "event_id", "value")
    grasps = S.first_grasps(live, F.col("value") > 150, "user_id", "event_id")
    return _run(fx, grasps, "stream-first-grasp", lambda at: S.first_tail(fx.spark, at))


@query("first_grasps", _FIRST)
def first_grasps(fx):
    rows = fx.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.first_grasps(rows, F.col("value") > 150, "user_id", "event_id")


@query(
    "stream_pairs",
    """WITH a AS (SELECT user_id % 8 AS robot, ts, 1 + event_id % 6 AS j, value FROM events WHERE event_type = 'click'),
    b AS (SELECT user_id % 8 AS robot, ts, 1 + event_id % 6 AS j, value FROM events WHERE event_type = 'view')
    SELECT CAST(a.robot AS VARCHAR) AS robot, ['Rotation', 'Pitch', 'Elbow', 'Wrist_Pitch', 'Wrist_Roll', 'Jaw'][a.j] AS joint,
      epoch_us(a.ts) AS leader_us, a.value AS leader_value, epoch_us(b.ts) AS follower_us, b.value AS follower_value
    FROM a JOIN b ON a.robot = b.robot AND a.j = b.j AND b.ts >= a.ts - INTERVAL 20 MINUTES AND b.ts <= a.ts + INTERVAL 20 MINUTES""",
)
def stream_pairs(fx):
    """Clicks lead and views follow: rows of the same robot and joint up to 20 minutes apart."""

    def side(kind: str) -> DataFrame:
        rows = _events(fx, "1 hour").filter(F.col("event_type") == kind)
        joint = F.concat(F.lit("joint_"), (F.col("event_id") % 6 + 1).cast("string")).alias("joint")
        return rows.select(_robot(), "ts", joint, "value")

    pairs = S.pair_by_time(side("click"), side("view"), "20 minutes")
    done = S.rename_joints(_run(fx, pairs, "stream-pairs"))
    return done.select(
        "robot",
        "joint",
        F.unix_micros("leader_ts").alias("leader_us"),
        "leader_value",
        F.unix_micros("follower_ts").alias("follower_us"),
        "follower_value",
    )


@query(
    "stream_resume",
    "SELECT event_id, CAST(user_id % 8 AS VARCHAR) AS robot, value FROM events",
)
def stream_resume(fx):
    """A stream stopped and started again on its checkpoint after files arrived: every row is written once."""
    events = fx.table("events")
    source, path, state = (new_dir(fx.spark, f"stream-resume-{x}") for x in ("source", "out", "state"))
    for turn in range(3):
        # The third run finds nothing new.
        if turn < 2:
            events.filter(F.col("event_id") % 2 == turn).write.mode("append").parquet(source)
        live = S.read_telemetry(fx.spark, source, events.schema).select("event_id", _robot(), "value")
        S.write_stream(live, path, state).awaitTermination()
    return fx.spark.read.schema(live.schema).parquet(path)


@query(
    "stream_flush",
    "SELECT event_id // 100 AS flush_block, count(*) AS samples, min(value) AS low FROM events GROUP BY ALL",
)
def stream_flush(fx):
    """Micro-batches written with their flush block, counted per block."""
    path = new_dir(fx.spark, "stream-flush")
    live = _events(fx).select(F.col("event_id").alias("t"), "value")
    S.flush_stream(live, path, new_dir(fx.spark, "stream-flush-state")).awaitTermination()
    rows = fx.spark.read.schema("t long, value double, flush_block long").parquet(path)
    return rows.groupBy("flush_block").agg(F.count(F.lit(1)).alias("samples"), F.min("value").alias("low"))


@query(
    "flush_blocks",
    f"WITH {Q.FRAMES} SELECT dataset, episode_index, frame_index // 20 AS flush_block, count(*) AS samples FROM fx GROUP BY ALL",
)
def flush_blocks(fx):
    blocks = S.flush_blocks(fx.frames(), 20, POS)
    return blocks.groupBy(*KEYS, "flush_block").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "rename_joints",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, unnest(['Rotation', 'Pitch', 'Elbow', 'Wrist_Pitch', 'Wrist_Roll', 'Jaw']) AS joint, unnest([{Q.ACTION}]) AS value FROM fx""",
)
def rename_joints(fx):
    named = name_joints(fx.frames().select(*FRAME, "action"), "action", "physical")
    return S.rename_joints(named)
