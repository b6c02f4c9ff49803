"""Blocked plans against plain windows, and lookups against plain joins."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from armature.operators import episodes as W
from armature.operators import frames as P
from armature.operators import quality as A
from armature.operators import sampling as T
from armature.plans import blocks as B
from armature.plans import lookups as L

KEYS = ["dataset", "episode_index"]


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(5)
    rows = []
    for episode, length in enumerate([1, 2, 7, 8, 9, 16, 63, 300]):
        for t in range(length):
            value = rng.choice([None, *range(20)])
            rows.append(("d", episode * 3, t, None if value is None else float(value)))
    return spark.createDataFrame(rows, "dataset string, episode_index long, frame_index long, value double").repartition(5).cache()


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("before, after", [(0, 0), (1, 0), (0, 15), (3, 2), (20, 20)])
@pytest.mark.parametrize("size", [1, 8, 1000])
def test_neighbours(frames, before, after, size):
    columns = lambda w: {"seen": F.collect_list(F.coalesce("value", F.lit(-1.0))).over(w.rowsBetween(-before, after))}
    plain = B.over_neighbours(frames, KEYS, "frame_index", columns, before, after, longest=10, size=10)
    blocked = B.over_neighbours(frames, KEYS, "frame_index", columns, before, after, size=size)
    cols = [*KEYS, "frame_index", "seen"]
    assert rows_of(plain, *cols) == rows_of(blocked, *cols)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("kind", ["sum", "max", "min", "last"])
def test_running(frames, kind, inclusive):
    folds = {"out": B.Fold(kind, F.col("value"), inclusive)}
    plain = B.running(frames, KEYS, "frame_index", folds, longest=1, size=1)
    blocked = B.running(frames, KEYS, "frame_index", folds, size=8)
    cols = [*KEYS, "frame_index", "out"]
    assert rows_of(plain, *cols) == rows_of(blocked, *cols)


def test_position_in_buckets(frames):
    plain = B.position(frames, KEYS, ["value", "frame_index"], None, "n")
    value = F.floor(F.col("value") / 4).cast("long")
    bucketed = B.position(frames, KEYS, ["value", "frame_index"], value, "n")
    cols = [*KEYS, "frame_index", "n"]
    assert rows_of(plain, *cols) == rows_of(bucketed, *cols)


def test_rank_buckets_are_needed_only_above_the_limit(frames):
    assert B.rank_buckets(frames, F.col("frame_index")) is None
    bucket = B.rank_buckets(frames, F.col("frame_index"), rows=50)
    counts = frames.groupBy(bucket.alias("b")).count().collect()
    assert len(counts) > 4


def test_slices_hold_alike_with_outliers(spark):
    """A burst and outliers in time leave no slice above twice the mean; the order is kept."""
    at = F.when(F.col("id") == 0, F.lit(-(10**15))).when(F.col("id") == 1, F.lit(10**16)).when(F.col("id") % 2 == 0, F.col("id")).otherwise(10**9 + F.col("id") * 10**6)
    df = spark.range(20_000).select(at.cast("long").alias("at"))
    for rows in (5000, 150):
        bucket = B.rank_buckets(df, F.col("at"), rows=rows)
        got = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("z")).orderBy("b").collect()
        assert len(got) == -(-20_000 // rows) and max(r.n for r in got) < 2 * 20_000 / len(got)
        assert all(x.z < y.a for x, y in zip(got, got[1:], strict=False))
    assert df.select(B.slices_of(F.lit(None).cast("long"), [1, 2])).first()[0] is None
    assert [r[0] for r in spark.range(6).select(B.slices_of(F.col("id"), [1, 1, 4])).collect()] == [0, 2, 2, 2, 3, 3]


def test_folds_in_a_row_share_a_shuffle(frames):
    first = B.running(frames, KEYS, "frame_index", {"top": B.Fold("max", F.col("value"))}, size=8, keep=True)
    both = B.running(first, KEYS, "frame_index", {"sum": B.Fold("sum", F.col("value"))}, size=8)
    plain = B.running(frames, KEYS, "frame_index", {"top": B.Fold("max", F.col("value")), "sum": B.Fold("sum", F.col("value"))}, longest=10**6)
    cols = [*KEYS, "frame_index", "top", "sum"]
    assert rows_of(both, *cols) == rows_of(plain, *cols) and "_block" not in both.columns


def test_attach_repeats_facts_per_block(frames):
    facts = frames.groupBy(*KEYS).agg(F.max("frame_index").alias("last"))
    got = B.attach(frames, facts, KEYS, "frame_index", F.col("last"), size=8)
    want = frames.join(facts, KEYS)
    cols = [*KEYS, "frame_index", "last"]
    assert rows_of(got, *cols) == rows_of(want, *cols)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup_equals_broadcast(spark, frames, how):
    table = spark.createDataFrame([(0, "a"), (3, "b"), (21, "c"), (99, "d")], "episode_index long, name string")
    frames = frames.withColumn("episode_index", F.when(F.col("episode_index") != 15, F.col("episode_index")))
    small = L.lookup_join(frames, table, ["episode_index"], how)
    salted = L.lookup_join(frames, table, ["episode_index"], how, rows=2, per_task=5)
    assert "BroadcastExchange" in small._jdf.queryExecution().toString()
    cols = small.columns
    assert salted.columns == cols
    assert rows_of(small, *cols) == rows_of(salted, *cols)
    assert small.count() > 0


def test_longest_group(frames):
    assert B.longest_group(frames, KEYS, enough=10_000) == frames.count()
    assert B.longest_group(frames, KEYS, enough=10) == 300
    assert B.last_position(frames, "frame_index") == 300
    assert B.last_position(frames.limit(0), "frame_index") == 0


def test_renumber_is_dense_and_blocked_alike(frames):
    kept = frames.filter("value > 3 and episode_index <> 6")
    plain = W.renumber(kept, rows=kept.count())
    blocked = W.renumber(kept, size=8)
    cols = [*KEYS, "frame_index", "index", "value"]
    assert rows_of(plain, *cols) == rows_of(blocked, *cols)
    index = sorted(r["index"] for r in plain.select("index").collect())
    assert index == list(range(kept.count()))
    w = Window.partitionBy(*KEYS)
    assert plain.withColumn("n", F.max("frame_index").over(w) - F.count("*").over(w)).filter("n <> -1").count() == 0
    assert W.renumber(frames.limit(0)).count() == 0


def test_latch_is_monotone_and_matches_the_worked_example(spark):
    rows = [("d", 0, t, t in (45, 60)) for t in range(100)] + [("d", 1, t, None) for t in range(5)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, frame_index long, grasp boolean")
    got = W.latch(df, "grasp", size=16)
    on = sorted(r.frame_index for r in got.filter("latched").collect())
    assert on == list(range(45, 100))
    bounds = {r.episode_index: r for r in W.boundaries(df, ["grasp"]).collect()}
    assert (bounds[0].grasp_boundary, bounds[0].length) == (45, 100)
    assert bounds[1].grasp_boundary is None
    never = W.never_triggered(W.boundaries(df, ["grasp"]), ["grasp"]).collect()
    assert [(r.episode_index, r.signal) for r in never] == [(1, "grasp")]


def test_segments_cover_the_episode_and_reject_a_bad_end(spark):
    df = spark.createDataFrame([("d", 0, 45, 100), ("d", 1, None, 30), ("d", 2, 95, 100)],
                               "dataset string, episode_index long, grasp_ingredient_boundary long, length long")
    segs = {}
    for r in W.segments(df, W.PICK_AND_PLACE).collect():
        segs.setdefault(r.episode_index, []).append((r.subtask, r.start, r.end))
    assert sorted(segs) == [0, 2]
    first, second = sorted(segs[0])
    assert first[1] == 0 and 55 <= first[2] <= 65 and second == (1, first[2], 100)
    assert sorted(segs[2])[0] == (0, 0, 100)
    with pytest.raises(ValueError):
        W.segments(df, [W.Subtask("plate", None, (1, 2))])
    with pytest.raises(ValueError):
        W.segments(df, [W.Subtask("plate", "grasp_ingredient")])


def test_sampler_and_skip(spark):
    rows = [("d", 0, t, t / 30) for t in range(130)] + [("d", 1, t, t / 30) for t in range(9)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, frame_index long, timestamp double")
    kept = P.skip_first(df)
    assert kept.filter("episode_index = 0").count() == 125
    assert kept.agg(F.min("frame_index"), F.min("timestamp")).first()[:] == (0, 0.0)
    sampled = P.episode_sampler(df, 5, 15, size=16)
    got = sorted(r.frame_index for r in sampled.collect())
    assert got == list(range(5, 115))
    assert P.episode_sampler(df, 5).count() == 125 + 4
    assert P.episode_slice(df, 1, 4).count() == 5


def test_demo_filters(spark):
    demos = spark.createDataFrame(
        [("demo_1", 9, True), ("demo_2", 10, True), ("demo_10", 12, None), ("demo_3", 11, False)],
        "demo string, num_samples long, success boolean",
    )
    assert sorted(r.demo for r in P.filter_min_length(demos).collect()) == ["demo_10", "demo_2", "demo_3"]
    frames = spark.createDataFrame(
        [(d, t, [0.0] * 6, [1.0] * 7, [2.0] * 6) for d, n in [("demo_1", 9), ("demo_2", 10), ("demo_10", 12)] for t in range(n)],
        "demo string, t long, actions array<double>, ee_frame_state array<double>, joint_pos_target array<double>",
    )
    assert P.filter_successful(demos, frames, size=4).count() == 19
    ik = P.convert_actions(demos, frames, "ik").first()
    assert ik.actions == [1.0] * 7 + [0.0]
    assert P.convert_actions(demos, frames, "joint").first().actions == [2.0] * 6
    for bad in (None, "both"):
        with pytest.raises(ValueError):
            P.convert_actions(demos, frames, bad)
    demos = demos.withColumn("mimic_generated", F.col("success"))
    report = A.generation_report(demos).first()
    assert report.generated == 2
    assert (report.total, report.successes, report.min_length, report.max_length) == (4, 2, 9, 12)
    assert report.success_percent == 50.0
    assert A.generation_report(demos, total=8).first().success_percent == 25.0


def test_chunks_shorter_than_the_horizon(spark):
    rows = [("d", 0, t, [float(t)]) for t in range(3)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, frame_index long, action array<double>")
    for plan in ({"longest": 3}, {"size": 2}):
        got = {r.frame_index: r for r in W.action_chunks(df, horizon=4, **plan).collect()}
        assert [s[0] for s in got[0].chunk] == [0.0, 1.0, 2.0, 2.0]
        assert got[0].chunk_is_pad == [False, False, False, True]
        assert [s[0] for s in got[2].chunk] == [2.0] * 4
        assert got[2].chunk_is_pad == [False, True, True, True]
        history = {r.frame_index: r for r in W.with_history(df, ["action"], **plan).collect()}
        assert [v[0] for v in history[0].action_window] == [0.0, 0.0]
        assert history[0].action_is_pad == [True, False]
        assert [v[0] for v in history[2].action_window] == [1.0, 2.0]
    change = {r.frame_index: r.delta_max for r in W.step_delta(df, dim=1, size=2).collect()}
    assert change == {0: None, 1: 1.0, 2: 1.0}


def test_large_samples_are_ranked_in_slices(spark):
    df = spark.range(5000).withColumn("_u", T.keyed(1, "id")("x"))
    few = T.smallest(df, 700, ["_u", "id"], F.col("_u"))
    sliced = T.smallest(df, 700, ["_u", "id"], F.col("_u"), top_rows=10)
    assert rows_of(few, "id") == rows_of(sliced, "id")


def test_draws_do_not_follow_partitions(spark):
    df = spark.range(200)
    a = T.shuffled(df.repartition(3), 7, ["id"]).select("id").collect()
    b = T.shuffled(df.repartition(11), 7, ["id"]).select("id").collect()
    c = T.shuffled(df, 8, ["id"]).select("id").collect()
    assert a == b and a != c
    assert rows_of(T.sample_rows(df.repartition(3), 20, 1, ["id"]), "id") == rows_of(T.sample_rows(df, 20, 1, ["id"]), "id")


def test_mixture_prefers_heavy_frames(spark):
    rows = [("a", 0, t) for t in range(10)] + [("b", e, t) for e in range(9) for t in range(100)]
    df = spark.createDataFrame(rows, "dataset string, episode_index long, frame_index long")
    weighted = T.mixture_weights(df, size=16)
    total = weighted.groupBy("dataset").agg(F.sum("weight").alias("w")).collect()
    assert {r.dataset: round(r.w, 9) for r in total} == {"a": 0.5, "b": 0.5}
    drawn = T.draw_mixture(weighted, 10, 3)
    assert drawn.filter("dataset = 'a'").count() >= 3


def test_asof_takes_the_newest_earlier_command(spark):
    commands = spark.createDataFrame([("r", 10, 1.0), ("r", 20, 2.0), ("s", 5, 9.0)], "robot string, us long, v double")
    actual = spark.createDataFrame([("r", 9, 0.0), ("r", 10, 0.1), ("r", 500, 0.2), ("s", 4, 0.3), ("s", 6, 0.4)],
                                   "robot string, us long, v double")
    for size in (4, 1000, None):
        got = {(r.robot, r.us): r.commanded for r in A.asof_tracking(commands, actual, ["robot"], "us", "v", size).collect()}
        assert got == {("r", 9): None, ("r", 10): 1.0, ("r", 500): 2.0, ("s", 4): None, ("s", 6): 9.0}
