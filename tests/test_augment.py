import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.functions import poses as P
from armature.functions.draws import gaussian, keyed
from armature.operators import augment as G
from armature.operators import neighbours as N
from armature.operators import training as R
from armature.operators.episodes import Subtask

POSE = "array<double>"


def random_poses(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return np.hstack([rng.normal(size=(n, 3)) * spread, q])


def brute(scenes, segs, k, w):
    out = {}
    for s, (obj, p) in enumerate(scenes):
        d = []
        for g, (other, q) in enumerate(segs):
            if other == obj:
                turn = 2 * np.arccos(min(1.0, abs(np.dot(p[3:], q[3:]))))
                d.append((w[0] * np.linalg.norm(p[:3] - q[:3]) + w[1] * turn, g))
        out[s] = [g for _, g in sorted(d)[:k]]
    return out


def test_visited_tiles_grow_slower_than_the_pool(spark):
    """Scenes within two centimetres: the rotation bounds what position can't tell apart."""
    rng = np.random.default_rng(8)

    def poses(n):
        q = rng.normal(size=(n, 4))
        return np.concatenate([rng.uniform(-0.02, 0.02, (n, 3)), q / np.linalg.norm(q, axis=1)[:, None]], axis=1)

    asked = spark.createDataFrame([(i, "cube", p.tolist()) for i, p in enumerate(poses(20))], "scene long, object_ref string, object_pose array<double>")
    visited = []
    for n in (2000, 16000):
        p = poses(n)
        segs = spark.createDataFrame([(i, "cube", x.tolist()) for i, x in enumerate(p)], "segment long, object_ref string, object_pose array<double>")
        stats = []
        got = N.nearest_segments(asked, segs, 3, packed=8, tile=20, stats=stats)
        found = {}
        for r in got.collect():
            found.setdefault(r.scene, []).append((r["rank"], r.segment))
        for r in asked.collect():
            at = np.array(r.object_pose)
            d = np.linalg.norm(p[:, :3] - at[:3], axis=1) + 2 * np.arccos(np.minimum(1, np.abs(p[:, 3:] @ at[3:])))
            assert [s for _, s in sorted(found[r.scene])] == np.argsort(d, kind="stable")[:3].tolist()
        visited.append(stats[0])
    # Eight times the segments; all tiles would be 100 and 800 a scene.
    assert visited[1] < 4 * visited[0] and visited[1] < 20 * 800 * 0.25, visited


@pytest.mark.parametrize("weights", [(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (5.0, 0.1)])
@pytest.mark.parametrize("packed", [4, 4096])
def test_nearest_segments_match_brute_force(spark, weights, packed):
    scene_poses, seg_poses = random_poses(12, 1), random_poses(150, 2)
    seg_poses[50:100, :3] *= 0.001  # a hot spot
    scenes = [(["cup", "plate"][i % 2], p) for i, p in enumerate(scene_poses)]
    segs = [("cup" if i % 3 else "plate", p) for i, p in enumerate(seg_poses)]
    s = spark.createDataFrame([(i, o, p.tolist()) for i, (o, p) in enumerate(scenes)], f"scene long, object_ref string, object_pose {POSE}")
    g = spark.createDataFrame([(i, o, p.tolist()) for i, (o, p) in enumerate(segs)], f"segment long, object_ref string, object_pose {POSE}")
    near = N.nearest_segments(s, g, 5, pos_weight=weights[0], rot_weight=weights[1], packed=packed)
    got = {}
    for r in near.orderBy("scene", "rank").collect():
        got.setdefault(r.scene, []).append(r.segment)
    assert got == brute(scenes, segs, 5, weights)


def test_members_of_a_tile_are_measured_once_for_all_its_scenes(spark, monkeypatch):
    """Only members that may be near go on, from several copies of a tile too; poses that can't be measured rank as in one row."""
    monkeypatch.setattr(N, "VISITS", 7)
    scene_poses, seg_poses = random_poses(40, 1), random_poses(400, 2)
    s = [(i if i != 5 else None, "cup", p.tolist()) for i, p in enumerate(scene_poses)] + [(99, "cup", [None] * 7), (98, None, scene_poses[0].tolist())]
    g = [(i, "cup", p.tolist()) for i, p in enumerate(seg_poses)] + [(900, "cup", [None] * 7), (901, None, seg_poses[0].tolist())]
    scenes = spark.createDataFrame(s, f"scene long, object_ref string, object_pose {POSE}")
    segs = spark.createDataFrame(g, f"segment long, object_ref string, object_pose {POSE}")
    got, seen = {}, []
    kept = N._near_members
    monkeypatch.setattr(N, "_near_members", lambda *a: (seen.append((a[0].count(), kept(*a))), seen[-1][1])[1])
    for packed in (4, 4096):
        rows = N.nearest_segments(scenes, segs, 5, packed=packed).collect()
        got[packed] = sorted(((r.scene if r.scene is not None else -1, r.segment, r["rank"], r.distance or -1) for r in rows))
    assert got[4] == got[4096] and len(got[4]) == 41 * 5
    measured = [df.filter("_scene < 90").count() for _, df in seen]
    assert all(n < 25 * visits for (visits, _), n in zip(seen, measured, strict=True))  # of up to 256 members each


def test_fewer_segments_than_k(spark):
    s = spark.createDataFrame([(0, "cup", random_poses(1, 1)[0].tolist())], f"scene long, object_ref string, object_pose {POSE}")
    g = spark.createDataFrame([(i, "cup", p.tolist()) for i, p in enumerate(random_poses(3, 2))], f"segment long, object_ref string, object_pose {POSE}")
    for packed in (1, 100):
        assert N.nearest_segments(s, g, 5, packed=packed).count() == 3
    for strategy in ("random", "nearest_neighbor_object"):
        assert N.choose_segments(s, g, 3, strategy).count() == 1
    with pytest.raises(ValueError):
        N.nearest_segments(s, g, 1, "random")


def test_warp_keeps_the_pose_relative_to_the_object(spark):
    old, new, eef = random_poses(10, 1), random_poses(10, 2), random_poses(10, 3)
    chosen = spark.createDataFrame([(i, i, 0, p.tolist()) for i, p in enumerate(new)], f"scene long, demo long, subtask int, new_object_pose {POSE}")
    pool = spark.createDataFrame(
        [(i, 0, 0, o.tolist(), e.tolist()) for i, (o, e) in enumerate(zip(old, eef, strict=True))],
        f"demo long, subtask int, step long, object_pose {POSE}, eef_pose {POSE}",
    ).withColumn("target_eef_pose", F.col("eef_pose"))
    for plan in ({"scenes_per_task": 1}, {"size": 1}):
        many = chosen.withColumn("scene", F.explode(F.sequence(F.lit(0), F.lit(4))))
        long = pool.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
        assert G.warp(many, long, **plan).count() == 10 * 5 * 3
    source = pool.select("demo", P.to_matrix(P.relative("object_pose", "eef_pose")).alias("before"))
    done = G.warp(chosen, pool).select("demo", P.to_matrix(P.relative("new_object_pose", "eef_pose")).alias("after"))
    for r in source.join(done, "demo").collect():
        np.testing.assert_allclose(r.before, r.after, atol=1e-9)


def test_stitching_counts_and_order(spark):
    rows = [("s", 0, t, random_poses(1, t)[0].tolist(), 0.5) for t in range(4)]
    rows += [("s", 1, t, random_poses(1, 10 + t)[0].tolist(), 0.1) for t in range(3)]
    warped = spark.createDataFrame(rows, f"scene string, subtask int, step long, target_eef_pose {POSE}, gripper double")
    tasks = (Subtask("cup", "grasp"), Subtask("plate", interpolation_steps=5, fixed_steps=2))
    got = G.stitch(warped, tasks, size=2).orderBy("t").collect()
    assert [r.t for r in got] == list(range(4 + 5 + 2 + 3))
    assert [r.part for r in got] == ["segment"] * 4 + ["interpolation"] * 5 + ["fixed"] * 2 + ["segment"] * 3
    first = rows[4][3]
    assert got[9].target_eef_pose == first and got[11].target_eef_pose == first
    assert got[5].gripper == 0.1
    gaps = [np.linalg.norm(np.array(a.target_eef_pose[:3]) - np.array(b.target_eef_pose[:3])) for a, b in zip(got[3:9], got[4:10], strict=True)]
    np.testing.assert_allclose(gaps, [gaps[0]] * 6, rtol=1e-9)


def test_noise_touches_segments_only(spark):
    rows = [("s", t, part, [0.0] * 3 + [1.0, 0.0, 0.0, 0.0]) for t, part in enumerate(["segment", "interpolation", "fixed"] * 200)]
    df = spark.createDataFrame(rows, f"scene string, t long, part string, target_eef_pose {POSE}")
    noisy = G.add_action_noise(df, 0.002)
    moved = noisy.filter("target_eef_pose[0] <> 0")
    assert {r.part for r in moved.select("part").distinct().collect()} == {"segment"}
    sd = moved.agg(F.stddev_pop(F.get("target_eef_pose", F.lit(0)))).first()[0]
    assert 0.0015 < sd < 0.0025
    assert G.add_action_noise(df, 0.002, in_interpolation=True).filter("target_eef_pose[0] = 0").count() == 0
    again = G.add_action_noise(df.repartition(7), 0.002)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(noisy) == key(again)


def test_scenes_stay_in_range(spark):
    base = spark.createDataFrame([("d", "cup", [1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0])], f"demo string, object_ref string, object_pose {POSE}")
    got = G.new_scenes(base, 300).collect()
    xs = np.array([r.object_pose[:3] for r in got])
    assert len(got) == 300 and np.abs(xs[:, 0] - 1).max() <= 0.02 and np.abs(xs[:, 1] - 2).max() <= 0.02
    assert (xs[:, 2] == 3.0).all() and np.unique(xs[:, 0]).size == 300


@pytest.mark.parametrize("size", [4, 1000])
def test_acceptance_stops_at_the_first_limit(spark, size):
    wins = [("w", i, i % 2 == 0) for i in range(100)]
    losses = [("l", i, None if i % 3 == 0 else i == 40) for i in range(100)]
    df = spark.createDataFrame(wins + losses, "run string, attempt long, success boolean")
    report = {r.run: r for r in G.acceptance_report(G.accept(df, size=size)).collect()}
    assert (report["w"].attempts, report["w"].successes) == (39, 20)
    assert (report["l"].attempts, report["l"].successes, report["l"].failures) == (51, 1, 50)
    assert G.accept(df, size=size, keep_failed=False).filter("not coalesce(success, false)").count() == 0
    assert G.accept(df, size=size, guarantee=False).filter("run = 'w'").count() == 20


def test_flow_moments(spark):
    df = spark.range(20_000).select(F.col("id").alias("frame_index"), F.lit("d").alias("dataset"), F.lit(0).alias("episode_index"))
    times = R.flow_times(df)
    mean, low, high = times.agg(F.avg("flow_t"), F.min("flow_t"), F.max("flow_t")).first()
    assert abs(mean - 0.3994) < 0.01 and low >= -0.0011 and high < 1.0
    assert times.filter("flow_bucket < 0 or flow_bucket > 999").count() == 0
    draw = keyed(1, "frame_index")
    m, s = df.select(gaussian(draw, "x").alias("g")).agg(F.avg("g"), F.stddev_pop("g")).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03


def test_flow_targets_follow_their_definition(spark):
    df = spark.createDataFrame([("d", 0, 0, [[1.0, 2.0], [3.0, 4.0]])], "dataset string, episode_index long, frame_index long, chunk array<array<double>>")
    r = R.flow_targets(df, horizon=2, dim=2).first()
    a, n = np.array(r.chunk), np.array(r.noise)
    np.testing.assert_allclose(r.noisy, (1 - r.flow_t) * n + r.flow_t * a)
    np.testing.assert_allclose(r.velocity, a - n)
    assert len(set(n.reshape(-1))) == 4
