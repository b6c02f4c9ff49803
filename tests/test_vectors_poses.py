import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from armature.functions import poses as P
from armature.functions import vectors as V
from armature.operators import frames as O
from armature.operators import quality as A
from armature.schema import DEGREE_LIMITS, JOINTS


def one(df, *cols):
    return df.select(*cols).first()


def quaternions(n, seed=1):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def rotation(q):
    w, x, y, z = q
    return np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
        ]
    )


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    special = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    q = np.vstack([quaternions(20), special])
    r = np.vstack([quaternions(20, 3), special])
    rows = [
        ([*rng.normal(size=3).tolist(), *a.tolist()], [*rng.normal(size=3).tolist(), *b.tolist()])
        for a, b in zip(q, r, strict=True)
    ]
    rows = [([float(v) for v in a], [float(v) for v in b]) for a, b in rows]
    return spark.createDataFrame(rows, "a array<double>, b array<double>").cache()


def matrix(pose):
    m = np.eye(4)
    m[:3, :3] = rotation(pose[3:])
    m[:3, 3] = pose[:3]
    return m


def test_compose_inverse_and_relative_match_matrices(pairs):
    got = pairs.select(
        "a", "b",
        P.to_matrix("a").alias("ma"),
        P.to_matrix(P.compose("a", "b")).alias("ab"),
        P.to_matrix(P.inverse("a")).alias("inv"),
        P.to_matrix(P.relative("a", "b")).alias("rel"),
        P.matrix_product(P.to_matrix("a"), P.matrix_inverse(P.to_matrix("a"))).alias("one"),
        P.from_matrix(P.to_matrix("a")).alias("back"),
    )
    for r in got.collect():
        a, b = matrix(r.a), matrix(r.b)
        shaped = lambda v: np.array(v).reshape(4, 4)
        np.testing.assert_allclose(shaped(r.ma), a, atol=1e-12)
        np.testing.assert_allclose(shaped(r.ab), a @ b, atol=1e-12)
        np.testing.assert_allclose(shaped(r.inv), np.linalg.inv(a), atol=1e-9)
        np.testing.assert_allclose(shaped(r.rel), np.linalg.inv(a) @ b, atol=1e-9)
        np.testing.assert_allclose(shaped(r.one), np.eye(4), atol=1e-9)
        np.testing.assert_allclose(matrix(r.back), a, atol=1e-9)


def test_angle_ignores_the_sign_of_a_quaternion(pairs):
    flipped = pairs.withColumn("c", F.concat(F.slice("a", 1, 3), F.transform(F.slice("a", 4, 4), lambda x: -x)))
    for r in flipped.select(P.angle("a", "c").alias("zero"), P.pose_distance("a", "b").alias("d")).collect():
        assert r.zero < 1e-6 and r.d > 0


def test_interpolation_ends_at_its_poses(pairs):
    got = pairs.select("a", "b", P.interpolate("a", "b", F.lit(0.0)).alias("s"), P.interpolate("a", "b", F.lit(1.0)).alias("e"),
                       P.interpolate("a", "b", F.lit(0.5)).alias("m"))
    for r in got.collect():
        np.testing.assert_allclose(matrix(r.s), matrix(r.a), atol=1e-9)
        np.testing.assert_allclose(matrix(r.e), matrix(r.b), atol=1e-9)
        if abs(np.dot(r.a[3:], r.b[3:])) > 1e-6:
            assert abs(np.linalg.norm(r.m[3:]) - 1) < 1e-9


def test_remap_round_trip_and_ends(spark):
    lows, highs = [float(a) for a, _ in DEGREE_LIMITS], [float(b) for _, b in DEGREE_LIMITS]
    df = spark.createDataFrame([([math.radians(v) for v in lows],), ([math.radians(v) for v in highs],)], "q array<double>")
    normal = O.remap_joints(df, "q", out="n")
    got = sorted(tuple(round(v, 9) for v in r.n) for r in normal.collect())
    assert got == [(-100.0,) * 5 + (0.0,), (100.0,) * 6]
    back = O.remap_joints(normal, "n", "to_angles", out="again")
    for r in back.collect():
        np.testing.assert_allclose(r.again, r.q, atol=1e-12)
    with pytest.raises(ValueError):
        O.remap_joints(df, "q", "sideways")


def test_fractions_clamp_and_keep_null(spark):
    df = spark.createDataFrame([([-150.0, -100.0, 0.0, 100.0, 250.0, 50.0],), ([None] * 6,)], "v array<double>")
    rows = [r.fraction for r in O.range_fractions(df, "v").collect()]
    assert rows[0] == [0.0, 0.0, 0.5, 1.0, 1.0, 0.5]
    assert rows[1] == [None] * 6


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],)], "v array<double>")
    padded = O.pad_with_mask(df, "v", 4)
    assert [(r.v, r.v_mask) for r in padded.collect()] == [
        ([1.0, 2.0, 0.0, 0.0], [True, True, False, False]),
        ([0.0] * 4, [False] * 4),
    ]
    with pytest.raises(PySparkException):
        O.pad_with_mask(df, "v", 1).collect()


def test_constant_dimension_normalises_to_zero(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    stats = A.feature_stats(df, {"v": 2})
    scaled = O.normalize_minmax(df, stats, "v", 2)
    assert [r.v for r in scaled.collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    restored = O.denormalize_minmax(scaled, stats, "v", dim=2)
    assert [r.v for r in restored.collect()] == [[1.0, 5.0], [3.0, 5.0]]
    off = O.normalize_minmax(df, stats, "v", 2, enabled=False)
    assert [r.v for r in off.collect()] == [[1.0, 5.0], [3.0, 5.0]]


def test_deviation_rules(spark):
    df = spark.createDataFrame([([1.0],), ([3.0],)], "v array<double>")
    assert A.feature_stats(df, {"v": 1}, ddof=1).first()["std"] == pytest.approx(math.sqrt(2))
    assert A.feature_stats(df, {"v": 1}, ddof=0).first()["std"] == 1.0


def test_merge_needs_six_elements(spark):
    df = spark.createDataFrame([([0.0] * 5, [1.0])], "`action.single_arm` array<double>, `action.gripper` array<double>")
    assert O.merge_modalities(df, "action").first().action == [0.0] * 5 + [1.0]
    short = spark.createDataFrame([([0.0] * 4, [1.0])], "`action.single_arm` array<double>, `action.gripper` array<double>")
    with pytest.raises(PySparkException):
        O.merge_modalities(short, "action").collect()


def test_swapped_cameras(spark):
    df = spark.createDataFrame([("a", "b", 1)], "main string, secondary_0 string, n int")
    fixed = O.remap_keys(df, {"front": "secondary_0", "wrist": "main"})
    assert fixed.first().asDict() == {"wrist": "a", "front": "b", "n": 1}
    with pytest.raises(ValueError):
        O.remap_keys(df, {"front": "nothing"})


def test_default_task_keeps_blanks(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), (" ",)], "t string")
    got = [r[0] for r in df.select(O.default_task("t")).collect()]
    assert got == ["x", "Perform the task.", "Perform the task.", " "]


def test_prompts_prefer_the_longer_name(spark):
    df = spark.createDataFrame([("bread_slice_2",), ("x/patty_demos.bin",), ("lettuce",)], "f string")
    got = [r.task for r in O.assign_prompt(df, "f").collect()]
    assert got[0].startswith("Pick up the second") and got[1].startswith("Pick up the patty")
    assert got[2] == "Perform the task."


def test_safe_goals(spark):
    df = spark.createDataFrame([([10.0, -10.0, 1.0], [0.0, 0.0, 0.5])], "goal array<double>, now array<double>")
    r = O.cap_relative_goal(df, "goal", "now", 2.0, 3).first()
    assert r.safe_goal == [2.0, -2.0, 1.0]
    assert r.clamped == [True, True, False]


def test_tick_round_trip(spark):
    cal = spark.createDataFrame(
        [("r", "shoulder_pan", 1, 0, -156, 1024, 3072), ("r", "gripper", 6, 1, 89, 1200, 2900)],
        "robot string, joint string, id int, drive_mode int, homing_offset int, range_min int, range_max int",
    )
    df = spark.createDataFrame([("r", "shoulder_pan", 868.0), ("r", "shoulder_pan", 2916.0), ("r", "gripper", 1289.0)],
                               "robot string, joint string, ticks double")
    normal = O.normalize_ticks(df, cal)
    assert [r.value for r in normal.collect()] == [-100.0, 100.0, 100.0]
    again = O.denormalize_ticks(normal.drop("ticks"), cal)
    assert [r.ticks for r in again.collect()] == [868.0, 2916.0, 1289.0]


def test_linear_interpolation_and_degrees(spark):
    df = spark.createDataFrame([([0.0, 10.0], [4.0, 20.0])], "a array<double>, b array<double>")
    assert df.select(V.lerp("a", "b", F.lit(0.25), 2)).first()[0] == [1.0, 12.5]
    half = df.select(V.to_degrees(F.array(F.lit(math.pi)), 1), V.to_radians(F.array(F.lit(180.0)), 1)).first()
    assert half[0] == [180.0] and half[1] == [math.pi]


def test_joint_names(spark):
    df = spark.createDataFrame([([float(i) for i in range(6)],)], "v array<double>")
    rows = O.name_joints(df, "v").collect()
    assert [(r.joint, r.value) for r in rows] == list(zip(JOINTS, map(float, range(6)), strict=True))


def test_closeness_follows_the_usual_tolerances(spark):
    df = spark.createDataFrame([([1.0], [1.00001]), ([1.0], [1.0001]), ([0.0], [1e-9]), ([None], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.all_close("a", "b", 1)).collect()] == [True, False, True, False]
