import pytest

from armature.operators import predicates as O
from armature.operators import quality as A
from armature.schema import STACK

POSES = "demo string, t long, object string, pos array<double>, lin_vel array<double>"


def scene(demo, **changes):
    """A finished stack; changes replace (xy offset, height, speed) of a layer."""
    rows = [(demo, 0, "plate", [1.0, 2.0, 0.5], [0.0, 0.0, 0.0])]
    for i, name in enumerate(STACK):
        x, z, v = changes.get(name, (0.0, 0.015 * (i + 1), 0.0))
        rows.append((demo, 0, name, [1.0 + x, 2.0, 0.5 + z], [v, 0.0, 0.0]))
    return rows


def done(spark, rows, **kw):
    return {r.demo: r.done for r in O.task_done(spark.createDataFrame(rows, POSES), **kw).collect()}


def test_every_limit_is_strict(spark):
    base = [("plate", 0)]
    assert base
    rows = (
        scene("good")
        + scene("far", patty=(0.0501, 0.045, 0.0))
        + scene("order", cheese_slice=(0.0, 0.015, 0.0))
        + scene("moving", bread_slice_2=(0.0, 0.06, 0.05))
        + scene("slow", bread_slice_2=(0.0, 0.06, 0.0499))
        + [r for r in scene("absent") if r[2] != "patty"]
    )
    assert done(spark, rows) == {"good": True, "far": False, "order": False, "moving": False, "slow": True, "absent": False}


def test_exact_boundaries_are_false(spark):
    plate = ("p", 0, "plate", [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])

    def stack(x=0.0, z=0.015, v=0.0):
        layers = [("p", 0, "bread_slice_1", [x, 0.0, z], [v, 0.0, 0.0])]
        layers += [("p", 0, n, [0.0, 0.0, 0.03 + 0.01 * i], [0.0, 0.0, 0.0]) for i, n in enumerate(STACK[1:])]
        return [plate, *layers]

    assert done(spark, stack())["p"]
    assert not done(spark, stack(x=0.05))["p"]
    assert not done(spark, stack(z=0.005))["p"]
    assert not done(spark, stack(z=0.03))["p"]
    assert not done(spark, stack(v=0.05))["p"]


def test_test_mode_is_always_done(spark):
    rows = scene("x", patty=(9.0, 0.0, 9.0))
    assert done(spark, rows, test_mode=True) == {"x": True}


def test_grasp(spark):
    frames = spark.createDataFrame(
        [("d", t, [0.0, 0.0, 0.0], g) for t, g in enumerate([0.3, 0.6, 0.3, 0.3, 0.3])],
        "demo string, t long, eef_pos array<double>, gripper double",
    )
    poses = spark.createDataFrame(
        [
            ("d", 0, "patty", [0.04, 0.0, 0.0]),
            ("d", 0, "bread_slice_1", [1.0, 0.0, 0.0]),
            ("d", 1, "patty", [0.04, 0.0, 0.0]),
            ("d", 2, "patty", [0.05, 0.0, 0.0]),
            ("d", 3, "plate", [0.0, 0.0, 0.0]),
        ],
        "demo string, t long, object string, pos array<double>",
    )
    got = {r.t: r.grasped for r in O.grasped(frames, poses).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


CHUNK = "run string, episode_index long, chunk long, step int, action array<double>"


@pytest.mark.parametrize(
    "rows, flags",
    [
        ([[0.001] * 6] * 3, {"near_zero", "static", "twitching"}),
        ([[1.0] * 5 + [9.0]] * 3, {"static", "twitching"}),
        ([[0.0] * 5 + [1.0], [3.2] * 5 + [1.0]], {"out_of_range"}),
        ([[0.005 * i] * 5 + [50.0] for i in range(16)], {"twitching"}),
        ([[0.5 * i] * 6 for i in range(4)], set()),
        ([[1.0] * 6], {"static"}),
    ],
)
def test_chunk_health(spark, rows, flags):
    df = spark.createDataFrame([("r", 0, 0, i, [float(v) for v in a]) for i, a in enumerate(rows)], CHUNK)
    report = A.diagnose_chunks(df).first()
    assert {f for f in ("near_zero", "static", "out_of_range", "twitching") if report[f]} == flags


def test_gripper_counts_only_for_near_zero(spark):
    df = spark.createDataFrame([("r", 0, 0, i, [0.0] * 5 + [50.0]) for i in range(3)], CHUNK)
    report = A.diagnose_chunks(df).first()
    assert not report.near_zero and report.static and not report.out_of_range


def test_empty_mask_gives_no_loss(spark):
    df = spark.createDataFrame([([1.0], [2.0], [False])], "p array<double>, y array<double>, m array<boolean>")
    assert A.masked_mse(df, "p", "y", "m", 1).first().loss is None
    some = spark.createDataFrame([([1.0, 5.0], [2.0, 0.0], [True, False])], "p array<double>, y array<double>, m array<boolean>")
    assert A.masked_mse(some, "p", "y", "m", 2).first().loss == 1.0


def test_instruction_effect_tells_chance_from_instruction(spark):
    rows = [
        ("s1", "bread", "bread"), ("s1", "cheese", "cheese"),
        ("s2", "bread", "bread"), ("s2", "cheese", "bread"),
        ("s3", "bread", "bread"), ("s3", "bread", "cheese"), ("s3", "cheese", "bread"),
    ]
    df = spark.createDataFrame(rows, "state string, instruction string, outcome string")
    got = {r.state: r.instruction_matters for r in A.instruction_effect(df, ["state"]).collect()}
    assert got == {"s1": True, "s2": False, "s3": False}


def test_histogram_of_constant_data(spark):
    df = spark.createDataFrame([([2.0, 1.0],), ([2.0, 3.0],), ([2.0, 3.0],)], "v array<double>")
    rows = A.histogram(df, "v", 2, bins=4).orderBy("dim", "bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 3, 0, 1, 0, 0, 2]
    assert rows[0].low == 1.5 and rows[4].low == 1.0
    by = A.histogram(df.selectExpr("'x' as side", "v"), "v", 2, bins=4, by=["side"])
    assert by.count() == 8


def test_training_alerts(spark):
    nan = float("nan")
    rows = [("r", 0, 2.0, 1.0), ("r", 500, 0.5, 0.5), ("r", 1000, 0.4, 0.6), ("r", 1500, nan, 0.7), ("r", 2000, 0.9, 0.7), ("r", 2500, 0.3, 0.6)]
    df = spark.createDataFrame(rows, "run string, step long, loss double, eval_loss double")
    for size in (700, 100_000):
        got = {r.step: r for r in A.training_alerts(df, size=size).collect()}
        assert [s for s in got if got[s].plateau] == [2000]
        assert [s for s in got if got[s].overfit] == [1000]
        assert [s for s in got if got[s].is_nan] == [1500]
        assert [s for s in got if got[s].too_high] == [0]
