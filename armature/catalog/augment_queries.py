"""Poses, source selection, warping, stitching, noise and generation accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import md5_draw, query, r6, spread, sql_draw, sql_r6
from armature.functions import poses as P
from armature.operators import augment as G
from armature.operators import episodes as W
from armature.operators import frames as R
from armature.operators import neighbours as N
from armature.plans.lookups import settled

STEPS = (
    W.Subtask("bread_slice_1", "grasp", (10, 20), "nearest_neighbor_object", 3, 0.002, 8, 0),
    W.Subtask("plate", None, (0, 0), "nearest_neighbor_object", 3, 0.002, 5, 2),
)


def _e(i: int) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


def _pose_sql(name: str, pos: int, quat: int) -> str:
    length = "sqrt(" + " + ".join(f"{_e(i)} * {_e(i)}" for i in range(quat, quat + 4)) + ")"
    places = [f"{_e(pos + i)} AS {name}{i}" for i in range(3)]
    turns = [f"{_e(quat + i)} / {length} AS {name}{i + 3}" for i in range(4)]
    return ", ".join(places + turns)


POSES = f"""
po AS (SELECT vec_id, label, vec_id % 20 AS demo, vec_id // 20 AS t, {_pose_sql("e", 1, 7)}, {_pose_sql("o", 4, 13)},
  abs({_e(17)}) * 4.0::DOUBLE AS gripper FROM embeddings)"""


def sql_conjugate(q: str) -> list[str]:
    return [f"{q}3", f"-{q}4", f"-{q}5", f"-{q}6"]


def sql_product(a: list[str], b: list[str]) -> list[str]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [
        f"({aw})*({bw}) - ({ax})*({bx}) - ({ay})*({by}) - ({az})*({bz})",
        f"({aw})*({bx}) + ({ax})*({bw}) + ({ay})*({bz}) - ({az})*({by})",
        f"({aw})*({by}) - ({ax})*({bz}) + ({ay})*({bw}) + ({az})*({bx})",
        f"({aw})*({bz}) + ({ax})*({by}) - ({ay})*({bx}) + ({az})*({bw})",
    ]


def _sql_cross(a: list[str], b: list[str]) -> list[str]:
    return [
        f"({a[1]})*({b[2]}) - ({a[2]})*({b[1]})",
        f"({a[2]})*({b[0]}) - ({a[0]})*({b[2]})",
        f"({a[0]})*({b[1]}) - ({a[1]})*({b[0]})",
    ]


def sql_rotate(q: list[str], v: list[str], name: str) -> str:
    """Aliases {name}0..2 of the rotated vector, by way of {name}i and {name}c (reused in the same SELECT)."""
    w, *u = q
    inner = _sql_cross(u, v)
    outer = _sql_cross(u, [f"{name}i{i}" for i in range(3)])
    out = [f"{x} AS {name}i{i}" for i, x in enumerate(inner)]
    out += [f"({v[i]}) + 2.0::DOUBLE * (({w}) * {name}i{i} + ({outer[i]})) AS {name}{i}" for i in range(3)]
    return ", ".join(out)


def sql_relative(base: str, target: str, name: str) -> str:
    """Aliases {name}0..6 of the target pose in the base frame."""
    back = sql_conjugate(base)
    offset = [f"{target}{i} - {base}{i}" for i in range(3)]
    turn = sql_product(back, [f"{target}{i}" for i in range(3, 7)])
    return sql_rotate(back, offset, name) + ", " + ", ".join(f"{x} AS {name}{i + 3}" for i, x in enumerate(turn))


def sql_compose(a: str, b: str, name: str) -> str:
    turn = sql_product([f"{a}{i}" for i in range(3, 7)], [f"{b}{i}" for i in range(3, 7)])
    moved = sql_rotate([f"{a}{i}" for i in range(3, 7)], [f"{b}{i}" for i in range(3)], f"{name}_v")
    return (
        moved
        + ", "
        + ", ".join(f"{a}{i} + {name}_v{i} AS {name}{i}" for i in range(3))
        + ", "
        + ", ".join(f"{x} AS {name}{i + 3}" for i, x in enumerate(turn))
    )


def _seven(name: str, out: str = "p") -> str:
    return ", ".join(sql_r6(f"{name}{i}", f"{out}{i}") for i in range(7))


@query("relative_pose", f"WITH {POSES}, r AS (SELECT vec_id, {sql_relative('o', 'e', 'z')} FROM po) SELECT vec_id, {_seven('z')} FROM r")
def relative_pose(fx):
    """Effector pose in the frame of the object."""
    seen = R.in_base_frame(fx.poses(), "object_pose", "eef_pose")
    return seen.select("vec_id", *spread("ee_frame_state", "p", 7))


@query(
    "compose_matrices",
    f"WITH {POSES}, r AS (SELECT vec_id, {sql_compose('o', 'e', 'z')} FROM po) SELECT vec_id, "
    + ", ".join(sql_r6(f"z{i}", f"p{i}") for i in range(3))
    + ", "
    + ", ".join(sql_r6(f"CASE WHEN z3 < 0 THEN -z{i} ELSE z{i} END", f"p{i}") for i in range(3, 7))
    + f", {sql_r6('0.0', 'error')} FROM r",
)
def compose_matrices(fx):
    """Poses multiplied as 4x4 matrices; matrix times inverse is the identity."""
    m = fx.poses().select("vec_id", P.to_matrix("object_pose").alias("a"), P.to_matrix("eef_pose").alias("b"))
    product = m.withColumn("c", P.matrix_product("a", "b")).withColumn("back", P.matrix_inverse("c"))
    whole = product.withColumn("one", P.matrix_product("c", "back")).withColumn("pose", P.from_matrix("c"))
    identity = [1.0 if r == c else 0.0 for r in range(4) for c in range(4)]
    error = F.greatest(*[F.abs(F.get("one", F.lit(i)) - v) for i, v in enumerate(identity)])
    return whole.select("vec_id", *spread("pose", "p", 7), r6(F.round(error, 9)).alias("error"))


def _distance_sql(a: str, b: str) -> str:
    d = " + ".join(f"({a}{i} - {b}{i}) * ({a}{i} - {b}{i})" for i in range(3))
    q = " + ".join(f"{a}{i} * {b}{i}" for i in range(3, 7))
    return f"(sqrt({d}) + 2.0::DOUBLE * acos(least(1.0::DOUBLE, abs({q}))))"


@query(
    "nearest_segments",
    f"""WITH {POSES}, d AS (SELECT s.vec_id AS scene, CAST(s.label AS VARCHAR) AS object_ref, g.vec_id AS segment,
      {_distance_sql("s.e", "g.o")} AS distance FROM po s JOIN po g USING (label)),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY distance, segment) AS rank FROM d)
    SELECT scene, object_ref, segment, {sql_r6("distance", "distance")}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def nearest_segments(fx):
    """Five nearest object poses of the same label for every effector pose."""
    scenes, segs = _pools(fx)
    return N.nearest_segments(scenes, segs, 5).withColumn("distance", r6("distance"))


@query(
    "nearest_segments_tiled",
    f"""WITH {POSES}, d AS (SELECT s.vec_id AS scene, CAST(s.label AS VARCHAR) AS object_ref, g.vec_id AS segment,
      {_distance_sql("s.e", "g.o")} AS distance FROM po s JOIN po g USING (label)),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY distance, segment) AS rank FROM d)
    SELECT scene, object_ref, segment, {sql_r6("distance", "distance")}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def nearest_segments_tiled(fx):
    """The plan for large pools, forced by tiles of about the square root of the pool."""
    scenes, segs = _pools(fx)
    return N.nearest_segments(scenes, segs, 5, packed=8).withColumn("distance", r6("distance"))


def _pools(fx):
    poses = fx.poses().withColumn("object_ref", F.col("label").cast("string"))
    scenes = poses.select(F.col("vec_id").alias("scene"), "object_ref", F.col("eef_pose").alias("object_pose"))
    return scenes, poses.select(F.col("vec_id").alias("segment"), "object_ref", "object_pose")


@query(
    "nearest_by_robot_distance",
    f"""WITH {POSES}, g AS (SELECT vec_id AS segment, label, {sql_relative("o", "e", "r")} FROM po),
    s AS (SELECT vec_id AS scene, label, {sql_relative("e", "o", "q")} FROM po),
    d AS (SELECT scene, CAST(label AS VARCHAR) AS object_ref, segment, {_distance_sql("r", "q")} AS distance FROM s JOIN g USING (label)),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY distance, segment) AS rank FROM d)
    SELECT scene, object_ref, segment, {sql_r6("distance", "distance")}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
)
def nearest_by_robot_distance(fx):
    """Segments whose warped start is nearest to the robot."""
    poses = fx.poses().withColumn("object_ref", F.col("label").cast("string"))
    scenes = poses.select(
        F.col("vec_id").alias("scene"),
        "object_ref",
        F.col("eef_pose").alias("object_pose"),
        F.col("object_pose").alias("robot_pose"),
    )
    segs = poses.select(
        F.col("vec_id").alias("segment"), "object_ref", "object_pose", F.col("eef_pose").alias("first_eef_pose")
    )
    near = N.nearest_segments(scenes, segs, 3, "nearest_neighbor_robot_distance")
    return near.withColumn("distance", r6("distance"))


# ---- the whole chain: annotate, choose, warp, stitch, add noise ----

_PLATE = _pose_sql("l", 20, 23)
CHAIN = f"""
po AS MATERIALIZED (SELECT vec_id, vec_id % 20 AS demo, vec_id // 20 AS t, {_pose_sql("e", 1, 7)}, {_pose_sql("o", 4, 13)}, {_PLATE},
  abs({_e(17)}) * 4.0::DOUBLE AS gripper FROM embeddings),
b AS (SELECT demo, min(t) FILTER (gripper < 0.6) AS boundary, max(t) + 1 AS length FROM po GROUP BY demo),
o AS (SELECT *, greatest(0, least(length, boundary + CAST(floor({sql_draw(42, "offset/0", "demo")} * 4) AS BIGINT))) AS cut FROM b WHERE boundary IS NOT NULL),
sg AS (SELECT demo, 0 AS subtask, 0::BIGINT AS start, cut AS end_ FROM o UNION ALL SELECT demo, 1, cut, length FROM o),
st AS (SELECT sg.demo, subtask, start, end_, {", ".join(f"CASE WHEN subtask = 0 THEN o{i} ELSE l{i} END AS w{i}" for i in range(7))}
  FROM sg JOIN po ON po.demo = sg.demo AND po.t = sg.start WHERE end_ > start),
pool AS (SELECT st.*, po.t - start AS step, {", ".join(f"e{i}" for i in range(7))}, gripper FROM st JOIN po ON po.demo = st.demo AND po.t >= start AND po.t < end_),
ba AS (SELECT demo, 0 AS subtask, {", ".join(f"o{i} AS n{i}" for i in range(7))} FROM po WHERE t = 0
       UNION ALL SELECT demo, 1, {", ".join(f"l{i}" for i in range(7))} FROM po WHERE t = 0),
cp AS (SELECT *, CAST(unnest(range(3)) AS INTEGER) AS copy FROM ba),
sc AS (SELECT demo || '/' || copy AS scene, subtask,
  n0 + (-0.02::DOUBLE + {sql_draw(7, "x", "demo", "subtask", "copy")} * 0.04::DOUBLE) AS n0,
  n1 + (-0.02::DOUBLE + {sql_draw(7, "y", "demo", "subtask", "copy")} * 0.04::DOUBLE) AS n1, n2, n3, n4, n5, n6 FROM cp),
di AS (SELECT scene, sc.subtask, {", ".join(f"n{i}" for i in range(7))}, st.demo, {_distance_sql("sc.n", "st.w")} AS distance FROM sc JOIN st ON sc.subtask = st.subtask),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene, subtask ORDER BY distance, demo) AS rank FROM di),
ch AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY scene, subtask) AS k FROM rk WHERE rank <= 3)
       WHERE rank = floor({sql_draw(9, "choice", "scene", "subtask")} * k) + 1),
re AS (SELECT ch.scene, ch.subtask, pool.step, pool.gripper, {", ".join(f"n{i}" for i in range(7))}, {sql_relative("w", "e", "z")}
       FROM ch JOIN pool ON pool.demo = ch.demo AND pool.subtask = ch.subtask),
wa AS MATERIALIZED (SELECT scene, subtask, step, gripper, {sql_compose("n", "z", "y")} FROM re)"""


def _tables(fx):
    """Frames, object poses and segments of the demos."""
    rows = fx.poses().withColumn("demo", F.col("demo_number"))
    frames = rows.select("demo", "t", F.col("eef_pose").alias("target_eef_pose"), "gripper")
    objects = rows.select(
        "demo",
        "t",
        F.inline(
            F.array(
                F.struct(F.lit("bread_slice_1").alias("object"), F.col("object_pose").alias("pose")),
                F.struct(F.lit("plate").alias("object"), F.col("plate_pose").alias("pose")),
            )
        ),
    )
    bounds = W.boundaries(frames.withColumn("grasp", F.col("gripper") < 0.6), ["grasp"], ["demo"], "t")
    steps = (W.Subtask("bread_slice_1", "grasp", (0, 3)), W.Subtask("plate"))
    segs = W.segments(bounds, steps, keys=["demo"], draw=md5_draw(42, "demo"))
    return frames, objects, segs


def _scenes_and_pool(fx):
    frames, objects, segs = _tables(fx)
    pool = settled(G.segment_pool(frames, objects, segs), "segment-pool")
    names = F.create_map(F.lit("bread_slice_1"), F.lit(0), F.lit("plate"), F.lit(1))
    base = objects.filter("t = 0").select(
        "demo", F.try_element_at(names, F.col("object")).alias("subtask"), F.col("object").alias("object_ref"),
        F.col("pose").alias("object_pose"),
    )
    scenes = G.new_scenes(base, 3, draw=md5_draw(7, "demo", "subtask", "copy")).withColumn(
        "scene", F.concat_ws("/", F.col("demo").cast("string"), F.col("copy").cast("string"))
    )
    return settled(scenes, "scenes"), pool


def _warped(fx):
    scenes, pool = _scenes_and_pool(fx)
    starts = pool.filter("step = 0").select("object_ref", F.col("demo").alias("segment"), "object_pose")
    chosen = N.choose_segments(
        scenes, starts, 3, "nearest_neighbor_object", draw=_choice_draw(), scene_id="scene", segment_id="segment"
    )
    picked = scenes.select("scene", "object_ref", "subtask", F.col("object_pose").alias("new_object_pose")).join(
        chosen.withColumnRenamed("segment", "demo"), ["scene", "object_ref"]
    )
    return G.warp(picked.drop("object_ref"), pool.drop("object_ref"), poses=["target_eef_pose"])


def _choice_draw():
    subtask = F.when(F.col("object_ref") == "plate", "1").otherwise("0")

    def draw(tag):
        text = F.concat_ws("/", F.lit("9"), F.lit(tag), F.col("scene"), subtask)
        bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
        return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))

    return draw


@query("warp", f"WITH {CHAIN} SELECT scene, subtask, step, {sql_r6('gripper', 'gripper')}, {_seven('y')} FROM wa")
def warp(fx):
    """Segments chosen among the three nearest and moved along with their objects."""
    return _warped(fx).select(
        "scene", "subtask", "step", r6("gripper").alias("gripper"), *spread("target_eef_pose", "p", 7)
    )


_STITCH = f"""{CHAIN},
en AS (SELECT scene, subtask, max(step) + 1 AS steps, {", ".join(f"arg_min(y{i}, step) AS f{i}, arg_max(y{i}, step) AS t{i}" for i in range(7))},
  arg_min(gripper, step) AS fg FROM wa GROUP BY scene, subtask),
pl AS (SELECT *, {", ".join(f"lag(t{i}) OVER w AS q{i}" for i in range(7))}, CASE WHEN lag(t0) OVER w IS NULL THEN 0 WHEN subtask = 0 THEN 8 ELSE 5 END AS bridge,
  CASE WHEN subtask = 0 THEN 0 ELSE 2 END AS pause FROM en WINDOW w AS (PARTITION BY scene ORDER BY subtask)),
of AS (SELECT *, coalesce(sum(bridge + pause + steps) OVER (PARTITION BY scene ORDER BY subtask ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pl),
br AS (SELECT *, unnest(range(1, bridge + pause + 1)) AS i FROM of WHERE bridge + pause > 0),
bs AS (SELECT *, least(1.0::DOUBLE, i / (bridge + 1.0::DOUBLE)) AS share, CASE WHEN {" + ".join(f"q{i} * f{i}" for i in range(3, 7))} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sgn FROM br),
bm AS (SELECT *, {", ".join(f"q{i} + (f{i} - q{i}) * share AS m{i}" for i in range(3))}, {", ".join(f"q{i} + (f{i} * sgn - q{i}) * share AS m{i}" for i in range(3, 7))} FROM bs),
tr AS (SELECT wa.scene, wa.subtask, CAST(off + bridge + pause + step AS BIGINT) AS t, 'segment' AS part, gripper, {", ".join(f"y{i} AS g{i}" for i in range(7))}
  FROM wa JOIN of USING (scene, subtask)
  UNION ALL
  SELECT scene, subtask, CAST(off + i - 1 AS BIGINT), CASE WHEN i <= bridge THEN 'interpolation' ELSE 'fixed' END, fg,
  {", ".join(f"CASE WHEN i <= bridge THEN m{i} ELSE f{i} END" for i in range(3))},
  {", ".join(f"CASE WHEN i <= bridge THEN m{i} / sqrt(m3*m3 + m4*m4 + m5*m5 + m6*m6) ELSE f{i} END" for i in range(3, 7))} FROM bm)"""


@query(
    "stitch",
    f"WITH {_STITCH} SELECT scene, subtask, t, part, {sql_r6('gripper', 'gripper')}, {_seven('g')} FROM tr",
)
def stitch(fx):
    """Whole generated trajectories: transitions, pauses and warped segments on one timeline."""
    return G.stitch(_warped(fx), STEPS).select(
        "scene", "subtask", "t", "part", r6("gripper").alias("gripper"), *spread("target_eef_pose", "p", 7)
    )


def _noise_sql(i: int) -> str:
    radius = f"sqrt(-2.0::DOUBLE * ln({sql_draw(42, f'noise/{i}/radius', 'scene', 't')}))"
    return f"g{i} + CASE WHEN part = 'segment' THEN 0.002::DOUBLE * ({radius} * cos(2.0::DOUBLE * pi() * {sql_draw(42, f'noise/{i}/angle', 'scene', 't')})) ELSE 0.0::DOUBLE END"


@query(
    "action_noise",
    f"WITH {_STITCH} SELECT scene, t, part, "
    + ", ".join(sql_r6(_noise_sql(i), f"p{i}") for i in range(3))
    + ", "
    + ", ".join(sql_r6(f"g{i}", f"p{i}") for i in range(3, 7))
    + " FROM tr",
)
def action_noise(fx):
    noisy = G.add_action_noise(G.stitch(_warped(fx), STEPS), 0.002, draw=md5_draw(42, "scene", "t"))
    return noisy.select("scene", "t", "part", *spread("target_eef_pose", "p", 7))


@query(
    "segment_pool",
    f"""WITH {CHAIN} SELECT demo, subtask, step, CASE WHEN subtask = 0 THEN 'bread_slice_1' ELSE 'plate' END AS object_ref,
    {_seven("e")}, {_seven("w", "o")} FROM pool""",
)
def segment_pool(fx):
    frames, objects, segs = _tables(fx)
    pool = G.segment_pool(frames, objects, segs)
    return pool.select(
        "demo", "subtask", "step", "object_ref", *spread("target_eef_pose", "p", 7), *spread("object_pose", "o", 7)
    )


@query("new_scenes", f"WITH {CHAIN} SELECT scene, subtask, {_seven('n')} FROM sc")
def new_scenes(fx):
    _, objects, _ = _tables(fx)
    names = F.create_map(F.lit("bread_slice_1"), F.lit(0), F.lit("plate"), F.lit(1))
    base = objects.filter("t = 0").select(
        "demo", F.try_element_at(names, F.col("object")).alias("subtask"), F.col("pose").alias("object_pose")
    )
    scenes = G.new_scenes(base, 3, draw=md5_draw(7, "demo", "subtask", "copy"))
    scene = F.concat_ws("/", F.col("demo").cast("string"), F.col("copy").cast("string"))
    return scenes.select(scene.alias("scene"), "subtask", *spread("object_pose", "p", 7))


@query(
    "one_source_per_scene",
    f"""WITH {CHAIN}, f AS (SELECT scene, demo FROM ch WHERE subtask = 0)
    SELECT f.scene, CASE WHEN sc.subtask = 0 THEN 'bread_slice_1' ELSE 'plate' END AS object_ref, f.demo FROM sc JOIN f USING (scene)""",
)
def one_source_per_scene(fx):
    """The source chosen for the first subtask serves the whole trajectory."""
    scenes, pool = _scenes_and_pool(fx)
    starts = pool.filter("step = 0").select("object_ref", F.col("demo").alias("segment"), "object_pose")
    chosen = N.choose_per_trajectory(
        scenes, starts, "bread_slice_1", k=3, strategy="nearest_neighbor_object", draw=_choice_draw()
    )
    return chosen.withColumnRenamed("segment", "demo")


@query(
    "random_sources",
    f"""WITH {POSES}, g AS (SELECT label, vec_id AS segment, count(*) OVER (PARTITION BY label) AS n,
      row_number() OVER (PARTITION BY label ORDER BY CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 12)) AS BIGINT), vec_id) - 1 AS number FROM po),
    d AS (SELECT scene, object_ref, label, {sql_draw(42, "choice", "scene", "object_ref")} AS u FROM (SELECT vec_id AS scene, label, CAST(label AS VARCHAR) AS object_ref FROM po))
    SELECT scene, object_ref, segment FROM d JOIN g ON g.label = d.label AND g.number = CAST(floor(u * n) AS BIGINT)""",
)
def random_sources(fx):
    """One uniformly drawn source per scene and object."""
    scenes, segs = _pools(fx)
    return N.choose_segments(scenes, segs, strategy="random", draw=md5_draw(42, "scene", "object_ref"))


ATTEMPTS = """
at_ AS (SELECT l_suppkey AS run, l_orderkey * 8 + l_linenumber AS k, l_quantity > 20 AS success, l_partkey FROM lineitem),
ra AS (SELECT run, success, row_number() OVER (PARTITION BY run ORDER BY k, l_partkey, success) - 1 AS attempt FROM at_),
co AS (SELECT *, coalesce(sum(CAST(success AS INTEGER)) OVER w, 0) AS won, coalesce(sum(CAST(NOT success AS INTEGER)) OVER w, 0) AS lost
  FROM ra WINDOW w AS (PARTITION BY run ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _attempts(fx):
    from armature.plans.blocks import position, rank_buckets

    rows = fx.table("lineitem").select(
        F.col("l_suppkey").alias("run"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_k"),
        (F.col("l_quantity") > 20).alias("success"),
        "l_partkey",
    )
    return position(rows, ["run"], ["_k", "l_partkey", "success"], rank_buckets(rows, F.col("_k")), "attempt").select("run", "attempt", "success")


@query("accept", f"WITH {ATTEMPTS} SELECT run, attempt, success FROM co WHERE won < 20 AND lost < 50")
def accept(fx):
    return G.accept(_attempts(fx))


@query(
    "acceptance_report",
    f"""WITH {ATTEMPTS} SELECT run, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures
    FROM co WHERE won < 20 AND lost < 50 GROUP BY run""",
)
def acceptance_report(fx):
    return G.acceptance_report(G.accept(_attempts(fx), size=64))


@query(
    "lineage",
    f"""WITH {Q.DEMOS}, s AS (SELECT success, 0 AS subtask, src0 AS source_demo FROM dm WHERE mimic_generated
      UNION ALL SELECT success, 1, src1 FROM dm WHERE mimic_generated)
    SELECT subtask, source_demo, count(*) AS generated, count(*) FILTER (coalesce(success, false)) AS successes FROM s GROUP BY ALL""",
)
def lineage(fx):
    return G.lineage(fx.demos())


@query(
    "augmentation_report",
    f"""WITH {Q.DEMOS} SELECT dataset, count(*) FILTER (NOT mimic_generated) AS source_demos, count(*) FILTER (mimic_generated) AS generated_demos,
    {sql_r6("count(*) / count(*) FILTER (NOT mimic_generated)", "factor")}, count(*) AS total, count(*) FILTER (coalesce(success, false)) AS successes,
    {sql_r6("100.0::DOUBLE * count(*) FILTER (coalesce(success, false)) / count(*)", "success_percent")},
    {sql_r6("avg(num_samples)", "mean_length")}, min(num_samples) AS min_length, max(num_samples) AS max_length FROM dm GROUP BY dataset""",
)
def augmentation_report(fx):
    report = G.augmentation_report(fx.demos())
    return report.withColumns({c: r6(c) for c in ("factor", "success_percent", "mean_length")})
