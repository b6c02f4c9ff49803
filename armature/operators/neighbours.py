"""The k nearest source segments for each new scene.

A small pool is packed into one array per object and looked up: candidates are ranked
inside the scene's row, so no pairs are emitted. A larger pool is cut into tiles of
poses that are close in position and rotation, and tiles into a tree of `FAN` children a node. A node has a box of
positions and a cone of rotations (a quaternion and the largest angle to it), which bound the distance of all below.
A scene first goes down to the tile whose middle seems nearest, which bounds its k-th distance from above; it then
goes down level by level into just the nodes that are not farther than that. No segment
that could be among the k nearest is left out, and no row lists more than one node's children.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armature.functions import poses as P
from armature.functions import vectors as V
from armature.functions.draws import Draw, keyed
from armature.plans.blocks import position, rank_buckets
from armature.plans.lookups import HOT_KEYS, lookup_join, settled

PACKED = 2048
#: Segments of a tile, children of a node, and nodes of a level that are broadcast.
TILE, FAN, SMALL_LEVEL = 256, 64, 2000

#: Strategy -> (pose kept with a segment, pose of the scene it is compared with).
#: Nearest by object compares object poses. Nearest by robot distance compares where the
#: warped segment would start with where the robot is; seen from the object, both are rigid.
STRATEGIES: dict[str, tuple[Callable[[], Column], Callable[[], Column]] | None] = {
    "random": None,
    "nearest_neighbor_object": (lambda: F.col("object_pose"), lambda: F.col("object_pose")),
    "nearest_neighbor_robot_distance": (
        lambda: P.relative("object_pose", "first_eef_pose"),
        lambda: P.relative("object_pose", "robot_pose"),
    ),
}


def nearest_segments(
    scenes: DataFrame,
    segs: DataFrame,
    k: int = 3,
    strategy: str = "nearest_neighbor_object",
    on: str = "object_ref",
    scene_id: str = "scene",
    segment_id: str = "segment",
    pos_weight: float = 1.0,
    rot_weight: float = 1.0,
    packed: int = PACKED,
    tile: int = TILE,
    stats: list | None = None,
) -> DataFrame:
    """Rows (scene, object, segment, distance, rank 1..k); ties go to the smaller segment id.

    A pool above `packed` segments is searched by its tree; `stats` gets the pairs of scene and tile that were ranked.
    """
    if STRATEGIES.get(strategy) is None:
        raise ValueError(f"{strategy!r} does not rank segments")
    seg_pose, scene_pose = STRATEGIES[strategy]
    pool = settled(segs.select(on, F.col(segment_id).alias("_id"), seg_pose().alias("_pose")), "segments")
    asked = scenes.select(on, F.col(scene_id).alias("_scene"), scene_pose().alias("_at"))
    weights = (pos_weight, rot_weight)
    n = pool.limit(packed + 1).count()
    if n <= packed:
        members = pool.groupBy(on).agg(F.collect_list(F.struct("_pose", "_id")).alias("_members"))
        found = _rank(asked.join(F.broadcast(members), on), k, weights)
    else:
        levels = _tree(pool, on, max(tile, 4 * k), weights)
        found = _from_tree(settled(asked, "scenes"), levels, on, k, weights, stats)
    return found.select(
        F.col("_scene").alias(scene_id), on, F.col("_found._id").alias(segment_id), F.col("_found.distance"), "rank"
    )


def choose_segments(
    scenes: DataFrame,
    segs: DataFrame,
    k: int = 3,
    strategy: str = "random",
    on: str = "object_ref",
    scene_id: str = "scene",
    segment_id: str = "segment",
    seed: int = 42,
    draw: Draw | None = None,
    **kw,
) -> DataFrame:
    """One source segment per scene and object: one of the k nearest, or any for 'random'."""
    draw = draw or keyed(seed, scene_id, on)
    if strategy != "random":
        near = nearest_segments(scenes, segs, k, strategy, on, scene_id, segment_id, **kw)
        window = Window.partitionBy(scene_id, on)
        counted = near.withColumn("_k", F.count(F.lit(1)).over(window))
        pick = F.floor(draw("choice") * F.col("_k")) + 1
        return counted.filter(F.col("rank") == pick).select(scene_id, on, segment_id)
    # 48 bits that any engine can repeat, in 1,024 slices.
    code = F.conv(F.substring(F.md5(F.col(segment_id).cast("string")), 1, 12), 16, 10).cast("long")
    numbered = position(segs.select(on, segment_id), [on], [code, segment_id], F.shiftright(code, 38), "_number")
    numbered = settled(numbered, "numbered-segments")
    sizes = settled(numbered.groupBy(on).agg(F.count(F.lit(1)).alias("_n")), "segment-counts")
    asked = lookup_join(scenes.select(scene_id, on), sizes, [on], "inner")
    drawn = asked.withColumn("_number", F.floor(draw("choice") * F.col("_n")).cast("long"))
    return lookup_join(drawn, numbered, [on, "_number"], "inner").select(scene_id, on, segment_id)


def choose_per_trajectory(
    scenes: DataFrame, segs: DataFrame, first_object: str, on: str = "object_ref", scene_id: str = "scene", **kw
) -> DataFrame:
    """One source for a whole scene: chosen for its first subtask's object, used for all."""
    chosen = choose_segments(scenes.filter(F.col(on) == first_object), segs, on=on, scene_id=scene_id, **kw)
    return scenes.select(scene_id, on).join(chosen.drop(on), scene_id)


def _rank(df: DataFrame, k: int, weights: tuple[float, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """Top k members within a row."""
    measured = F.transform(
        "_members",
        lambda m: F.struct(P.pose_distance(m["_pose"], F.col("_at"), *weights).alias("distance"), m["_id"].alias("_id")),
    )
    best = F.slice(F.array_sort(measured), 1, k)
    on = [c for c in df.columns if c not in ("_scene", "_at", "_members", *keep)]
    ranked = df.select("_scene", *on, *keep, F.posexplode(best).alias("_rank", "_found"))
    return ranked.withColumn("rank", F.col("_rank") + 1).drop("_rank")


def _dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(1, 4)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def _turn(a: Column, b: Column) -> Column:
    """Angle between two unit quaternions."""
    return F.lit(2.0) * F.acos(F.least(F.lit(1.0), F.abs(_dot(a, b))))


def _is_unit(q: Column) -> Column:
    return F.abs(_dot(q, q) - 1.0) < 1e-6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cone(quats: Column, turns: Column) -> Column:
    """Mean quaternion of some, and the largest angle to them and what lies around each; half a turn if one is no unit."""

    def lane(i: int, first: Column) -> Column:
        return F.aggregate(quats, F.lit(0.0), lambda acc, q: acc + F.when(_dot(q, first) < 0, -F.get(q, F.lit(i))).otherwise(F.get(q, F.lit(i))))

    def around(mean: Column) -> Column:
        wide = F.array_max(F.zip_with(quats, turns, lambda q, t: F.when(_is_unit(q), _turn(q, mean) + t).otherwise(F.lit(math.pi))))
        return F.struct(mean.alias("_axis"), F.when(F.coalesce(_is_unit(mean), F.lit(False)), wide).otherwise(F.lit(math.pi)).alias("_wide"))

    def middle(first: Column) -> Column:
        def scaled(total: Column) -> Column:
            return _let(F.sqrt(_dot(total, total)), lambda n: F.when(n > 1e-9, F.transform(total, lambda v: v / n)).otherwise(first))

        return _let(F.array(*[lane(i, first) for i in range(4)]), scaled)

    return _let(_let(F.get(quats, F.lit(0)), middle), around)


def _tree(pool: DataFrame, on: str, tile: int, weights: tuple[float, float]) -> list[DataFrame]:
    """Tiles with their members, then for each level above the children of its nodes; the last level has node 0 alone."""
    pos = V.lanes("_pose", 3)
    quat = F.slice("_pose", 4, 4)
    side = F.when(F.get(quat, F.lit(0)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    turns = [side * F.get(quat, F.lit(i)) for i in range(1, 4)]
    # Places on a curve through six dimensions, in units of the distance.
    places = [F.lit(weights[0]) * x for x in pos] + [F.lit(2.0 * weights[1]) * x for x in turns]
    facts = pool.agg(F.count("*").alias("n"), *[F.min(x).alias(f"a{i}") for i, x in enumerate(places)], *[F.max(x).alias(f"b{i}") for i, x in enumerate(places)]).first()
    widest = max([facts[f"b{i}"] - facts[f"a{i}"] for i in range(6)] + [1e-12])
    cell = [F.floor((x - F.lit(facts[f"a{i}"])) / F.lit(widest) * 1023).cast("long") for i, x in enumerate(places)]
    code = F.lit(0).cast("long")
    for bit in range(10):
        for axis in range(6):
            code = code + F.shiftleft(F.shiftright(cell[axis], bit).bitwiseAND(F.lit(1)), 6 * bit + axis)
    coded = settled(pool.withColumn("_code", code), "segments")
    ranked = position(coded, [on], ["_code", "_id"], rank_buckets(coded, F.col("_code")), "_place")
    low, high = ([f(x) for x in V.lanes(c, 3)] for f, c in ((F.min, "_low"), (F.max, "_high")))
    node = F.floor(F.col("_place") / tile).cast("long").alias("_node")
    tiles = ranked.groupBy(on, node).agg(
        F.collect_list(F.struct("_pose", "_id")).alias("_members"), F.array(*[F.min(x) for x in pos]).alias("_low"), F.array(*[F.max(x) for x in pos]).alias("_high")
    )
    quats = F.transform("_members", lambda m: F.slice(m["_pose"], 4, 4))
    tiles = tiles.withColumn("_cone", _cone(quats, F.transform("_members", lambda m: F.lit(0.0))))
    levels = [settled(tiles.select(on, "_node", "_members", "_low", "_high", "_cone.*"), "tiles")]
    below, nodes = levels[0].drop("_members"), -(-facts["n"] // tile)
    while True:
        above = below.groupBy(on, F.floor(F.col("_node") / FAN).cast("long").alias("_node")).agg(
            F.collect_list(F.struct("_node", "_low", "_high", "_axis", "_wide")).alias("_children"), F.array(*low).alias("_low"), F.array(*high).alias("_high")
        )
        above = above.withColumn("_cone", _cone(F.col("_children._axis"), F.col("_children._wide")))
        levels.append(settled(above.select(on, "_node", "_children", "_low", "_high", "_cone.*"), "tile-nodes"))
        below, nodes = levels[-1].drop("_children"), -(-nodes // FAN)
        if nodes <= 1:
            return levels


def _from_tree(asked: DataFrame, levels: list[DataFrame], on: str, k: int, weights: tuple[float, float], stats: list | None) -> DataFrame:
    at, quat = V.lanes("_at", 3), F.slice("_at", 4, 4)

    def least(child: Column) -> Column:
        """No pose below the child is nearer; some slack for rounding."""
        gaps = [F.greatest(F.lit(0.0), F.get(child["_low"], F.lit(i)) - x, x - F.get(child["_high"], F.lit(i))) for i, x in enumerate(at)]
        turn = F.when(F.col("_unit"), F.greatest(F.lit(0.0), _turn(quat, child["_axis"]) - child["_wide"] - F.lit(1e-6))).otherwise(F.lit(0.0))
        return (F.lit(weights[0]) * V.norm(gaps) + F.lit(weights[1]) * turn) * F.lit(1 - 1e-9)

    def middle(child: Column) -> Column:
        """Distance to the middle of the box and of the cone: where to look first."""
        gaps = [(F.get(child["_low"], F.lit(i)) + F.get(child["_high"], F.lit(i))) / 2 - x for i, x in enumerate(at)]
        return F.lit(weights[0]) * V.norm(gaps) + F.lit(weights[1]) * F.when(F.col("_unit"), _turn(quat, child["_axis"])).otherwise(F.lit(0.0))

    def down(rows: DataFrame, level: DataFrame) -> DataFrame:
        lists = level.select(on, "_node", "_children")
        joined = lookup_join(rows, lists, [on, "_node"], "inner", spread=["_scene"], rows=SMALL_LEVEL)
        bounds = F.transform("_children", lambda c: F.struct(middle(c).alias("m"), c["_node"].alias("_node"), least(c).alias("d")))
        return joined.withColumn("_near", bounds).drop("_children", "_node")

    members = levels[0].select(on, F.col("_node").alias("_tile"), F.inline("_members"))
    asked = asked.withColumn("_unit", F.coalesce(_is_unit(quat), F.lit(False)))
    nearest = asked.withColumn("_node", F.lit(0).cast("long"))
    for level in reversed(levels[1:]):
        nearest = settled(down(nearest, level).withColumn("_node", F.array_min("_near")["_node"]).drop("_near"), "nearest-nodes")
    window = Window.partitionBy("_scene", on).orderBy("_found")

    def ranked(visits: DataFrame) -> DataFrame:
        near = _near_members(visits.select("_scene", on, "_at", F.col("_node").alias("_tile"), "_reach"), members, on, k, weights)
        found = F.struct(P.pose_distance("_pose", "_at", *weights).alias("distance"), "_id").alias("_found")
        return near.select("_scene", on, found).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)

    first = ranked(nearest.withColumn("_reach", F.lit(None).cast("double")))
    reached = first.groupBy("_scene", on).agg(F.max(F.when(F.col("rank") == k, F.col("_found.distance"))).alias("_reach"))
    visits = asked.join(reached, ["_scene", on], "left").withColumn("_node", F.lit(0).cast("long"))
    for level in reversed(levels[1:]):
        inside = F.filter("_near", lambda t: F.col("_reach").isNull() | (t["d"] <= F.col("_reach")))
        visits = settled(down(visits, level).withColumn("_hit", F.explode(inside)).withColumn("_node", F.col("_hit._node")).drop("_near", "_hit"), "visited-nodes")
    if stats is not None:
        stats.append(visits.count())
    return ranked(visits)


#: Visits of a tile that a task ranks; scenes that meet a tile at once.
VISITS, AT_ONCE = 100_000, 1024


def _poses(column: pa.ChunkedArray) -> np.ndarray:
    """Poses as rows of seven numbers, NaN where one is missing."""
    array = column.combine_chunks()
    if array.null_count == 0 and pc.all(pc.equal(pc.list_value_length(array), 7)).as_py():
        return array.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 7)
    rows = [list(p or [])[:7] for p in array.to_pylist()]
    return np.array([[*p, *[None] * (7 - len(p))] for p in rows], dtype=float).reshape(-1, 7)


def nearest_of(at: np.ndarray, reach: np.ndarray, poses: np.ndarray, k: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of scene and member that may be among the k nearest of the members and within reach, with some slack for rounding.

    What can't be measured here always may.
    """
    gap = np.sqrt(sum((at[:, None, i] - poses[None, :, i]) ** 2 for i in range(3)))
    turn = 2.0 * np.arccos(np.fmin(1.0, np.abs(at[:, 3:] @ poses[:, 3:].T)))
    distance = weights[0] * gap + weights[1] * turn
    odd = ~np.isfinite(distance)
    distance[odd] = np.inf
    most = np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(at), np.inf)
    most = np.fmin(most, reach)
    return np.nonzero((distance <= (most + 1e-6 * abs(weights[1]) + 1e-9 * (1 + np.abs(most)))[:, None]) | odd)


def _near_members(visits: DataFrame, members: DataFrame, on: str, k: int, weights: tuple[float, float]) -> DataFrame:
    """Rows (scene, object, its pose, pose and id of a member) of the members of visited tiles that may be among the k nearest.

    A tile meets its scenes in one place, so neither is repeated for the other; one with very many visits is copied to several tasks.
    """
    share = max(VISITS, visits.count() // HOT_KEYS)
    owned = visits.groupBy(on, "_tile").agg(F.count(F.lit(1)).alias("_owned")).filter(F.col("_owned") > share)
    hot = settled(owned.select(on, "_tile", F.ceil(F.col("_owned") / share).cast("int").alias("_copies")), "hot-tiles")
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    key = [on, "_tile", "_salt"]
    asking = visits.join(F.broadcast(hot), [on, "_tile"], "left").withColumn("_salt", F.pmod(F.xxhash64("_scene", "_at"), copies).cast("int"))
    held = members.join(F.broadcast(hot), [on, "_tile"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    both = asking.withColumn("_asks", F.lit(True)).drop("_copies").unionByName(held.withColumn("_asks", F.lit(False)).drop("_copies"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, poses = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(*[table[c].to_pylist() for c in [*key, "_asks"]], strict=True))
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = table.slice(a, b - a)
                if names[a][:3] != now:
                    now, some, poses = names[a][:3], [], None
                if not names[a][3]:
                    some.append(part.select(["_pose", "_id"]))
                    continue
                if not some:
                    continue
                if poses is None:
                    some = [pa.concat_tables(some).combine_chunks()]
                    poses = _poses(some[0]["_pose"])
                for first in range(0, len(part), AT_ONCE):
                    asks = part.slice(first, AT_ONCE)
                    reach = asks["_reach"].to_numpy()
                    who, which = nearest_of(_poses(asks["_at"]), np.where(np.isnan(reach.astype(float)), np.inf, reach), poses, k, weights)
                    left, right = asks.select(["_scene", on, "_at"]).take(pa.array(who)), some[0].take(pa.array(which))
                    found = pa.Table.from_arrays([*left.columns, *right.columns], names=[*left.column_names, *right.column_names])
                    yield from found.combine_chunks().to_batches()

    rows = both.filter(F.col(on).isNotNull()).repartition(*key).sortWithinPartitions(*key, "_asks")
    schema = T.StructType([rows.schema[c] for c in ("_scene", on, "_at", "_pose", "_id")])
    return rows.mapInArrow(run, schema)
