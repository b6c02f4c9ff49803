"""Hard negatives from lists shared by clusters of anchors.

Vectors are integers. Anchors are clustered by direction. For a cluster with centre c and largest angle t between c and a
member, |x| cos(max(0, angle(x, c) - t)) times the length of a member is at least the inner product of x with that
member. So candidates sorted by this bound once serve all members: each walks the list from its
head and stops, certified, where the bound falls below the least score it can still use.

Candidates lie in blocks of up to `BLOCK` different vectors of one label and near one pivot (files in the shared folder), so a list is cut
into stretches by block, and a block's own angle and length bound all of it. Clusters hold up to `MEMBERS` anchors of
one label. There are two walks, each in two passes: first every cluster takes its best block, which
gives thresholds, then all blocks whose bound reaches the least threshold of a member.
The first walk finds an anchor's positives, its best rows of the same label. In the second walk a
row of another label is useful for a positive of score p if its score is between RATIO * p and p; an anchor keeps the
best rows for each different p.

Scores are exact integers; bounds have some slack for rounding. Equal vectors of one label are one entry with its smallest ids.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or a non-finite component, take no
part; of rows with one id the least (label, vector) does; vectors of another length don't meet; ties go to the smaller id;
positives of negative score have no negatives. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.llm.blobs import fetch, store
from armature.llm.mtree import scaled, usable
from armature.plans.lookups import settled
from armature.session import new_dir

#: Different vectors of a block, anchors of a cluster, pivots that deal candidates, centres that deal anchors.
BLOCK = 4096
MEMBERS = 1024
PIVOTS = 256
CENTRES = 256
#: Entries of a list scored at once.
STRIDE = 512
#: Directions drawn to choose pivots and centres from.
SAMPLE = 20_000
LEAST, MOST = 80, 100
#: No floor, and no limit, of a score.
FLOOR, LIMIT = -(1 << 62), 1 << 62
#: Blocks whose bounds one task holds against a cluster's.
GROUP = 256


# ---- rows ----


def prepared(table: DataFrame, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id, label and x of the rows that take part."""
    own = F.col("label") if label is None else label
    rows = table.filter(F.col(vec_id).isNotNull() & own.isNotNull() & usable(F.col(embedding)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(own.cast("long").alias("label"), scaled(F.col(embedding), factor).alias("x")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.x")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dims)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    f = x.astype(np.float64)
    length = np.sqrt((f * f).sum(axis=1))
    return f / np.where(length == 0, 1.0, length)[:, None], length


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` directions: spherical k-means from rows far apart, a few rounds."""
    points = points[np.abs(points).sum(axis=1) > 0]
    if len(points) == 0 or most <= 1:
        mean = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        norm = np.sqrt((mean * mean).sum())
        return (mean / norm if norm > 0 else mean)[None, :]
    centres = points[np.linspace(0, len(points) - 1, min(most, len(points))).astype(int)]
    for _ in range(6):
        which = np.argmax(points @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, which, points)
        norm = np.sqrt((total * total).sum(axis=1))
        centres = np.where(norm[:, None] > 0, total / np.where(norm == 0, 1.0, norm)[:, None], centres)
    return centres


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


# ---- blocks and clusters ----


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {name: z[name] for name in z.files}


@lru_cache(4)
def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    return _arrays(fetch(folder, name))


def _write(folder: str, **arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return store(folder, out.getvalue())


PLACED = "file string, label long, axis array<double>, spread double, shortest double, longest double"


def _placed(folder: str, labels: pa.ChunkedArray, x: np.ndarray, ids: np.ndarray, ids_at: np.ndarray) -> pa.Table:
    """A file of vectors of one label and what bounds them: axis, largest angle to it, least and largest length."""
    unit, length = directions(x)
    axis = spread(unit, 1)[0]
    wide = float(angle(unit[length > 0] @ axis).max(initial=0.0))
    name = _write(folder, x=x, ids=ids, ids_at=ids_at, axis=axis, spread=np.float64(wide))
    return pa.table(
        {
            "file": [name],
            "label": pa.array([labels[0].as_py()], pa.int64()),
            "axis": pa.array([axis.tolist()], pa.list_(pa.float64())),
            "spread": [wide],
            "shortest": [float(length.min())],
            "longest": [float(length.max())],
        }
    )


def _dealt(rows: DataFrame, dims: int, size: int, most: int, key: str) -> DataFrame:
    """Rows of label and x, with cell and part: rows of one label near one direction, about `size` at most.

    The first 1, 2, 4, .. directions serve labels of so many times `size` rows.
    """
    # A bounded draw; every row is then dealt.
    few = [r["x"] for r in rows.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()]
    drawn = np.array(few, np.int64).reshape(len(few), dims)
    owned = rows.groupBy("label").agg(F.count("*").alias("owned"))
    largest = owned.agg(F.max("owned")).first()[0] or 1
    depth = min(most, -(-largest // size)).bit_length() - 1
    centres = spread(directions(drawn)[0], 1 << depth)
    levels = [min(1 << k, len(centres)) for k in range(depth + 1)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = directions(matrix(batch.column("x"), dims))[0] @ centres.T
            found = np.stack([np.argmax(near[:, :n], axis=1) for n in levels], axis=1).astype(np.int32)
            yield batch.append_column("cells", pa.array(found.tolist(), pa.list_(pa.int32())))

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", cells array<int>"
    level = F.least(F.lit(depth), F.greatest(F.lit(0), F.floor(F.log2(F.col("owned") / F.lit(float(size)))))).cast("int")
    named = rows.mapInArrow(cells, schema).join(owned, "label").withColumn("cell", F.element_at("cells", level + 1)).drop("cells", "owned")
    celled = settled(named, "cells")
    parts = celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    # One row for each label and cell; Spark chooses the join by their size.
    return celled.join(parts, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")


def _blocks(rows: DataFrame, dims: int, ids: int, folder: str, size: int) -> DataFrame:
    """Candidates in blocks of different vectors; of equal ones the smallest `ids` ids are kept."""

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple, list[int]] = {}
            for i, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), matrix(batch.column("x"), dims), strict=True):
                own.setdefault((label, x.tobytes()), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in own], pa.int64()),
                    pa.array([np.frombuffer(k[1], np.int64).tolist() for k in own], pa.list_(pa.int64())),
                    pa.array([sorted(v)[:ids] for v in own.values()], pa.list_(pa.int64())),
                ],
                names=["label", "x", "ids"],
            )

    few = rows.select("vec_id", "label", "x").mapInArrow(fewer, "label long, x array<long>, ids array<long>")
    entries = settled(few.groupBy("label", "x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids")), "entries")

    def write(table: pa.Table) -> pa.Table:
        held = table["ids"].combine_chunks()
        counts = np.asarray(pa.compute.list_value_length(held)).astype(np.int64)
        return _placed(folder, table["label"], matrix(table["x"].combine_chunks(), dims), np.asarray(held.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))

    dealt = _dealt(entries, dims, size, PIVOTS, "x")
    return settled(dealt.groupBy("label", "cell", "part").applyInArrow(write, PLACED), "blocks")


def _clusters(anchors: DataFrame, dims: int, folder: str, size: int) -> DataFrame:
    def write(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids)
        x = matrix(table["x"].combine_chunks(), dims)[order]
        return _placed(folder, table["label"], x, ids[order], np.arange(len(ids) + 1))

    dealt = _dealt(anchors.select("vec_id", "label", "x"), dims, size, CENTRES, "vec_id")
    return settled(dealt.groupBy("label", "cell", "part").applyInArrow(write, PLACED), "clusters")


# ---- the walk ----


class Member:
    """What one anchor still wants: for each limit (scores up to it) the k best entries not under a floor."""

    __slots__ = ("own", "limits", "floors", "kept", "k")

    def __init__(self, own: int, limits: list[int], floors: list[int], k: int):
        self.own, self.limits, self.floors, self.k = own, limits, floors, k
        self.kept: list[list[tuple[int, int]]] = [[] for _ in limits]

    def least(self) -> int | None:
        """The least score that is still of use; None if none is."""
        return min((max(f, -kept[-1][0]) if len(kept) >= self.k else f for f, kept in zip(self.floors, self.kept, strict=True)), default=None)

    def offer(self, scores: np.ndarray, ids: list[list[int]]) -> None:
        for j, (limit, floor) in enumerate(zip(self.limits, self.floors, strict=True)):
            kept = self.kept[j]
            bar = max(floor, -kept[-1][0]) if len(kept) >= self.k else floor
            rows = np.flatnonzero((scores >= bar) & (scores <= limit))
            if len(rows) == 0:
                continue
            more = self.k + 1  # one may be the anchor itself
            if len(rows) > more:  # the best scores with all their ties
                edge = np.partition(scores[rows], len(rows) - more)[len(rows) - more]
                rows = rows[scores[rows] >= edge]
            found = [(-int(scores[r]), i) for r in rows for i in ids[r] if i != self.own]
            self.kept[j] = sorted(kept + found)[: self.k]


def walk(centre: np.ndarray, wide: float, members: list[Member], x: np.ndarray, block: dict[str, np.ndarray], seen: list[int] | None = None) -> None:
    """All members walk the list of one block, sorted by its bound for the cluster; `seen` counts scores."""
    held = block["x"]
    unit, length = directions(held)
    top = length * np.cos(np.maximum(0.0, angle(unit @ centre) - wide))
    order = np.argsort(-top, kind="stable")
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    slack = 1e-6 * (1.0 + own * (length.max() if len(length) else 0.0))
    exact = float(np.abs(held).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, held.shape[1]) < 2**52
    kind = np.float64 if exact else np.int64
    mine, theirs = x.astype(kind), held.astype(kind)
    active = [m for m in range(len(members)) if members[m].least() is not None]
    for first in range(0, len(order), STRIDE):
        rows = order[first : first + STRIDE]
        head = top[rows[0]]
        # Certified: nothing further down scores more than head * own length.
        active = [m for m in active if head * own[m] + slack[m] >= members[m].least()]
        if not active:
            break
        if seen is not None:
            seen[0] += len(active) * len(rows)
        scores = (mine[active] @ theirs[rows].T).astype(np.int64)
        ids = [block["ids"][block["ids_at"][r] : block["ids_at"][r + 1]].tolist() for r in rows]
        least = np.array([members[m].least() for m in active])
        for a in np.flatnonzero(scores.max(axis=1) >= least):
            members[active[a]].offer(scores[a], ids)


def _bound(cluster: str, block: str) -> Column:
    """No entry of the block scores more with the longest member, or less than its negative; some slack for rounding."""
    c, b = (lambda n: F.col(f"{cluster}.{n}")), (lambda n: F.col(f"{block}.{n}"))
    dot = F.aggregate(F.zip_with(c("axis"), b("axis"), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - c("spread") - b("spread") - F.lit(1e-6)
    cosine = F.cos(F.least(F.lit(np.pi), F.greatest(F.lit(0.0), gap)))
    length = F.when(cosine >= 0, b("longest") * c("longest")).otherwise(b("shortest") * c("shortest"))
    return cosine * length + F.lit(1e-6) * (1.0 + b("longest") * c("longest"))


FOUND = "cluster string, anchor_id long, place int, score long, id long"


def _want(folder: str, members: list[tuple[list[int], list[int]]]) -> str:
    """A file of limits and floors of a cluster's members, in the order of its own file."""
    at = np.concatenate([[0], np.cumsum([len(m[0]) for m in members])]).astype(np.int64)
    flat = lambda k: np.array([v for m in members for v in m[k]], np.int64)
    return _write(folder, at=at, limits=flat(0), floors=flat(1))


def _wanted(folder: str, name: str | None, n: int) -> list[tuple[list[int], list[int]]]:
    if name is None:
        return [([LIMIT], [FLOOR])] * n
    held = _read(folder, name)
    return [(held["limits"][a:b].tolist(), held["floors"][a:b].tolist()) for a, b in zip(held["at"][:-1], held["at"][1:], strict=True)]


def _pairs(clusters: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """Cluster, block and bound. The anchors are the stated queries: the row of each of their clusters meets that of each block.

    Blocks are met in groups, so that neither side need be held whole.
    """
    groups = max(1, -(-blocks.count() // GROUP))
    meets = F.col("c.label") == F.col("b.label") if same else F.col("c.label") != F.col("b.label")
    left = clusters.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).alias("c")
    right = blocks.withColumn("group", F.pmod(F.xxhash64("file"), F.lit(groups)).cast("int")).alias("b")
    joined = left.join(right, (F.col("c.group") == F.col("b.group")) & meets)
    return joined.select(F.col("c.file").alias("cluster"), F.col("b.file").alias("block"), _bound("c", "b").alias("bound"))


def _walked(clusters: DataFrame, blocks: DataFrame, same: bool, k: int, folder: str, wanted: DataFrame, stats: list | None) -> DataFrame:
    """cluster, anchor_id, place, rank, score, id: the k best rows of each anchor and limit (by its place), of the same label or of others.

    `wanted` names the file of limits and floors of every cluster; null is one place without limit.
    """
    parts = max(1, clusters.sparkSession.sparkContext.defaultParallelism)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                own = _read(folder, pair["cluster"])
                ids = own["ids"].tolist()
                members = [Member(i, *want, k) for i, want in zip(ids, _wanted(folder, pair["wanted"], len(ids)), strict=True)]
                walk(own["axis"], float(own["spread"]) + 1e-7, members, own["x"], _read(folder, pair["block"]))
                rows = [(i, j, -s, v) for i, m in zip(ids, members, strict=True) for j, kept in enumerate(m.kept) for s, v in kept]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair["cluster"]] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                    names=["cluster", "anchor_id", "place", "score", "id"],
                )

    def run(chosen: DataFrame) -> DataFrame:
        # Rows are names; a task reads each of its blocks once.
        spreadout = chosen.repartition(min(20_000, 4 * parts), "block", "cluster").sortWithinPartitions("block")
        return spreadout.select("cluster", "block", "wanted").mapInArrow(look, FOUND)

    pairs = settled(_pairs(clusters, blocks, same), "pairs")
    best = settled(pairs.groupBy("cluster").agg(F.max_by("block", F.struct("bound", "block")).alias("block")), "best")
    first = settled(run(best.join(wanted, "cluster")), "walk-first")
    # What each member still wants: floors rise to its k-th score.
    tight = first.groupBy("cluster", "anchor_id", "place").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))

    def raised(left: pa.Table, right: pa.Table) -> pa.Table:
        name = left["cluster"][0].as_py()
        ids = _read(folder, name)["ids"].tolist()
        known = {(a, j): s for a, j, s in zip(right["anchor_id"].to_pylist(), right["place"].to_pylist(), right["kth"].to_pylist(), strict=True) if s is not None}
        now = [(limits, [max(f, known.get((i, j), f)) for j, f in enumerate(floors)]) for i, (limits, floors) in zip(ids, _wanted(folder, left["wanted"][0].as_py(), len(ids)), strict=True)]
        least = min((f for _, floors in now for f in floors), default=None)
        return pa.table({"cluster": [name], "least": pa.array([least], pa.int64()), "wanted": [_want(folder, now)]})

    still = settled(wanted.groupBy("cluster").cogroup(tight.groupBy("cluster")).applyInArrow(raised, "cluster string, least long, wanted string"), "walk-wanted")
    left = pairs.join(best.select("cluster", F.col("block").alias("done")), "cluster").filter("block <> done").join(still, "cluster").filter("bound >= least")
    if stats is not None:
        stats.append((pairs.count(), left.count()))
    ranked = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id")
    both = first.unionByName(run(left)).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return both.select("cluster", "anchor_id", "place", "rank", "score", "id")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = LEAST, most: int = MOST, block: int = BLOCK, members: int = MEMBERS, stats: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and x (array of long) and is read several times; `anchors` says which rows are anchors. A negative's
    score is between `least` and `most` percent of the positive's. `stats` gets, for each walk, pairs of cluster and block and those visited after the first.
    """
    spark = rows.sparkSession
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # A round for each length of vectors; there is one in ordinary tables.
    for r in sorted(rows.select(F.size("x").alias("dims")).distinct().collect(), key=lambda r: r["dims"]):
        same = rows.filter(F.size("x") == r["dims"])
        out = out.unionByName(_mine_same(same, same.filter(anchors), r["dims"], positives, negatives, least, most, block, members, stats))
    return out


def _mine_same(rows: DataFrame, anchors: DataFrame, dims: int, positives: int, negatives: int, least: int, most: int, block: int, members: int, stats: list | None) -> DataFrame:
    folder = new_dir(rows.sparkSession, "negatives")
    blocks = _blocks(rows, dims, max(positives + 1, negatives), folder, block)
    clusters = _clusters(anchors, dims, folder, members)
    alone = clusters.select(F.col("file").alias("cluster"), F.lit(None).cast("string").alias("wanted"))
    near = settled(_walked(clusters, blocks, True, positives, folder, alone, stats), "positives")

    def wants(left: pa.Table, right: pa.Table) -> pa.Table:
        """Limits of each member: its positives' different scores from 0 up, with floors."""
        name = left["cluster"][0].as_py()
        scores: dict[int, set[int]] = {}
        for a, s in zip(right["anchor_id"].to_pylist(), right["score"].to_pylist(), strict=True):
            if s >= 0:
                scores.setdefault(a, set()).add(s)
        order = [sorted(scores.get(i, ()), reverse=True) for i in _read(folder, name)["ids"].tolist()]
        return pa.table({"cluster": [name], "wanted": [_want(folder, [([most * s // 100 for s in own], [-(-least * s // 100) for s in own]) for own in order])]})

    wanted = settled(alone.groupBy("cluster").cogroup(near.select("cluster", "anchor_id", "score").groupBy("cluster")).applyInArrow(wants, "cluster string, wanted string"), "wanted")
    far = _walked(clusters, blocks, False, negatives, folder, wanted, stats)
    # The place of a positive's score among the different ones of its anchor names its limit.
    placed = near.filter("score >= 0").withColumn("place", (F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc())) - 1).cast("int"))
    placed = placed.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    found = far.select("anchor_id", "place", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return placed.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
