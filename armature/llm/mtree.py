"""Exact top-k search by inner product with M-trees.

Vectors are integers. With one more component, sqrt(M - |x|^2) where M is the largest |x|^2, all have the same
length, and the largest inner products with a query are the smallest Euclidean distances to it, a metric. Equal vectors are
one entry with its smallest ids. Entries are dealt to the nearest of some pivots; each cell, cut further when it
is large, becomes an M-tree: routing nodes with covering radius and distance to their parent, leaves (pages) of entries
with their distance to the page's pivot. Trees are files in the shared folder.

A query searches its own cell's tree first, best node first, which gives a bound; then all other trees with
that bound, in blocks of queries against trees. Nodes are skipped when distance minus radius exceeds the bound, and entries
and nodes without computing a distance when the stored parent distances already tell so by the triangle inequality. Pruning
has some slack for rounding; scores are exact integers.

Defined cases: vectors that are null or hold a null or a non-finite component, and rows without an id, take no
part; of rows with one id the least vector does; vectors of another length are in trees of their own and don't meet;
ties go to the smaller id; a query with fewer candidates than k gets all. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.llm.token_files import place
from armature.plans.lookups import settled
from armature.session import new_dir

#: Entries of a tree and of a page, children of a routing node, queries of a block, pivots that deal entries to cells.
TREE = 16_384
PAGE = 128
FAN = 24
QUERIES = 256
PIVOTS = 1024


def scaled(embedding: Column, factor: int = 256) -> Column:
    """Integers floor(factor * x)."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


# ---- one tree ----


class Tree:
    """Entries (integer vectors with up to a few ids each) below nodes; children of a node lie side by side."""

    FIELDS = ("x", "ids", "ids_at", "pivot", "radius", "parent_distance", "child_first", "child_end", "leaf", "entry", "entry_distance")

    def __init__(self, fields: dict[str, np.ndarray], most: float):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.most = most
        self.points = lifted(self.x, most)

    @classmethod
    def build(cls, x: np.ndarray, ids: list[list[int]], most: float) -> Tree:
        points = lifted(x, most)
        n = len(x)
        nodes: list[dict] = []
        entry: list[np.ndarray] = []
        entry_distance: list[np.ndarray] = []

        def middle(rows: np.ndarray) -> int:
            """The row nearest to the mean."""
            return int(rows[np.argmin(((points[rows] - points[rows].mean(axis=0)) ** 2).sum(axis=1))])

        root = middle(np.arange(n))
        todo = [(np.arange(n), root, 0.0, None)]
        placed = 0
        while todo:
            level, todo = todo, []
            # Children of one node are appended together, so they lie side by side.
            for rows, pivot, up, parent in level:
                d = np.sqrt(((points[rows] - points[pivot]) ** 2).sum(axis=1))
                me = len(nodes)
                nodes.append({"pivot": pivot, "radius": float(d.max()), "up": up, "first": 0, "end": 0, "leaf": True, "rows": rows})
                if parent is not None:
                    nodes[parent]["first"] = nodes[parent]["first"] or me
                    nodes[parent]["end"] = me + 1
                parts = cls._parts(points, rows) if len(rows) > PAGE else []
                if len(parts) > 1:
                    nodes[me]["leaf"] = False
                    for part in parts:
                        p = middle(part)
                        todo.append((part, p, float(np.sqrt(((points[p] - points[pivot]) ** 2).sum())), me))
                else:
                    order = np.argsort(d, kind="stable")
                    nodes[me]["first"], nodes[me]["end"] = placed, placed + len(rows)
                    entry.append(rows[order])
                    entry_distance.append(d[order])
                    placed += len(rows)
        col = lambda k, t: np.array([v[k] for v in nodes], t)
        sizes = np.array([len(i) for i in ids], np.int64)
        return cls(
            {
                "x": x,
                "ids": np.array([i for own in ids for i in own], np.int64),
                "ids_at": np.concatenate([[0], np.cumsum(sizes)]),
                "pivot": col("pivot", np.int64),
                "radius": col("radius", np.float64),
                "parent_distance": col("up", np.float64),
                "child_first": col("first", np.int64),
                "child_end": col("end", np.int64),
                "leaf": col("leaf", bool),
                "entry": np.concatenate(entry),
                "entry_distance": np.concatenate(entry_distance),
            },
            most,
        )

    @staticmethod
    def _parts(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Rows by the nearest of up to FAN spread-out rows; halves if all are equal in distance."""
        fan = min(FAN, -(-len(rows) // PAGE) + 1)
        chosen = [int(rows[0])]
        nearest = ((points[rows] - points[chosen[0]]) ** 2).sum(axis=1)
        which = np.zeros(len(rows), np.int64)
        for k in range(1, fan):
            far = int(np.argmax(nearest))
            if nearest[far] <= 0:
                break
            chosen.append(int(rows[far]))
            d = ((points[rows] - points[chosen[-1]]) ** 2).sum(axis=1)
            closer = d < nearest
            which[closer], nearest[closer] = k, d[closer]
        return [rows[which == k] for k in range(len(chosen)) if (which == k).any()]

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, most=np.float64(self.most), **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            return cls({name: z[name] for name in cls.FIELDS}, float(z["most"]))

    def search(self, q: np.ndarray, own: int, k: int, bound: int | None, seen: list[int] | None = None) -> list[tuple[int, int]]:
        """Up to k (score, id) of entries not under `bound`, best first; `seen` counts pages and distances."""
        length = float((q.astype(np.float64) ** 2).sum())
        point = np.append(q.astype(np.float64), 0.0)
        slack = 1e-6 * (1.0 + np.sqrt(length + self.most))
        exact = float(np.abs(self.x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**52
        xs, qs = (self.points[:, :-1], point[:-1]) if exact else (self.x, q)
        best: list[tuple[int, int]] = []

        def reach() -> float:
            """Distance beyond which no entry can score as much as the last one wanted."""
            least = best[k - 1][0] if len(best) >= k else None
            if bound is not None:
                least = bound if least is None else max(least, bound)
            return np.inf if least is None else np.sqrt(max(0.0, length + self.most - 2.0 * least)) + slack

        def distance(rows: np.ndarray) -> np.ndarray:
            if seen is not None:
                seen[1] += len(rows)
            return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

        d = float(distance(self.pivot[:1])[0])
        queue = [(max(0.0, d - self.radius[0]), 0, d)]
        while queue:
            low, node, d = heapq.heappop(queue)
            far = reach()
            if low > far:
                break
            a, b = self.child_first[node], self.child_end[node]
            if self.leaf[node]:
                if seen is not None:
                    seen[0] += 1
                rows = self.entry[a:b][np.abs(d - self.entry_distance[a:b]) <= far]
                if len(rows) == 0:
                    continue
                if seen is not None:
                    seen[1] += len(rows)
                score = xs[rows] @ qs
                least = best[k - 1][0] if len(best) >= k else -np.inf
                keep = score >= max(least, bound if bound is not None else -np.inf)
                for r, s in zip(rows[keep].tolist(), score[keep].tolist(), strict=True):
                    best += [(int(s), i) for i in self.ids[self.ids_at[r] : self.ids_at[r + 1]].tolist() if i != own]
                best = sorted(best, key=lambda t: (-t[0], t[1]))[:k]
                continue
            child = np.arange(a, b)
            child = child[np.abs(d - self.parent_distance[child]) - self.radius[child] <= far]
            if len(child):
                ds = distance(self.pivot[child])
                lows = np.maximum(0.0, ds - self.radius[child])
                for c, l, e in zip(child.tolist(), lows.tolist(), ds.tolist(), strict=True):
                    if l <= far:
                        heapq.heappush(queue, (l, c, e))
        return best


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes their squared length `most`."""
    f = x.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(0.0, most - (f * f).sum(axis=1)))[:, None]], axis=1)


# ---- files ----


def _store(folder: str, raw: bytes) -> str:
    files, at = place(folder)
    files.create_dir(at, recursive=True)
    name = uuid.uuid4().hex
    with files.open_output_stream(f"{at}/{name}") as f:
        f.write(raw)
    return name


def _fetch(folder: str, name: str) -> bytes:
    files, at = place(folder)
    with files.open_input_stream(f"{at}/{name}") as f:
        return f.read()


@lru_cache(4)
def _tree(folder: str, name: str) -> Tree:
    return Tree.load(_fetch(folder, name))


@lru_cache(4)
def _queries(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(_fetch(folder, name))) as z:
        return z["ids"], z["x"]


# ---- search ----


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dims)


def _entries(vectors: DataFrame, ids: int) -> DataFrame:
    """Different vectors with their smallest ids. Equal vectors are first joined within batches, so one that is
    very frequent gives a few ids for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.setdefault(np.asarray(x.values).astype("<i8").tobytes(), []).append(i)
            lists = pa.array([np.frombuffer(x, "<i8").tolist() for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lists, pa.array([sorted(v)[:ids] for v in own.values()], pa.list_(pa.int64()))], names=["x", "ids"])

    few = vectors.mapInArrow(run, "x array<long>, ids array<long>")
    return few.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tree: int = TREE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both tables have vec_id and x (array of long); equal ids are the same row."""
    spark = vectors.sparkSession
    entries = settled(_entries(vectors, k + 1).withColumn("dims", F.size("x")), "mtree-entries")
    lengths = entries.groupBy("dims").agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("most")).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    out = spark.createDataFrame([], schema)
    # A round for each length of vectors; there is one in ordinary tables.
    for row in sorted(lengths, key=lambda r: r["dims"]):
        found = _search_same(entries.filter(F.col("dims") == row["dims"]), queries.filter(F.size("x") == row["dims"]), row["dims"], row["n"], float(row["most"]), k, tree)
        out = out.unionByName(found)
    return out


def _search_same(entries: DataFrame, queries: DataFrame, dims: int, n: int, most: float, k: int, size: int) -> DataFrame:
    spark = entries.sparkSession
    drawn = entries.select("x").orderBy(F.md5(F.concat_ws(",", F.col("x").cast("array<string>"))), "x").limit(max(1, min(PIVOTS, n // size))).collect()
    pivots = np.array([r["x"] for r in drawn], np.int64).reshape(len(drawn), dims)
    lifted_pivots = lifted(pivots, most)

    def nearest(points: np.ndarray) -> np.ndarray:
        return np.argmin((lifted_pivots**2).sum(axis=1)[None, :] - 2.0 * points @ lifted_pivots.T, axis=1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            yield batch.append_column("cell", pa.array(nearest(lifted(x, most)).astype(np.int32)))

    celled = settled(entries.select("x", "ids").mapInArrow(cells, "x array<long>, ids array<long>, cell int"), "mtree-cells")
    # At most PIVOTS rows.
    slices = {r["cell"]: -(-r["count"] // size) for r in celled.groupBy("cell").count().collect()}
    per = F.element_at(F.create_map(*[F.lit(v) for pair in sorted(slices.items()) for v in pair]), F.col("cell"))
    dealt = celled.withColumn("slice", F.pmod(F.xxhash64("x"), per).cast("int"))
    folder = new_dir(spark, "mtree")

    def grow(table: pa.Table) -> pa.Table:
        x = _matrix(table["x"].combine_chunks(), dims)
        order = np.lexsort(x.T[::-1]) if dims else np.arange(len(x))
        ids = table["ids"].to_pylist()
        made = Tree.build(x[order], [ids[i] for i in order], most)
        return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int32()), "slice": pa.array([table["slice"][0].as_py()], pa.int32()), "tree": [_store(folder, made.save())]})

    trees = settled(dealt.groupBy("cell", "slice").applyInArrow(grow, "cell int, slice int, tree string"), "mtree-trees")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            point = np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1)
            yield batch.append_column("cell", pa.array(nearest(point).astype(np.int32)))

    near = settled(queries.select("vec_id", "x").mapInArrow(home, "vec_id long, x array<long>, cell int"), "mtree-queries")
    counts = {r["cell"]: -(-r["count"] // QUERIES) for r in near.groupBy("cell").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = F.element_at(F.create_map(*[F.lit(v) for pair in sorted(counts.items()) for v in pair]), F.col("cell"))

    def bundle(table: pa.Table) -> pa.Table:
        raw = io.BytesIO()
        np.savez(raw, ids=table["vec_id"].to_numpy(), x=_matrix(table["x"].combine_chunks(), dims))
        return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int32()), "block": [_store(folder, raw.getvalue())]})

    blocks = settled(near.withColumn("part", F.pmod(F.xxhash64("vec_id"), share).cast("int")).groupBy("cell", "part").applyInArrow(bundle, "cell int, block string"), "mtree-blocks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                ids, x = _queries(folder, pair["block"])
                bounds = pair["bounds"] or [None] * len(ids)
                held = _tree(folder, pair["tree"])
                got = [(int(i), s, v) for i, q, b in zip(ids, x, bounds, strict=True) for s, v in held.search(q, int(i), k, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair["block"]] * len(got), pa.string()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                    names=["block", "query_id", "vec_id", "score"],
                )

    found_schema = "block string, query_id long, vec_id long, score long"
    own = blocks.join(trees.filter("slice = 0"), "cell").select("block", "tree", F.lit(None).cast("array<long>").alias("bounds"))
    parts = max(1, spark.sparkContext.defaultParallelism)
    first = settled(own.repartition(parts, "tree", "block").mapInArrow(look, found_schema), "mtree-first")
    # The k-th score of each query so far, in the order of the block's file.
    last = first.groupBy("block", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))

    def bounded(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        known = dict(zip(table["query_id"].to_pylist(), table["bound"].to_pylist(), strict=True))
        ids, _ = _queries(folder, block)
        return pa.table({"block": [block], "bounds": pa.array([[known.get(int(i)) for i in ids]], pa.list_(pa.int64()))})

    bounds = last.groupBy("block").applyInArrow(bounded, "block string, bounds array<long>")
    # Every block of queries meets every other tree: the blocks are names and bounds, the vectors stay in files.
    every = blocks.join(bounds, "block", "left").crossJoin(trees.select(F.col("cell").alias("c"), "slice", "tree")).filter("not (c = cell and slice = 0)")
    rest = every.select("block", "tree", "bounds").repartition(max(parts, 4 * parts), "tree", "block").mapInArrow(look, found_schema)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    both = first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def prepared(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id and x of the rows that take part."""
    usable_rows = table.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding)))
    return usable_rows.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), factor).alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
