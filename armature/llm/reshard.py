"""Resharding by a minimum-cost flow.

Documents lie in old shards. New shards get equal shares of all bytes as capacities. A transport problem
from old shard sizes to new capacities, where a byte that stays in a shard of the same number costs nothing and a moved byte
costs one, is solved exactly by successive shortest paths; so the fewest bytes move. Old shards are cut
into blocks by a hash of their documents, and the flow is turned into whole blocks that stay or move. Only files of old
shards that lose blocks are written anew; shards that only gain keep their files and get new ones beside them.

The driver solves for shards and blocks, some thousands of each however many documents there are (a block holds at least
`BLOCK_BYTES` beyond that). Documents are never shuffled by shard: blocks are looked up in a broadcast table of one row
for each block, and slots are numbered within blocks.

Defined cases: a null text has size 1 and the checksum of an empty one; null ids are ids like others; repeated rows
are documents of their own with slots of their own; an empty table gives an empty result. The files keep all
columns of the input; columns named `shard` or `old_shard` in it are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks of all shards, and the bytes of a block beyond which there are more.
BLOCKS = 4096
BLOCK_BYTES = 256 << 20
_STEPS = 1 << 30


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def checksum(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


# ---- flow ----


def fewest_moves(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Flow from old to new shards of least cost; by default moving costs one a byte and staying nothing.

    Successive shortest paths with potentials; supplies and capacities must have the same sum.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) != sum(capacity):
        raise ValueError("supplies and capacities differ")
    price = cost or [[0 if i == j else 1 for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    far = float("inf")
    while any(left):
        # Dijkstra from all old shards with bytes left, over reduced costs.
        distance = [0 if i < n and left[i] else far for i in range(n + m)]
        before = [-1] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        heapq.heapify(queue)
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            edges = ((n + j, price[u][j]) for j in range(m)) if u < n else ((i, -price[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                e = d + c + potential[u] - potential[v]
                if e < distance[v]:
                    distance[v], before[v] = e, u
                    heapq.heappush(queue, (e, v))
        end = min((j for j in range(m) if room[j]), key=lambda j: distance[n + j] + potential[n + j])
        top = max(d for d in distance if d < far)
        potential = [p + min(d, top) for p, d in zip(potential, distance, strict=True)]
        path, v = [], n + end
        while before[v] >= 0:
            path.append((before[v], v))
            v = before[v]
        amount = min([room[end], left[v], *[flow[b][a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end] -= amount
    return flow


def whole_blocks(blocks: dict[int, list[int]], flow: list[list[int]], capacity: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, number), near to the flow; then the least blocks even out what rounding left."""
    out: dict[tuple[int, int], int] = {}
    for i, sizes in blocks.items():
        # Bytes that stay come first.
        order = sorted(range(len(capacity)), key=lambda j: (j != i, j))
        ends, total = [], 0
        for j in order:
            total += flow[i][j]
            ends.append((total, j))
        at, k = 0, 0
        for b, s in enumerate(sizes):
            middle = at + s / 2
            while k < len(ends) - 1 and middle > ends[k][0]:
                k += 1
            out[i, b] = ends[k][1]
            at += s
    load = [0] * len(capacity)
    for key, j in out.items():
        load[j] += blocks[key[0]][key[1]]
    for _ in range(4 * len(capacity)):
        over = max(range(len(capacity)), key=lambda j: load[j] - capacity[j])
        under = min(range(len(capacity)), key=lambda j: load[j] - capacity[j])
        gap = min(load[over] - capacity[over], capacity[under] - load[under])
        # Blocks that were moved anyway go first; the largest that the gap takes.
        fits = [(blocks[i][b], (i, b)) for (i, b), j in out.items() if j == over and 0 < blocks[i][b] <= gap]
        if not fits:
            break
        s, key = max(fits, key=lambda f: (f[1][0] != over, f[0]))
        out[key] = under
        load[over] -= s
        load[under] += s
    return out


# ---- documents ----


@dataclass
class Layout:
    """Blocks of each old shard, their new shards, and which old shards lose documents."""

    counts: dict[int, int]
    table: DataFrame
    losing: list[int]
    moved: int


def _old_rows(docs: DataFrame, counts: dict[int, int], doc_id: str, text: str) -> DataFrame:
    """Rows with `block`, a run of hashes within their old shard."""
    spread = F.pmod(F.xxhash64(F.col(doc_id), checksum(text)), F.lit(_STEPS))
    per = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair]), F.col("old_shard")) if counts else F.lit(1)
    return docs.withColumn("block", F.floor(spread * per / F.lit(_STEPS)).cast("int"))


def plan(old: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> Layout:
    """What goes where, for documents with an `old_shard`, and equal capacities."""
    spark = old.sparkSession
    sizes = {r["old_shard"]: r["n"] for r in old.groupBy("old_shard").agg(F.sum(size_of(text)).alias("n")).collect()}
    total = sum(sizes.values())
    each = max(1, min(-(-total // blocks), BLOCK_BYTES))
    counts = {i: -(-n // each) for i, n in sizes.items()}
    found = _old_rows(old.select(doc_id, text, "old_shard"), counts, doc_id, text).groupBy("old_shard", "block").agg(F.sum(size_of(text)).alias("bytes"), F.count("*").alias("rows")).collect()
    by_shard = {i: [0] * counts[i] for i in sizes}
    rows = {(r["old_shard"], r["block"]): r["rows"] for r in found}
    for r in found:
        by_shard[r["old_shard"]][r["block"]] = r["bytes"]
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    n_old = max(sizes, default=-1) + 1
    to = whole_blocks(by_shard, fewest_moves([sizes.get(i, 0) for i in range(n_old)], capacity), capacity)
    # First slot of each block: documents of the shard's blocks before it.
    taken, lines = [0] * shards, []
    for i, b in sorted(to):
        lines.append((i, b, to[i, b], taken[to[i, b]]))
        taken[to[i, b]] += rows.get((i, b), 0)
    losing = sorted({i for (i, b), j in to.items() if j != i and rows.get((i, b))})
    moved = sum(by_shard[i][b] for (i, b), j in to.items() if j != i)
    table = spark.createDataFrame(lines, "old_shard int, block int, shard int, first long")
    return Layout(counts, table, losing, moved)


def write_old(docs: DataFrame, path: str) -> None:
    """Documents as files below old_shard=N folders."""
    docs.write.partitionBy("old_shard").parquet(path)


def read_old(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("old_shard", F.col("old_shard").cast("int"))


def rewrite(spark: SparkSession, old_path: str, new_path: str, layout: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of losing shards and of moved documents anew; all documents with `shard` and `slot`, read from files.

    Shards that lose nothing are read from their old files, which aren't touched.
    """
    blocks = F.broadcast(layout.table)
    old = read_old(spark, old_path)
    lost = old.filter(F.col("old_shard").isin(layout.losing)) if layout.losing else old.limit(0)
    written = _old_rows(lost, layout.counts, doc_id, text).join(blocks.select("old_shard", "block", "shard"), ["old_shard", "block"]).drop("block")
    written.write.partitionBy("shard").parquet(new_path)
    anew = spark.read.schema(written.schema).parquet(new_path)
    kept = old.filter(~F.col("old_shard").isin(layout.losing)) if layout.losing else old
    everything = anew.unionByName(kept.withColumn("shard", F.col("old_shard")))
    placed = _old_rows(everything, layout.counts, doc_id, text).join(blocks.select("old_shard", "block", "first"), ["old_shard", "block"])
    return placed


def with_slots(placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: documents of a shard are numbered block by block, without gaps."""
    thin = placed.select(F.col(doc_id).alias("doc_id"), size_of(text).alias("size"), checksum(text).alias("text_crc32"), "old_shard", "block", "shard", "first")
    within = Window.partitionBy("old_shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return thin.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(within) - 1).alias("slot"))
