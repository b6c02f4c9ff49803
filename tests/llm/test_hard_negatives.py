"""Hard negatives against brute force, and how much of the lists is walked."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.llm import hard_negatives
from armature.llm.hard_negatives import FLOOR, LIMIT, Member, directions, spread, walk


def expected(rows, positives=5, negatives=5):
    """Rows are (vec_id, label, integers)."""
    best = {}
    for i, label, x in rows:
        best[i] = min(best.get(i, (label, x)), (label, x))
    out = []
    for a, (label, x) in best.items():
        if a % 10:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in best.items() if i != a and len(y) == len(x)]
        for p, i, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted((n, j) for n, j, other in scored if other != label and 80 * -p <= 100 * -n <= 100 * -p)
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dims, seed):
    random.seed(seed)
    centres = [[random.gauss(0, 60) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        x = [round(c + random.gauss(0, 25)) for c in random.choice(centres)]
        if i % 8 == 0:
            x = [round(v) for v in centres[0]]  # one very common vector, in several labels
        if i % 61 == 0:
            x = [0] * dims
        rows.append((i, 0 if i % 3 == 0 else random.randint(0, 4), x))
    return rows


@pytest.mark.parametrize("block, members", [(4096, 1024), (16, 3)])
def test_mined_against_brute_force(spark, block, members):
    rows = [*vectors(260, 6, 1), *((1000 + i, label, x[:3]) for i, label, x in vectors(40, 6, 2))]
    rows += [rows[10], (20, 9, [1] * 6), (2000, 3, []), (2010, 3, []), (2001, 4, [])]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<long>").withColumn("part", F.lit("a"))
    ready = df.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    assert got(hard_negatives.mine(ready, F.col("vec_id") % 10 == 0, block=block, members=members)) == expected(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [0.5, -0.001]), (2, None, [0.5, 1.0]), (3, 1, None), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [None, 1.0]), (None, 1, [1.0, 1.0]), (7, 2, [1.0, 1.0]), (7, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(tuple(r) for r in hard_negatives.prepared(df).collect()) == [(1, 0, [128, -1]), (7, 1, [256, 256])]
    assert got(hard_negatives.mine(hard_negatives.prepared(df.limit(0)), F.lit(True))) == []
    assert got(hard_negatives.mine(hard_negatives.prepared(df), F.lit(False))) == []


def test_blocks_out_of_reach_are_not_visited(spark):
    rng = np.random.default_rng(5)
    axes = rng.normal(size=(12, 8))
    visited = []
    for n in (600, 2400):
        x = (axes[np.arange(n) % 12] * 200 + rng.normal(size=(n, 8)) * 8).round().astype(int)
        rows = [(i, int(i // 12 % 2), x[i].tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, label long, x array<long>").cache()
        stats = []
        anchors = F.col("vec_id") % 60 == 0
        out = hard_negatives.mine(df, anchors, block=25, members=4, stats=stats)
        assert out.count() > 0
        visited.append([left / pairs for pairs, left in stats])
    # Of the pairs of cluster and block, far fewer than all are read.
    assert max(v for two in visited for v in two) < 0.35, visited


def test_members_stop_on_certified_termination():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(4000, 8)) * rng.gamma(1.0, 60.0, size=(4000, 1))).round().astype(np.int64)
    block = {"x": x, "ids": np.arange(4000), "ids_at": np.arange(4001)}
    own = x[:6] // 2 + x[6] // 2
    unit, _ = directions(own)
    centre = spread(unit, 1)[0]
    wide = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
    members, seen = [Member(-1, [LIMIT], [FLOOR], 5) for _ in own], [0]
    walk(centre, wide + 1e-9, members, own, block, seen)
    for q, m in zip(own, members, strict=True):
        s = x @ q
        assert m.kept[0] == sorted((-int(v), i) for i, v in enumerate(s.tolist()))[:5]
    assert seen[0] < 0.6 * len(own) * len(x)
