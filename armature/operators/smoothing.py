"""Smoothing and rate limiting of vectors along an episode.

Both filters feed their own output back, so they are not window functions. A row number
per key clusters and sorts the rows (an existing partitioning by the keys is used as it
is) and marks where an episode starts; the filter then runs over Arrow batches, one numpy
step for all episodes of a batch at once.

Long stretches are cut into pieces that advance side by side. For the moving average a
piece's exit is linear in its entry. For the limiter, which is monotone, a piece is run
from both ends of the range its entry must lie in: where the two runs meet, the exit does
not depend on the entry; where they do not, the piece is run again from its true entry.

An episode longer than a block is spread over tasks the same way. A first pass reduces
every block to the exact map from entry to exit state (affine, constant, or piecewise
linear with slopes 0 and 1), chaining those maps, one row per block, gives each block its
entry, and a second pass filters all blocks in parallel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from armature.functions import vectors as V
from armature.plans.blocks import BLOCK, block_of, fits, last_position
from armature.plans.lookups import lookup_join, settled
from armature.schema import (
    EXECUTED,
    HORIZON,
    JOINT_DIM,
    KEYS,
    POS,
    SMOOTHING_ALPHA,
    SMOOTHING_MAX_DELTA,
    SMOOTHING_PRESETS,
)

Stage = tuple[str, float]
VECTOR = T.ArrayType(T.DoubleType())
#: Rows that advance as one piece, and rounds in which the limiter's ranges may close.
PIECE, ROUNDS = 256, 4
#: Beyond any joint position.
FAR = 1e300


def ema(
    df: DataFrame, col: str, alpha: float = SMOOTHING_ALPHA, out: str = "smoothed", keys: Sequence[str] = KEYS, **kw
) -> DataFrame:
    """Exponential moving average: the first vector is unchanged, then a*x + (1-a)*previous."""
    return recurrence(df, col, out, [("ema", alpha)], keys, **kw)


def limit_velocity(
    df: DataFrame,
    col: str,
    max_delta: float = SMOOTHING_MAX_DELTA,
    out: str = "limited",
    keys: Sequence[str] = KEYS,
    **kw,
) -> DataFrame:
    """Follow the input by at most `max_delta` per step, measured from the limited value before."""
    return recurrence(df, col, out, [("limit", max_delta)], keys, **kw)


def smooth(
    df: DataFrame,
    col: str,
    preset: str = "medium",
    out: str = "smoothed",
    keys: Sequence[str] = KEYS,
    alpha: float | None = None,
    max_delta: float | None = None,
    **kw,
) -> DataFrame:
    """Moving average, then limiter, with the parameters of a preset, or of one's own ("custom")."""
    if preset == "custom":
        if alpha is None or max_delta is None:
            raise ValueError("a custom preset needs alpha and max_delta")
    elif preset in SMOOTHING_PRESETS:
        alpha, max_delta, _ = SMOOTHING_PRESETS[preset]
    else:
        raise ValueError(f"unknown preset {preset!r}, expected custom or one of {sorted(SMOOTHING_PRESETS)}")
    return recurrence(df, col, out, [("ema", alpha), ("limit", max_delta)], keys, **kw)


def smooth_predictions(
    pred: DataFrame,
    col: str = "action",
    preset: str = "medium",
    advance: str = "horizon",
    out: str = "smoothed",
    keys: Sequence[str] = ("run", "episode_index"),
    horizon: int = HORIZON,
    executed: int = EXECUTED,
    **kw,
) -> DataFrame:
    """Smooth predicted chunks in order of (chunk, step).

    advance="horizon" lets the state run through every predicted step, executed or not;
    "executed" keeps the steps that are sent and smooths only those.
    """
    if advance not in ("horizon", "executed"):
        raise ValueError("advance must be 'horizon' or 'executed'")
    if advance == "executed":
        pred = pred.filter(F.col("step") < executed)
        horizon = executed
    order = pred.withColumn("_order", F.col("chunk") * horizon + F.col("step"))
    return smooth(order, col, preset, out, keys, pos="_order", **kw).drop("_order")


def execute_chunks(
    pred: DataFrame,
    k: int = EXECUTED,
    stride: int = EXECUTED,
    col: str = "action",
    keys: Sequence[str] = ("run", "episode_index"),
) -> DataFrame:
    """First k steps of each chunk on one timeline; where chunks overlap the newest wins.

    Chunk c starts at frame c * stride.
    """
    sent = pred.filter(F.col("step") < k).withColumn("frame_index", F.col("chunk") * stride + F.col("step"))
    return sent.groupBy(*keys, "frame_index").agg(
        F.max("chunk").alias("chunk"), F.max_by(F.col(col), F.col("chunk")).alias(col)
    )


def recurrence(
    df: DataFrame,
    col: str,
    out: str,
    stages: Sequence[Stage],
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    dim: int = JOINT_DIM,
    size: int = BLOCK,
    longest: int | None = None,
) -> DataFrame:
    """Run filter stages along each episode. `longest` bounds the positions of an episode;
    if it is not given, one column is read to find it."""
    keys = list(keys)
    stages = list(stages)
    longest = last_position(df, pos) if longest is None else longest
    if fits(longest, size):
        return _apply(df, col, out, stages, keys, pos, dim)
    lanes = V.lanes(col, dim)
    spans = df.groupBy(*keys).agg(
        F.max(pos).alias("_last"),
        F.min(F.array_min(F.array(*lanes))).alias("_low"),
        F.max(F.array_max(F.array(*lanes))).alias("_high"),
    )
    many = settled(spans.filter(F.col("_last") >= size).drop("_last"), "long-episodes")
    if many.isEmpty():
        return _apply(df, col, out, stages, keys, pos, dim)
    short = lookup_join(df, many.select(*keys), keys, "left_anti", spread=[pos])
    long = lookup_join(df, many, keys, "inner", spread=[pos]).withColumn("_block", block_of(pos, size))
    long = settled(long, "long-rows")
    source, scratch = col, []
    for i, stage in enumerate(stages):
        last = i == len(stages) - 1
        target = out if last else f"_stage_{i}"
        entries = _entries(long, source, stage, keys, pos, dim)
        joined = long.drop("_low", "_high").join(entries, [*keys, "_block"], "left")
        done = _apply(joined, source, target, [stage], [*keys, "_block"], pos, dim, "_entry").drop("_entry")
        long = done if last else lookup_join(settled(done, "smoothed-rows"), many, keys, "inner", spread=[pos])
        scratch += [] if last else [target]
        source = target
    return _apply(short, col, out, stages, keys, pos, dim).unionByName(long.drop("_block", *scratch))


def _sorted(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Rows clustered by the keys and in position order, `_step` counting from 1 per key."""
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("_step", step).sortWithinPartitions(*keys, pos)


def _apply(df, col, out, stages, keys, pos, dim, entry_col=None) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, VECTOR)])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [np.zeros(dim) for _ in stages]
        for batch, starts, lens, resumed in _segments(batches):
            x = _matrix(batch.column(col), dim)
            known = np.zeros(len(starts), dtype=bool)
            states = [np.zeros((len(starts), dim)) for _ in stages]
            if entry_col is not None:
                column = batch.column(entry_col).take(pa.array(starts))
                known = np.asarray(pc.list_value_length(column)) > 0
                states[0][known] = np.asarray(column.flatten()).reshape(-1, dim)
            if resumed:
                known[0] = True
                for s, last in zip(states, state, strict=True):
                    s[0] = last
            y = advance(x, starts, lens, known, states, stages)
            for i, s in enumerate(states):
                state[i] = s[-1]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, _vectors(y)], names=[*names, out])

    ordered = _sorted(df, keys, pos)
    if entry_col is not None:
        # Needed once per block. Empty lists, as null lists make Arrow writing quadratic.
        once = F.when((F.col("_step") == 1) & F.col(entry_col).isNotNull(), F.col(entry_col))
        ordered = ordered.withColumn(entry_col, once.otherwise(F.array().cast(VECTOR)))
    return ordered.mapInArrow(run, schema)


def _entries(df, col, stage, keys, pos, dim) -> DataFrame:
    """State at the start of every block but an episode's first."""
    key_fields = [df.schema[k] for k in keys]
    block = T.StructField("_block", T.LongType())
    points = T.ArrayType(VECTOR)
    fields = [T.StructField("slope", T.DoubleType()), T.StructField("at", points), T.StructField("to", points)]
    map_schema = T.StructType([*key_fields, block, *fields])
    map_arrow = to_arrow_schema(map_schema)
    entry_schema = T.StructType([*key_fields, block, T.StructField("_entry", VECTOR)])
    entry_arrow = to_arrow_schema(entry_schema)

    def reduce_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _BlockMap | None = None
        for batch, starts, lens, resumed in _segments(batches):
            x = _matrix(batch.column(col), dim)
            done = []
            for i, (start, length) in enumerate(zip(starts, lens, strict=True)):
                if i > 0 or not resumed:
                    if current is not None:
                        done.append(current.row())
                    head = {k: batch.column(k)[start].as_py() for k in [*keys, "_block"]}
                    span = [batch.column(c)[start].as_py() for c in ("_low", "_high")]
                    current = _BlockMap(head, stage, dim, *span)
                current.extend(x[start : start + length])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=map_arrow)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row()], schema=map_arrow)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [0.0] * dim
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["_step"] > 1:
                    found.append({**{k: row[k] for k in keys}, "_block": row["_block"], "_entry": state})
                state = [_evaluate(row["at"][j], row["to"][j], row["slope"], state[j]) for j in range(dim)]
            yield pa.RecordBatch.from_pylist(found, schema=entry_arrow)

    rows = df.select(*keys, "_block", pos, "_low", "_high", col)
    maps = _sorted(rows, [*keys, "_block"], pos).mapInArrow(reduce_blocks, map_schema)
    return _sorted(maps, keys, "_block").mapInArrow(chain, entry_schema)


class _BlockMap:
    """State at the end of a block as a function of the state at its start, per lane.

    The moving average is followed from entry 0. The limiter is followed from both ends of
    the episode's range, which its state never leaves; lanes where the two runs end apart
    get the whole piecewise map.
    """

    def __init__(self, head: dict, stage: Stage, dim: int, low: float, high: float):
        self.head, self.stage = head, stage
        self.first = head["_block"] == 0
        slack = 1e-9 * (1.0 + abs(low) + abs(high))
        ends = [np.full(dim, low - slack), np.full(dim, high + slack)]
        self.state = np.stack(ends) if stage[0] == "limit" and not self.first else np.zeros((1, dim))
        self.steps = 0
        self.seen: list[np.ndarray] = []

    def extend(self, x: np.ndarray) -> None:
        runs, n = len(self.state), len(x)
        known = np.full(runs, not self.first or self.steps > 0)
        starts, lens = np.arange(runs) * n, np.full(runs, n)
        advance(np.tile(x, (runs, 1)), starts, lens, known, [self.state], [self.stage])
        self.steps += n
        if runs == 2:
            self.seen.append(x)

    def row(self) -> dict:
        kind, param = self.stage
        slope = 0.0 if self.first else (1.0 - param) ** self.steps if kind == "ema" else 1.0
        at, to = [[0.0] for _ in self.state[0]], [[v] for v in self.state[0].tolist()]
        if len(self.state) == 2:
            low, high = self.state
            for j, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                if a == b:
                    at[j], to[j] = [-FAR, FAR], [a, a]
                else:
                    inputs = np.concatenate([x[:, j] for x in self.seen]).tolist()
                    at[j], to[j] = _limit_points([0.0], [0.0], inputs, param)
        return {**self.head, "slope": slope, "at": at, "to": to}


def _limit_points(at: list[float], to: list[float], xs: Iterable[float], d: float) -> tuple[list[float], list[float]]:
    """Compose the limiter for inputs `xs` onto a monotone map with slopes 0 and 1 (1 outside).

    One step maps y to x + (y - x shrunk by d), so its corners lie at x - d and x + d; the
    map's corners move along and points inside straight pieces are dropped.
    """
    reach = d * (1.0 + 1e-12)
    for x in xs:
        for corner in (x - d, x + d):
            i = bisect_left(to, corner)
            if i < len(to) and to[i] == corner:
                continue
            if i == 0:
                at.insert(0, at[0] - (to[0] - corner))
            elif i == len(to):
                at.append(at[-1] + (corner - to[-1]))
            else:
                at.insert(i, at[i - 1] + (corner - to[i - 1]))
            to.insert(i, corner)
        to = [x if abs(x - y) <= reach else y + d if y < x else y - d for y in to]
        for i in range(len(to) - 2, 0, -1):
            if (to[i] == to[i - 1]) == (to[i] == to[i + 1]):
                del at[i], to[i]
    return at, to


def _evaluate(at: list[float], to: list[float], slope: float, state: float) -> float:
    if state <= at[0]:
        return to[0] + slope * (state - at[0])
    if state >= at[-1]:
        return to[-1] + slope * (state - at[-1])
    return float(np.interp(state, at, to))


def advance(x, starts, lens, known, states, stages) -> np.ndarray:
    """Filter all segments of a batch; each of `states` is left at its segments' last values.

    A segment without a known state starts with its first value unchanged.
    """
    counts = -(-lens // PIECE)
    owner = np.repeat(np.arange(len(lens)), counts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    cuts = np.stack([starts[owner] + rank * PIECE, np.minimum(PIECE, lens[owner] - rank * PIECE)])
    head, last = rank == 0, rank == counts[owner] - 1
    fresh = head & ~known[owner]
    for state, (kind, param) in zip(states, stages, strict=True):
        entry = state[owner].copy()
        if not head.all():
            follow = _average_entries if kind == "ema" else _limit_entries
            follow(x, cuts, rank, fresh, entry, param)
        x, ends = _run(x, cuts, fresh, entry, kind, param)
        state[:] = ends[last]
    return x


def _run(x, cuts, fresh, entry, kind, param) -> tuple[np.ndarray, np.ndarray]:
    """All pieces side by side, a step at a time; outputs and last states."""
    starts, lens = cuts
    order = np.argsort(-lens, kind="stable")
    starts, lens, fresh = starts[order], lens[order], fresh[order][:, None]
    state, out = entry[order], np.empty_like(x)
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
    for j, m in enumerate(active):
        rows = starts[:m] + j
        value, before = x[rows], state[:m]
        if kind == "ema":
            after = param * value + (1.0 - param) * before
        else:
            after = before + np.clip(value - before, -param, param)
        if j == 0:
            after = np.where(fresh[:m], value, after)
        state[:m] = after
        out[rows] = after
    ends = np.empty_like(state)
    ends[order] = state
    return out, ends


def _average_entries(x, cuts, rank, fresh, entry, alpha) -> None:
    """Entries of later pieces: what a run from 0 gives, plus the decayed entry before."""
    entry[rank > 0] = 0.0
    _, ends = _run(x, cuts, fresh, entry, "ema", alpha)
    for r in range(1, rank.max() + 1):
        here = np.flatnonzero(rank == r)
        entry[here] = ends[here - 1]
        ends[here] += (1.0 - alpha) ** cuts[1, here][:, None] * entry[here]


def _limit_entries(x, cuts, rank, fresh, entry, limit) -> None:
    """Entries of later pieces, from runs of the pieces before from both ends of a range.

    The range starts as that of all values. The ends of a run bound the entry of the next
    piece, so ranges narrow with every round, for all pieces at once; the few that have not
    closed after `ROUNDS` are followed one after the other.
    """
    later = np.flatnonzero(rank > 0)
    used = np.concatenate([x, entry[rank == 0]])
    low, high = entry.copy(), entry.copy()
    low[later], high[later] = used.min(axis=0), used.max(axis=0)
    for _ in range(ROUNDS):
        _, ends = _run(x, np.tile(cuts, 2), np.tile(fresh, 2), np.concatenate([low, high]), "limit", limit)
        low[later], high[later] = ends[later - 1], ends[len(rank) + later - 1]
        if (low == high).all():
            break
    entry[later] = low[later]
    closed = (low == high).all(axis=1)
    for r in range(1, rank.max() + 1 if not closed.all() else 0):
        open_ = np.flatnonzero((rank == r) & ~closed)
        if len(open_):
            _, entry[open_] = _run(x, cuts[:, open_ - 1], fresh[open_ - 1], entry[open_ - 1], "limit", limit)


def _segments(batches: Iterable[pa.RecordBatch]):
    """Starts and lengths of the episodes in a batch, and whether the first continues the batch before."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        first = np.asarray(batch.column("_step")) == 1
        resumed = not first[0]
        first[0] = True
        starts = np.flatnonzero(first)
        yield batch, starts, np.diff(np.append(starts, batch.num_rows)), resumed


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if flat.size != len(column) * dim:
        raise ValueError(f"expected vectors of {dim} elements")
    return flat.reshape(len(column), dim)


def _vectors(matrix: np.ndarray) -> pa.Array:
    n, dim = matrix.shape
    offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))
