"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that repeats itself, up to a largest number
of passes. A copy of a document has a virtual finish time: the words its source has queued up to
its end, divided by the source's weight. Copies are range-sorted by that time over all sources and
taken until the budget is used up. As every source is served in proportion to its weight until its passes
are over, the words taken come near the targets, which are found beforehand by resharing what
a source at its limit leaves (`targets`).

Everything is DataFrame expressions. A source may hold most rows: its order is cut into slices by the
shuffle key, sums of slices give each slice its base, and only a slice is ever sorted together. The global
order is cut into buckets of virtual time the same way, and only the bucket in which the budget ends is sorted.

Defined cases: a null text has size 0, a null source is a source of its own, last in order; documents of size
0 are never taken; with no words at all every target is 0; repeated rows are documents of their own;
null ids are shuffled like others. An empty table gives an empty result. Columns of the input are
kept; the added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.plans.lookups import settled

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PASSES = 3
SEED = "mix"
#: Rows sorted together, about.
ROWS_PER_SLICE = 4_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _slices(rows: int) -> int:
    """A power of two, so that slices are runs of the order."""
    return 1 << min(31, max(0, (max(rows, 1) // ROWS_PER_SLICE).bit_length()))


def _slice(key: Column, n: int) -> Column:
    """Slice of a hexadecimal shuffle key; slices ascend with the key."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 33 - n.bit_length()).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """source, source_size -> with place (from 0), weight, level and target; one row per source.

    Weights repeat over the sources in code point order, null last. A target is weight * level, at most
    `passes` times the source's size; the level is such that targets add up to `share` of all sizes.
    The windows run over one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(in_order) - 1).withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
    limit = F.col("source_size") * passes
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    everything = Window.partitionBy()
    filled = (
        placed.withColumn("limit", limit)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("before", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("budget") - F.col("before")) / F.col("left"))
        .withColumn("full", F.col("limit") <= F.col("weight") * F.col("level_here"))
    )
    open_ = F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "place", F.col("level_here").alias("level")))
    level = F.min(open_).over(everything)["level"]
    return filled.withColumn("level", level).withColumn(
        "target",
        F.when(F.col("level").isNull() | (F.col("limit") <= F.col("weight") * F.col("level")), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level")),
    ).select("source", "source_size", "place", "weight", "level", "target")


@dataclass
class Mix:
    """What a mix takes: bases of slices, and the last virtual time (with the source's place) that is taken."""

    offsets: DataFrame
    slices: int
    passes: int
    seed: str
    last_time: float
    last_place: int


def _timed(rows: DataFrame, offsets: DataFrame, slices: int) -> DataFrame:
    """Rows of source, key, doc_id, size with the words their source has queued up to their end in one pass."""
    cut = rows.withColumn("_slice", _slice(F.col("_key"), slices))
    within = Window.partitionBy("_source", "_slice").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    queued = cut.withColumn("_queued", F.sum("_size").over(within)).alias("r")
    o = offsets.alias("o")
    on = F.col("r._source").eqNullSafe(F.col("o.source")) & (F.col("r._slice") == F.col("o.slice"))
    return queued.join(o, on, "inner").select("r.*", "o.source_size", "o.place", "o.weight", "o.level", "o.target", (F.col("o.base") + F.col("r._queued")).alias("_end"))


def _time(turn: int) -> Column:
    return (F.col("source_size") * turn + F.col("_end")) / F.col("weight")


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES, share: float = 1.0, seed: str = SEED) -> Mix:
    """Find what to take from rows of _source, _key and _size, which are read several times (settle them first).

    The driver sees two rows: the count, and where the budget ends.
    """
    count = rows.count()
    slices = _slices(count)
    by_slice = rows.groupBy(F.col("_source").alias("source"), _slice(F.col("_key"), slices).alias("slice")).agg(F.sum("_size").alias("words"))
    of_source = targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights, passes, share).alias("t")
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    based = by_slice.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("b")
    offsets = settled(based.join(of_source, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.place", "t.weight", "t.level", "t.target"), "mix-offsets")

    timed = _timed(rows.filter(F.col("_size") > 0), offsets, slices)
    copies = timed.select("_size", "place", F.coalesce("level", F.lit(1.0)).alias("level"), F.explode(F.array(*[_time(k) for k in range(passes)])).alias("time"))
    # Beyond twice the level nothing is taken but in tiny mixes, so all of that is one bucket.
    bucket = F.least(F.floor(F.col("time") / F.col("level") * slices), F.lit(2 * slices)).cast("int")
    copies = settled(copies.select("_size", "place", "time", bucket.alias("bucket")), "mix-times")
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = copies.groupBy("bucket").agg(F.sum("_size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    # The first bucket that the budget does not cover whole; one row reaches the driver.
    budget = offsets.groupBy("source").agg(F.max("source_size").alias("n")).agg(F.floor(F.sum("n") * F.lit(share)).cast("long").alias("budget"))
    ends = sums.crossJoin(F.broadcast(budget)).filter(F.col("upto") > F.col("budget")).orderBy("bucket").limit(1).collect()
    if not ends:
        return Mix(offsets, slices, passes, seed, float("inf"), 0)
    at, left = ends[0]["bucket"], ends[0]["budget"] - (ends[0]["upto"] - ends[0]["words"])
    run = Window.orderBy("time", "place").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        copies.filter(F.col("bucket") == at)
        .withColumn("taken", F.sum("_size").over(run))
        .filter(F.col("taken") <= left)
        .agg(F.max(F.struct("time", "place")).alias("last"))
        .first()["last"]
    )
    if last is None:
        # The bucket's first copy is already too long: all of the earlier buckets, which end before its times.
        last = copies.filter(F.col("bucket") < at).agg(F.max(F.struct("time", "place")).alias("last")).first()["last"]
    return Mix(offsets, slices, passes, seed, last["time"] if last else -1.0, last["place"] if last else 0)


def keyed(docs: DataFrame, source: str, doc_id: str, text: str, seed: str) -> DataFrame:
    return docs.withColumns({"_source": F.col(source).cast("string"), "_key": shuffle_key(doc_id, seed), "_size": words(text)})


def apply(rows: DataFrame, mixed: Mix) -> DataFrame:
    """Keyed rows with source_size, target and copies: how often the mix takes each."""
    timed = _timed(rows, mixed.offsets, mixed.slices)
    takes = [F.when(F.struct(_time(k).alias("time"), F.col("place")) <= F.struct(F.lit(mixed.last_time), F.lit(mixed.last_place)), 1).otherwise(0) for k in range(mixed.passes)]
    return timed.withColumn("copies", F.when(F.col("_size") > 0, sum(takes[1:], takes[0])).otherwise(0)).drop("place", "weight", "level", "_slice", "_queued", "_end")


def decisions(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", weights: Sequence[float] = WEIGHTS, passes: int = PASSES, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies of every document, without texts."""
    rows = settled(keyed(docs.select(doc_id, source, text), source, doc_id, text, seed).select(F.col(doc_id).alias("doc_id"), "_source", "_key", "_size"), "mix-sizes")
    return apply(rows, plan(rows, weights, passes, share, seed)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "copies")


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", weights: Sequence[float] = WEIGHTS, passes: int = PASSES, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of `docs`, all columns, each as often as it is taken."""
    rows = settled(keyed(docs.select(doc_id, source, text), source, doc_id, text, seed).select("_source", "_key", "_size"), "mix-sizes")
    mixed = plan(rows, weights, passes, share, seed)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("_s"), F.col(doc_id).alias("_d"), F.col(text).alias("_t"))
    full = keyed(kept, "_s", "_d", "_t", seed).select("_row", "_source", "_key", "_size")
    taken = apply(full, mixed).filter(F.col("copies") > 0)
    return taken.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
