"""Joins with small tables. A table is broadcast only after its rows were counted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.session import new_dir

MAX_BROADCAST_ROWS = 100_000
ROWS_PER_TASK = 1_000_000
HOT_KEYS = 50_000
SALTS = 64

#: Whether Spark removes the shuffle files of an execution when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, label: str = "settled") -> DataFrame:
    """The table written to the shared folder and read back.

    For derived tables that are counted or used several times: they are computed once, later
    counts come from file footers, and a lost executor costs no recomputation. The shuffle files that
    led to it are removed once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Counts at most rows + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] = (),
    rows: int = MAX_BROADCAST_ROWS,
    per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join a lookup table to many rows; `how` must keep or drop rows of `df` only.

    A derived table should be `settled` first, as it is counted. A small one is broadcast.
    With a larger one, keys that own more than `per_task` rows of `df` are found by a count;
    their table rows are repeated and their `df` rows split over the copies by a hash of the
    `spread` columns. Fewer than `HOT_KEYS` keys can be that hot, so their list is broadcast.
    """
    on = list(on)
    if is_small(table, rows):
        return df.join(F.broadcast(table), on, how)
    share = max(per_task, df.count() // HOT_KEYS)
    owned = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_owned")).filter(F.col("_owned") > share)
    hot = settled(owned.select(*on, F.ceil(F.col("_owned") / share).cast("int").alias("_copies")), "hot-keys")
    spread = list(spread) or [c for c, t in df.dtypes if not t.startswith("map")]
    part = F.xxhash64(*spread)
    unmatched = reduce(or_, [F.col(c).isNull() for c in on])
    salt = F.when(unmatched, F.pmod(part, F.lit(SALTS))).otherwise(F.coalesce(F.pmod(part, F.col("_copies")), F.lit(0)))
    salted = df.join(F.broadcast(hot), on, "left").withColumn("_salt", salt.cast("int")).drop("_copies")
    copies = (
        table.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1)))
        .drop("_copies")
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
