"""Registry of queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.fixtures import Fixtures
from armature.functions import vectors as V
from armature.functions.draws import Draw

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Fixtures], DataFrame]], Query]:
    """Register fn(fixtures) under a name, with the equivalent SQL."""

    def register(fn: Callable[[Fixtures], DataFrame]) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


#: Added before rounding, so that short decimals ending in 5 are no ties: engines that sum
#: in another order would fall on either side of them.
OFF_TIE = 1.2345678e-8


def r6(c: Column | str) -> Column:
    """Six decimals by integer rounding: stays in generated code and has no negative zero."""
    return F.floor((V.col(c) + F.lit(OFF_TIE)) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def r3(c: Column | str) -> Column:
    return F.floor((V.col(c) + F.lit(OFF_TIE * 1000)) * F.lit(1e3) + F.lit(0.5)) / F.lit(1e3)


def spread(vec: Column | str, prefix: str, dim: int, rounded: bool = True) -> list[Column]:
    """A vector as one column per element, which SQL engines hash alike."""
    return [(r6(x) if rounded else x).alias(f"{prefix}{i}") for i, x in enumerate(V.lanes(vec, dim))]


def md5_draw(seed: int, *keys: str) -> Draw:
    """Uniform draws every SQL engine can repeat: 48 bits of an md5 of seed, tag and keys."""

    def draw(tag: str) -> Column:
        text = F.concat_ws("/", F.lit(str(seed)), F.lit(tag), *[F.col(k).cast("string") for k in keys])
        bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
        return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))

    return draw


# ---- SQL text ----


def sql_draw(seed: int, tag: str, *keys: str) -> str:
    text = " || '/' || ".join([f"'{seed}'", f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST(('0x' || substr(md5({text}), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE)"


def sql_r6(expr: str, alias: str = "") -> str:
    return f"round(CAST({expr} AS DOUBLE) + {OFF_TIE!r}::DOUBLE, 6) + 0.0::DOUBLE" + (f" AS {alias}" if alias else "")


def sql_r3(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {OFF_TIE * 1000!r}::DOUBLE, 3) + 0.0::DOUBLE AS {alias}"


def sql_list(template: str, n: int, start: int = 0) -> str:
    return ", ".join(template.replace("{i}", str(i)) for i in range(start, start + n))


SQL_ARM = ", ".join(f"((event_id * {7 * j + 3}) % 2001) / 10.0::DOUBLE - 100.0::DOUBLE AS a{j}" for j in range(1, 5))
FRAMES = f"""
fx AS (
  SELECT 'events' AS dataset, user_id AS episode_index,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         user_id % 3 AS task_index, value AS a0, {SQL_ARM},
         ((event_id * 31) % 1001) / 10.0::DOUBLE AS a5, event_id, ts
  FROM events)"""
ACTION = "a0, a1, a2, a3, a4, a5"
ROUNDED_ACTION = ", ".join(sql_r6(f"a{i}", f"a{i}") for i in range(6))
WITH_STATE = f"""{FRAMES},
fs AS (
  SELECT *, {", ".join(f"coalesce(lag(a{i}) OVER w, a{i}) AS s{i}" for i in range(6))}
  FROM fx WINDOW w AS (PARTITION BY dataset, episode_index ORDER BY frame_index))"""
TWO_DATASETS = f"""{FRAMES},
ab AS (
  SELECT CASE WHEN episode_index % 2 = 0 THEN 'A' ELSE 'B' END AS dataset, episode_index // 2 AS episode_index,
         frame_index, task_index, {ACTION}, event_id FROM fx)"""
PREDICTIONS = f"""{FRAMES},
pr AS (
  SELECT dataset AS run, episode_index, frame_index // 16 AS chunk, CAST(frame_index % 16 AS INTEGER) AS step, {ACTION}
  FROM fx)"""
TASKS = """
tk AS (SELECT * FROM (VALUES (0, 'Pick up the bread slice and place it on the plate'),
  (1, 'Pick up the cheese slice and place it on the bread'), (2, 'Pick up the patty and place it on the cheese'))
  t(task_index, task))"""
DEMOS = f"""{FRAMES},
dm AS (
  SELECT dataset, episode_index, 'demo_' || episode_index AS demo, count(*) AS num_samples,
         CASE WHEN episode_index % 7 <> 0 THEN episode_index % 4 <> 0 END AS success,
         episode_index % 2 = 0 AS mimic_generated,
         CAST(episode_index % 5 AS INTEGER) AS src0, CAST(episode_index % 3 AS INTEGER) AS src1
  FROM fx GROUP BY dataset, episode_index)"""
EPISODE = "dataset, episode_index, frame_index"
