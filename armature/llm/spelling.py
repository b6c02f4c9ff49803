"""Spelling variants: words one error apart, found with bidirectional FM-indexes.

Words are counted over all texts. Two words are near if one symbol put in, left out or replaced makes one the other.
Then either half of a word also stands, exact and at the same end, in its near word. So every word is indexed under the
beginnings and the ends that may be such a half (two of each), and asks once for each of its own halves: words that
share a half come into the same shard by its hash. A shard holds some `SHARD` entries as a bidirectional FM-index (a file
in the shared folder); the words that ask stream past it and search it: their half exactly, then over the other half
with one error. A half that very many words share is dealt over several indexes, all of which its words ask.

A word's form is its most frequent near word, if that is at least `RATIO` times as frequent; following
forms to the last gives its root. Counts at least double at each step, so paths are short; they are halved in rounds.

Defined cases: a null text has no words; a null id is written as nothing before the colon in the drawn hash; repeated
rows count as often as they stand; ties between near words go to the first in code-point order; texts are read whole; an
empty table, or one without frequent words, gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.llm.blobs import fetch, store
from armature.llm.fm_index import Index
from armature.plans.lookups import lookup_join, settled
from armature.session import new_dir

#: Runs of letters that are words, after A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]+"
#: Code points and occurrences of a word, and how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Entries of an index, and of one half in it.
SHARD = 40_000
SAME_HALF = 10_000
ROUNDS = 64


# ---- words ----


def runs(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))


def misspelt(doc_id: Column, run: Column, every: int | None = 97) -> Column:
    """The run, less one symbol where the checksum of id and run says so."""
    if every is None:
        return run
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = 97) -> DataFrame:
    """word and n, its occurrences, of all frequent words. Counts are added up before they are shuffled."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs(F.col(text))).alias("run"))
    words = found.select(misspelt(F.col("doc_id"), F.col("run"), every).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---- near words ----


def _half(word: Column, size: Column, side: str) -> Column:
    part = F.left(word, size) if side == "l" else F.right(word, size)
    return F.concat(F.lit(side), part)


def _asked(word: str = "word") -> Column:
    """Side and key of both halves of a word."""
    n = F.length(word)
    left = F.floor(n / 2).cast("int")
    return F.array(F.struct(F.lit("l").alias("side"), _half(F.col(word), left, "l").alias("key")), F.struct(F.lit("r").alias("side"), _half(F.col(word), n - left, "r").alias("key")))


def _filed(word: str = "word") -> Column:
    """Keys under which a word is indexed: halves of words as long, one longer or one shorter."""
    n = F.length(word)
    sizes = [F.floor((n + d) / 2).cast("int") for d in (-1, 0, 1)]
    back = [n + d - F.floor((n + d) / 2).cast("int") for d in (-1, 0, 1)]
    return F.array_distinct(F.array(*[_half(F.col(word), s, "l") for s in sizes], *[_half(F.col(word), s, "r") for s in back]))


@lru_cache(2)
def _index(folder: str, name: str) -> tuple[Index, np.ndarray, np.ndarray]:
    index, more = Index.load(fetch(folder, name))
    words = more["words"].tobytes().decode().split("\0") if len(more["words"]) else []
    return index, np.array(words, object), more["counts"]


def near_words(words: DataFrame, shard: int = SHARD, same_half: int = SAME_HALF) -> DataFrame:
    """word, n, near, near_n of all ordered pairs one error apart, and a row without near word for every word.

    `words` holds distinct words and n, and is read several times.
    """
    spark = words.sparkSession
    folder = new_dir(spark, "fm-index")
    filed = words.select("word", "n", F.explode(_filed()).alias("key"))
    entries = settled(filed.groupBy("key").agg(F.count("*").alias("entries")), "halves")
    total = entries.agg(F.sum("entries")).first()[0] or 0
    shards = max(1, -(-total // shard))
    hot = settled(entries.filter(F.col("entries") > same_half).select("key", F.ceil(F.col("entries") / same_half).cast("int").alias("copies")), "hot-halves")

    def shard_of(part: Column) -> Column:
        # Parts of a frequent half lie in shards of their own choice.
        return F.pmod(F.when(part > 0, F.xxhash64("key", part)).otherwise(F.xxhash64("key")), F.lit(shards)).cast("int")

    copies = F.coalesce("copies", F.lit(1))
    mine = F.pmod(F.xxhash64("word"), copies).cast("int")
    placed = lookup_join(filed, hot, ["key"], "left", spread=["word"]).select("word", "n", shard_of(mine).alias("shard"))

    def grow(table: pa.Table) -> pa.Table:
        own = dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        order = sorted(own)
        raw = Index.build(order).save(words=np.frombuffer("\0".join(order).encode(), np.uint8), counts=np.array([own[w] for w in order], np.int64))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "file": [store(folder, raw)]})

    built = settled(placed.groupBy("shard").applyInArrow(grow, "shard int, file string"), "fm-indexes")

    asking = lookup_join(words.select("word", "n", F.inline(_asked())), hot, ["key"], "left", spread=["word"])
    sent = asking.withColumn("salt", mine).withColumn("part", F.explode(F.sequence(F.lit(0), copies - 1)))
    sent = sent.select("word", "n", "side", shard_of(F.col("part")).alias("shard"), F.expr("side = 'l' and part = 0").alias("first"), "salt")
    named = lookup_join(sent, built, ["shard"], "inner", spread=["word"])
    tasks = max(spark.sparkContext.defaultParallelism, min(2 * shards, 20_000))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = np.array(batch.column("word").to_pylist(), object)
            n = batch.column("n").to_numpy()
            # A row for the word itself, once.
            own = batch.column("first").to_numpy(zero_copy_only=False)
            yield _pairs(word[own], n[own], None, None)
            # Rows of one file and side lie together.
            name, side = np.array(batch.column("file").to_pylist(), object), np.array(batch.column("side").to_pylist(), object)
            cuts = np.flatnonzero((name[1:] != name[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(name)], strict=True):
                if a == b:
                    continue
                index, words_of, counts = _index(folder, name[a])
                q, w = index.near(word[a:b].tolist(), side[a])
                yield _pairs(word[a:b][q], n[a:b][q], words_of[w], counts[w])

    ordered = named.repartition(tasks, "shard", "salt").sortWithinPartitions("file", "side")
    return ordered.select("word", "n", "side", "first", "file").mapInArrow(look, "word string, n long, near string, near_n long")


def _pairs(word: np.ndarray, n: np.ndarray, near: np.ndarray | None, near_n: np.ndarray | None) -> pa.RecordBatch:
    count = len(word)
    columns = [
        pa.array(word.tolist(), pa.string()),
        pa.array(n, pa.int64()),
        pa.nulls(count, pa.string()) if near is None else pa.array(near.tolist(), pa.string()),
        pa.nulls(count, pa.int64()) if near_n is None else pa.array(near_n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])


# ---- forms and roots ----


def forms(pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, n, n_near, form_n. A word has at most as many near words as its length and the alphabet allow."""
    other = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))
    grouped = pairs.groupBy("word").agg(F.max("n").alias("n"), F.collect_set(other).alias("others"))
    best = F.array_min("others")
    often = -best["less"] >= ratio * F.col("n")
    return grouped.select("word", F.when(often, best["near"]).alias("form"), "n", F.size("others").cast("long").alias("n_near"), F.when(often, -best["less"]).alias("form_n"))


def rooted(table: DataFrame) -> DataFrame:
    """The table of words and forms with each word's root."""
    links = settled(table.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = settled(lookup_join(links, ahead, ["root"], "left", spread=["word"]).select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "roots")
        if links.filter("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("roots did not settle")
    return table.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = 97, shard: int = SHARD, same_half: int = SAME_HALF) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of the texts."""
    words = settled(vocabulary(docs, doc_id, text, every), "vocabulary")
    found = settled(forms(near_words(words, shard, same_half)), "forms")
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")
