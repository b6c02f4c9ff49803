"""Registered queries of the operators for training data, each with its SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.llm import decontaminate, hard_negatives, jaccard_join, langid, license_scan, mixing, mtree, reshard, secret_scan, spelling, suffix_dedup, token_files, url_filter
from armature.plans.lookups import settled
from armature.session import new_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Where the tokenizer file is; a parameter of the job.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 2 language identification ----


def remainder(doc_id: str = "doc_id"):
    """Fold of a document, 0 to 4; fold 0 is never learnt from. Null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def language_model(docs: DataFrame) -> langid.Model | None:
    return langid.train(docs.filter(remainder() != 0))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score", "rejected")


# ---- 4 token files ----


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, TOKENIZER, end_id=2)
    return token_files.read_documents(spark, out)


# ---- 5 mixing ----

OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS BIGINT) AS size,
         md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS most,
         CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
f AS (
  SELECT *, (budget - coalesce(CAST(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here FROM w),
v AS (SELECT level_here AS level FROM f WHERE most > weight * level_here ORDER BY most / weight, place LIMIT 1),
t AS (
  SELECT w.*, CASE WHEN v.level IS NULL OR most <= weight * v.level THEN CAST(most AS DOUBLE) ELSE weight * v.level END AS target
  FROM w LEFT JOIN v ON true),
q AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends, row_number() OVER () AS r FROM d),
c AS (
  SELECT q.r, q.size, t.budget, sum(q.size) OVER (ORDER BY (e.turn * t.source_size + q.ends) / t.weight, t.place ROWS UNBOUNDED PRECEDING) AS taken_so_far
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source CROSS JOIN range(3) e(turn) WHERE q.size > 0),
n AS (SELECT r, count(*) AS copies FROM c WHERE taken_so_far <= budget GROUP BY r)
SELECT q.doc_id, q.size, t.source_size, t.target, CAST(q.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON q.r = n.r
"""


@query("op5_mix_sources", OP5_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# ---- 10 benchmark decontamination ----


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- 9 n-gram Jaccard join ----


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM w),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * common >= 75 * (len(x.g) + len(y.g) - common)),
n AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, n.b FROM r JOIN n ON r.o = n.a)
SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(r.o) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""


@query("op9_jaccard_join", OP9_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


# ---- 3 suffix-array dedup ----


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


# ---- 8 secret scan ----


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs)).drop("text")
    base = F.filter("found", lambda s: s["kind"] < 3)

    def count(k: int, name: str):
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("found")).alias("spans"))


# ---- 1 licence scan ----


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.train(spark)).drop("notice")


# ---- 6 exact top-k search ----

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op6_top_k", OP6_SQL)
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = settled(mtree.prepared(table(spark, sf_dir, "embeddings")), "vectors")
    return mtree.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


# ---- 7 resharding ----

#: Where documents lie before: shards by source, of which one is large.
OLD_SHARDS = 12


@query("op7_reshard")
def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old_path, new_path = new_dir(spark, "shards-old"), new_dir(spark, "shards-new")
    old_shard = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS)).cast("int")
    reshard.write_old(table(spark, sf_dir, "documents").withColumn("old_shard", old_shard), old_path)
    layout = reshard.plan(reshard.read_old(spark, old_path), shards=16)
    found = reshard.with_slots(reshard.rewrite(spark, old_path, new_path, layout))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


# ---- 11 spelling variants ----

# The checksum (CRC-32, polynomial 0xEDB88320) has no function in this dialect: its table and bytes are folded with lists.
OP11_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(b AS BIGINT))) AS tab),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
d AS (SELECT doc_id, run, count(*) AS times FROM r GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM d),
c AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_transform(range(len(h) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)),
    lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT))) AS crc
  FROM x, t),
w AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM c),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM e a JOIN v b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM e a JOIN v b ON a.less = b.word),
g AS (
  SELECT v.word, any_value(v.n) AS n, count(near) AS n_near, min(near) FILTER (near_n = most) AS best, any_value(most) AS most
  FROM v LEFT JOIN (SELECT *, max(near_n) OVER (PARTITION BY word) AS most FROM p) p ON v.word = p.word GROUP BY v.word),
f AS (SELECT word, CASE WHEN most >= 2 * n THEN best END AS form, n, n_near, CASE WHEN most >= 2 * n THEN most END AS form_n FROM g),
s AS MATERIALIZED (SELECT word, form FROM f WHERE form IS NOT NULL),
z AS (
  WITH RECURSIVE y AS (SELECT word, form AS tip FROM s UNION ALL SELECT y.word, s.form FROM y JOIN s ON y.tip = s.word)
  SELECT word, tip AS root FROM y WHERE tip NOT IN (SELECT word FROM s))
SELECT f.word, form, coalesce(z.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON f.word = z.word
"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# ---- 12 URL filter ----


@query("op12_url_filter")
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(url_filter.made(spark)))


# ---- 13 hard negatives ----

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = settled(hard_negatives.prepared(table(spark, sf_dir, "embeddings"), label), "vectors")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)
