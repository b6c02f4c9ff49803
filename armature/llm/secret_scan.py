"""Secret scans: fixed patterns, and two character Markov models for what patterns don't know.

Patterns find three kinds: an assignment to a name such as password or token, an access key and
long hexadecimal runs. The method adds a fourth kind, `markov`: a run of key characters is scored by two character
Markov models, one of random strings and one of ordinary identifiers, both counted from labelled samples;
the log-likelihood ratio, in total and per character, must pass a threshold. Added spans never
overlap those of patterns.

Everything is DataFrame functions on arrays within a row: no shuffle, no Python on executors. The models
are a table of 128 by 128 log ratios, whatever the size of the samples.

Spans are in code points, end exclusive. Defined cases: a null text is empty and has no spans; rows are judged
one by one, so repeated rows and null ids give a row each; columns of the input other than the named ones
are ignored; an empty table gives an empty result; without samples no span is added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

#: Log-likelihood ratio that a run must reach, in total and per character.
TOTAL = 12.0
PER_CHARACTER = 0.45
#: Documents whose words are taken as ordinary, and their characters.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 4000
RANDOM_SAMPLES = 3000

#: Parts of ordinary identifiers.
PARTS = (
    "get set add remove update delete create find load save read write open close start stop run init build make parse format "
    "user account order item product price total count index value key name type status state date time day month year size length "
    "file path folder url host port server client request response message event handler manager service factory builder provider "
    "data table row column field record query result list map array string number text line word page document image video audio "
    "config option setting param default current previous next first last max min average sum error warning info debug log test "
    "customer address city country phone email payment invoice shipping discount category session cache queue worker thread task job"
).split()

SPAN = "struct<start:long,end:long,i:int>"


def spans(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern, leftmost and not overlapping, and the stretches between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def placed(matches: Column, gaps: Column) -> Column:
    """start, end and number of each match, from its text and those of the stretches."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.size(acc["out"]).alias("i"))
        return F.struct(end.cast("long").alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), begin, step, lambda acc: acc["out"])


# ---- models ----


@dataclass(frozen=True)
class Ratios:
    """Log ratios of both models for each pair of characters, row by row of the first."""

    table: tuple[float, ...]

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.5f}" for x in self.table)), ",").cast("array<double>")


def fit(samples: DataFrame, smoothing: float = 0.5) -> Ratios | None:
    """Count both models from rows of string and label (1: random, 0: ordinary).

    Only counts of pairs of ASCII characters reach the driver: at most 2 * 128 * 128 rows.
    """
    import math

    s = F.col("string")
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.struct(F.ascii(F.substr(s, i, F.lit(1))).alias("a"), F.ascii(F.substr(s, i + 1, F.lit(1))).alias("b")))
    counted = samples.filter((F.length("string") > 1) & ~s.rlike(r"[^\x00-\x7F]")).select("label", F.explode(pairs).alias("p")).groupBy("label", "p.a", "p.b").count().collect()
    n: dict[int, dict[tuple[int, int], int]] = {0: {}, 1: {}}
    for r in counted:
        n[r["label"]][r["a"], r["b"]] = r["count"]
    if not n[0] or not n[1]:
        return None
    used = sorted({a for side in n.values() for a, _ in side} | {b for side in n.values() for _, b in side})
    table = [0.0] * (128 * 128)
    sums = {label: {a: sum(c for (x, _), c in side.items() if x == a) for a in used} for label, side in n.items()}
    for a in used:
        for b in used:
            chance = [(n[label].get((a, b), 0) + smoothing) / (sums[label][a] + smoothing * len(used)) for label in (0, 1)]
            table[a * 128 + b] = math.log(chance[1] / chance[0])
    return Ratios(tuple(table))


def random_strings(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """Labelled random strings by rule: base64, hexadecimal, letters and digits in upper or mixed case."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest("b")))
    mixed = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(digest("u"))), "[^A-Za-z0-9]", ""))
    url_safe = F.translate(F.base64(F.unhex(digest("s"))), "+/", "-_")
    kind = F.col("id") % 5
    return spark.range(n).select(F.when(kind == 0, base64).when(kind == 1, mixed).when(kind == 2, upper).when(kind == 3, url_safe).otherwise(digest("h")).alias("string"), F.lit(1).alias("label"))


def ordinary_strings(spark: SparkSession, n: int = 4 * RANDOM_SAMPLES) -> DataFrame:
    """Labelled ordinary strings by rule: identifiers in usual styles, numbers, rulers."""
    parts = F.array(*[F.lit(p) for p in PARTS])
    word = lambda k: F.get(parts, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))).cast("int"))
    words = [word(k) for k in range(4)]
    styles = [
        F.concat_ws("_", *words),
        F.concat(words[0], *[F.initcap(w) for w in words[1:]]),
        F.upper(F.concat_ws("_", *words[:3])),
        F.concat_ws("-", *words),
        F.concat_ws("/", *words),
        F.concat(F.initcap(words[0]), F.initcap(words[1]), F.initcap(words[2]), (F.col("id") % 100).cast("string")),
        F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string"), 16, "0"),
        F.repeat(F.get(F.array(*[F.lit(c) for c in "-=_/+"]), (F.col("id") % 5).cast("int")), 24),
        F.concat(words[0], words[1], words[2], words[3]),
    ]
    out = styles[0]
    for k, s in enumerate(styles):
        out = F.when(F.col("id") % len(styles) == k, s).otherwise(out)
    return spark.range(n).select(out.alias("string"), F.lit(0).alias("label"))


def ordinary_words(docs: DataFrame, doc_id: str, text: str, docs_read: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Words of letters alone in a bounded sample of documents, as ordinary, in their own and in upper case, alone and in threes."""
    # The least hashes are sampled; a task sends no more rows than a few times the sample in all.
    share = 4 * docs_read / max(1, docs.count())
    key = F.md5(F.col(doc_id).cast("string"))
    likely = docs if share >= 1 else docs.filter(key.isNull() | (key <= f"{int(share * 2**32):08x}"))
    drawn = likely.filter(F.col(text).isNotNull()).select(F.md5(F.col(doc_id).cast("string")).alias("k"), F.substring(F.col(text), 1, chars).alias("t")).orderBy("k", "t").limit(docs_read)
    words = F.filter(F.split("t", r"[^\p{L}]+"), lambda w: w.rlike("^[A-Za-z]{3,}$"))
    listed = drawn.select(words.alias("w"))
    joined = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size("w") / 3).cast("int"), F.lit(1))), lambda i: F.concat_ws("", F.slice("w", i * 3 - 2, 3)))
    one = listed.select(F.explode(F.concat("w", joined)).alias("string"))
    return one.select(F.explode(F.array("string", F.upper("string"))).alias("string"), F.lit(0).alias("label"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Ratios | None:
    spark = docs.sparkSession
    return fit(random_strings(spark).unionByName(ordinary_strings(spark)).unionByName(ordinary_words(docs, doc_id, text)))


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string of ASCII characters; its codes are taken once, so the work grows with its length."""
    codes = F.transform(F.split(token, ""), F.ascii)
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        more = F.when(acc["before"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["before"] * 128 + code))
        return F.struct(code.alias("before"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


# ---- scan ----


def scan(docs: DataFrame, ratios: Ratios | None, text: str = "text", total: float = TOTAL, per_character: float = PER_CHARACTER) -> DataFrame:
    """`docs` with found: all spans as kind (number in KINDS), start, end and score, by start and kind."""
    kept = docs.drop("found")
    t = F.coalesce(F.col("_t"), F.lit(""))
    row = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    empty = F.array().cast(f"array<{SPAN}>")
    out = row
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN)):
        matches, gaps = spans(t, pattern)
        has = t.rlike(pattern)
        out = out.withColumn(f"_{name}", F.when(has, matches)).withColumn(f"_{name}_at", F.when(F.col(f"_{name}").isNotNull(), placed(F.col(f"_{name}"), gaps)).otherwise(empty))
    values = F.when(F.size("_assign") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)))
    out = out.withColumn("_values", values).withColumn("_assign_at", F.filter("_assign_at", lambda s: F.length(F.get(F.col("_values"), s["i"])) >= ASSIGN_LEAST))

    def listed(name: str, number: int) -> Column:
        return F.transform(f"_{name}_at", lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("score")))

    out = out.withColumn("_base", F.array_sort(F.concat(listed("assign", 0), listed("access", 1), listed("hex", 2))))
    if ratios is None:
        return out.select("_row.*", F.col("_base").alias("found"))
    free = F.filter("_run_at", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    scored = F.transform("_free", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), ratio(F.get(F.col("_run"), s["i"]), F.col("_table")).alias("score")))
    out = out.withColumn("_free", free).withColumn("_table", F.when(F.size("_free") > 0, ratios.column())).withColumn("_scored", F.when(F.size("_free") > 0, scored))
    added = F.filter("_scored", lambda s: (s["score"] >= total) & (s["score"] >= per_character * (s["end"] - s["start"])))
    return out.select("_row.*", F.when(F.size("_free") > 0, F.array_sort(F.concat("_base", added))).otherwise(F.col("_base")).alias("found"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
