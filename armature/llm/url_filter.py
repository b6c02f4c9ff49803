"""URL filters: rules by host and path, and gradient-boosted trees for what no rule decides.

A rule names a host (meant with all subdomains) and the beginning of a path; the longest rule that fits decides. Every
other url is scored by gradient-boosted trees (Spark's own) on lexical features: length, depth, digit ratio, entropy,
parameter counts, and statistics of the host's suffix and of words. The statistics and the trees are trained
from labelled urls: a third of these gives the statistics, a third the trees, and the last third the threshold,
the smallest at which no more than `FALSE_SHARE` of wanted urls are blocked.

Everything is DataFrame functions within a row: no shuffle, no Python on executors. `made` gives labelled urls by
rule (`ROWS` of them, a parameter) for use where none have been collected; `train` takes any others.

Defined cases: a url that is null or has no `://` has an empty host and path and fits no rule; a null url is allowed, as
it leads nowhere; others without `://` are scored as they are. The host is what stands between the first `://` and the next
`/`, `?`, `#` or the end, port and user included; only A-Z are lower-cased. Rows are judged one by one, so
repeated rows give a row each, and null ids stay; very long urls are read whole; columns of the input other than the
named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host and beginning of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Labelled urls made by rule.
ROWS = 6000
#: Share of wanted urls that the threshold may block, and its least value.
FALSE_SHARE = 0.01
LEAST = 0.5
#: Words that keep a statistic, those that tell most.
WORDS = 400
TREES, DEPTH = 16, 3

#: Words of urls that filters let pass, and of those that they stop.
WANTED = (
    "news world science history music library school travel garden kitchen recipe weather city council museum forum docs wiki blog "
    "journal review photo art book film sport health family market energy nature ocean river mountain planet star code data open "
    "project software research university archive gallery theatre studio design paper letter story culture language english history "
    "math physics chemistry biology medicine law policy economy farm bakery cafe bike train bus map local village house home"
).split()
UNWANTED = (
    "casino poker slots jackpot roulette blackjack bet bets betting wager win winner lottery bonus vip pills pharmacy viagra cialis "
    "cheap discount replica rolex adult xxx porn sex cam cams nude escort dating loan loans payday credit debt forex crypto pump "
    "spam farm seo backlink ads ad ads track tracker tracking click clicks popunder banner affiliate offer offers prize claim free "
    "download crack keygen warez torrent serial hack weight loss miracle cure urgent verify account login secure update invoice"
).split()
SYLLABLES = "ka lo mi ra te nu so vi da re pel tor nim gan ster th tion nd er en an in on at".split()
SUFFIXES = "com org net edu de fr es io co info".split()
LURES = "xyz top click win loan biz info com net org".split()
SECTIONS = "en de es fr article post page tag about archive item p".split()


# ---- parts of a url ----


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(name + begin)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


# ---- features ----


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n == 0, 0.0).otherwise(bits)


def digits(text: Column) -> Column:
    """Share of digits."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.translate(text, "0123456789", ""))) / n)


def name_of(host: Column) -> Column:
    """The host without its last label."""
    return F.left(host, F.greatest(F.lit(0), F.length(host) - F.length(F.substring_index(host, ".", -1)) - 1))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), "[^a-z]+"), lambda w: w != "")


@dataclass(frozen=True)
class Statistics:
    """Log odds of being unwanted, by last label of the host and by word."""

    suffixes: tuple[tuple[str, float], ...]
    words: tuple[tuple[str, float], ...]

    @staticmethod
    def _map(pairs: tuple[tuple[str, float], ...]) -> Column:
        if not pairs:
            return F.lit(None).cast("map<string,double>")
        return F.map_from_arrays(F.split(F.lit(",".join(k for k, _ in pairs)), ","), F.split(F.lit(",".join(repr(v) for _, v in pairs)), ",").cast("array<double>"))

    def suffix(self, label: Column) -> Column:
        return F.coalesce(F.try_element_at(self._map(self.suffixes), label), F.lit(0.0))

    def total(self, words: Column) -> Column:
        known = self._map(self.words)
        return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))


def features(url: Column, host: Column, path: Column, known: Statistics) -> dict[str, Column]:
    """Features of a url that is not null."""
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    rest = F.concat_ws("/", path, query)
    return {
        "length": F.log1p(F.length(url).cast("double")),
        "host_length": F.length(host).cast("double"),
        "labels": F.size(labels).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "digits": digits(url),
        "host_digits": digits(host),
        "hyphens": (F.length(host) - F.length(F.translate(host, "-_", ""))).cast("double"),
        "host_entropy": entropy(host),
        "rest_entropy": entropy(rest),
        "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda s: s != "")).cast("double"),
        "suffix": known.suffix(F.element_at(labels, -1)),
        "host_words": known.total(words_of(name_of(host))),
        "rest_words": known.total(words_of(rest)),
    }


# ---- labelled urls ----


def made(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """url and whether it is unwanted, drawn by hashes of a row number from the fixed words above."""

    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    def pick(words: Sequence[str], salt: str) -> Column:
        return F.element_at(F.split(F.lit(" ".join(words)), " "), (draw(salt, len(words)) + 1).cast("int"))

    def number(salt: str, most: int) -> Column:
        return draw(salt, most).cast("string")

    def one_of(salt: str, *choices: Column) -> Column:
        out = choices[-1]
        for k, choice in enumerate(choices[:-1]):
            out = F.when(draw(salt, len(choices)) == k, choice).otherwise(out)
        return out

    nothing = F.lit("")
    coined = F.concat(*[pick(SYLLABLES, f"s{k}") for k in range(3)], one_of("s", nothing, pick(SYLLABLES, "s3")))
    good_name = one_of("g", coined, coined, pick(WANTED, "w0"), F.concat(pick(WANTED, "w0"), F.lit("-"), pick(WANTED, "w1")), F.concat(coined, F.lit("-"), pick(WANTED, "w1")), F.concat(pick(WANTED, "w0"), number("n", 99)))
    lure = F.concat(pick(UNWANTED, "u0"), one_of("j", F.lit("-"), F.lit("-"), F.lit("-"), F.lit(".")), pick(UNWANTED, "u1"))
    bad_name = one_of("b", lure, lure, F.concat(lure, F.lit("-"), pick(UNWANTED, "u2")), F.concat(pick(UNWANTED, "u0"), F.lit("-"), pick(SYLLABLES, "s0")), F.concat(pick(UNWANTED, "u0"), F.lit("-"), F.lit("x")), F.concat(lure, number("n", 999)))
    plain = one_of("p", F.concat(F.lit("/"), pick(SECTIONS, "c"), F.lit("/"), number("i", 9999), one_of("e", nothing, F.lit("/"), F.lit(".html"))), F.concat(F.lit("/"), number("y", 30), F.lit("/"), pick(WANTED, "w2"), F.lit("-"), pick(WANTED, "w3")), nothing, F.lit("/"))
    mixed = F.lower(F.concat(pick(LURES, "l2"), F.substring(F.hex(F.xxhash64("id", F.lit("d"))), 1, 12)))
    bad_name = F.when(draw("k", 4) == 0, mixed).otherwise(bad_name)
    # Some wanted pages speak of what is unwanted elsewhere.
    good_name = F.when(draw("o", 24) == 0, F.concat(pick(WANTED, "w0"), F.lit("-"), pick(UNWANTED, "u0"))).otherwise(good_name)
    bad_path = one_of("q", plain, plain, F.concat(F.lit("/"), pick(UNWANTED, "u3"), F.lit("/"), pick(UNWANTED, "u4"), F.lit("-"), number("i", 99999)))
    plain_query = one_of("t", nothing, nothing, F.lit("?page=2&ref=x"), F.lit("?utm_source=feed"), F.lit("#top"), F.concat(F.lit("?id="), number("v", 999)))
    bad_query = one_of("r", plain_query, F.concat(F.lit("?aff="), number("a", 99999), F.lit("&click="), F.hex(F.xxhash64("id", F.lit("h"))), F.lit("&sub=1&offer="), number("o", 999)))
    front = one_of("f", nothing, F.lit("www."), F.lit("m."), F.lit("blog."))
    middle = one_of("m", F.lit("."), F.lit(".example."))
    scheme = one_of("h", F.lit("http://"), F.lit("https://"))
    good = F.concat(scheme, front, good_name, middle, pick(SUFFIXES, "x"), plain, plain_query)
    bad = F.concat(scheme, front, bad_name, middle, one_of("z", pick(SUFFIXES, "x"), pick(LURES, "l")), bad_path, bad_query)
    return spark.range(rows, numPartitions=1).select("id", F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("url"), (F.col("id") % 2 == 1).alias("unwanted"))


# ---- training ----


@dataclass(frozen=True)
class Model:
    known: Statistics
    trees: GBTClassificationModel
    threshold: float


def _with_features(df: DataFrame, known: Statistics, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    held = features(F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path), known)
    ready = df.withColumns({f"_{name}": value for name, value in held.items()})
    return VectorAssembler(inputCols=[f"_{name}" for name in held], outputCol="_features").transform(ready).drop(*[f"_{name}" for name in held])


def statistics(labelled: DataFrame) -> Statistics:
    """Smoothed log odds from rows of host, path, url and unwanted."""
    counted = labelled.agg(F.sum(F.col("unwanted").cast("long")).alias("bad"), F.count("*").alias("n")).first()
    bad, n = counted["bad"] or 0, counted["n"]

    def odds(table: DataFrame, most: int) -> tuple[tuple[str, float], ...]:
        rows = table.groupBy("k").agg(F.sum(F.col("unwanted").cast("long")).alias("bad"), F.count("*").alias("n"))
        value = F.log(((F.col("bad") + 0.5) / F.lit(bad + 1.0)) / ((F.col("n") - F.col("bad") + 0.5) / F.lit(n - bad + 1.0)))
        kept = rows.withColumn("v", F.round(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), value)), 4)).orderBy(F.abs("v").desc(), "k").limit(most)
        return tuple(sorted((r["k"], r["v"]) for r in kept.collect()))

    suffixes = labelled.select(F.element_at(F.split("host", r"\."), -1).alias("k"), "unwanted").filter("k <> '' and k not like '%,%'")
    text = F.concat_ws(" ", name_of(F.col("host")), F.regexp_replace("url", r"(?s)\A.*?://[^/?#]*", ""))
    words = labelled.select(F.explode(F.array_distinct(words_of(text))).alias("k"), "unwanted")
    return Statistics(odds(suffixes, WORDS), odds(words, WORDS))


def train(labelled: DataFrame) -> Model:
    """Fit on rows of `url` and `unwanted` (boolean), a bounded table; parts of thirds are drawn by a hash of the url."""
    rows = labelled.filter("url is not null and unwanted is not null").select("url", "unwanted", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(3))).coalesce(1).cache()
    known = statistics(rows.filter("part = 0"))
    ready = _with_features(rows.filter("part > 0").withColumn("label", F.col("unwanted").cast("double")), known).cache()
    learner = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=32, seed=7, minInstancesPerNode=5)
    trees = learner.fit(ready.filter("part = 1"))
    scores = trees.transform(ready.filter("part = 2 and label = 0")).select(vector_to_array("probability")[1].alias("p")).orderBy("p")
    over = [r["p"] for r in scores.collect()]
    ready.unpersist()
    rows.unpersist()
    false = over[min(len(over) - 1, math.floor(len(over) * (1 - FALSE_SHARE)))] if over else LEAST
    return Model(known, trees, min(0.95, max(LEAST, false)))


# ---- judging ----


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (0 to 1, null where a rule decides) of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_decided": decided})
    scored = model.trees.transform(_with_features(rows, model.known))
    score = F.when(F.col("_decided").isNull() & F.col("url").isNotNull(), vector_to_array("probability")[1])
    scored = scored.withColumn("score", score)
    learnt = F.when(F.col("score") > model.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_decided", learnt).alias("verdict"), "score")
