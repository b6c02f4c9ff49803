"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its character n-grams (1 to 4 bytes, word borders
included), hashed to a table of fixed size. A linear layer and a softmax follow, as in shallow
text classifiers. Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, then one temperature and one rejection threshold are fitted on labelled rows
kept out of the descent. As the average is linear, embeddings and linear layer fold into one table of
scores per n-gram, and prediction is one pass over the bytes.

Null and empty texts and texts without a letter are `und` with score 0 and are rejected. Rows are
kept as they are: repeated rows and null ids give a row each. Without any labelled row
every text is `und`. Columns of the input other than the ones named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from armature.llm.textarrays import LOWER, SPACE, flat, pieces, unused

BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3, 4)
#: Bounds of the training sample: rows, and bytes of a row (evenly spaced pieces of longer texts).
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 4096
SAMPLE_PIECES = 4
#: Steps of the descent, and rows of a step.
STEPS = 400
BATCH = 32
RATE = 0.5
#: Bytes of a text that are scored at once.
CHUNK = 1 << 20
#: Share of labelled calibration rows that the threshold may reject.
REJECT = 0.001


@dataclass
class Model:
    """Scores per n-gram bucket and class, bias, classes, temperature, rejection threshold."""

    table: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float
    threshold: float


def ngrams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of each n-gram that starts at each byte; white space runs count as word borders."""
    low = np.where(SPACE[data], np.uint8(32), LOWER[data]).astype(np.uint32)
    out, h = [], np.zeros(len(low), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(low) < n:
            break
        h = (h[: len(low) - n + 1] * np.uint32(0x01000193)) ^ (low[n - 1 :] + np.uint32(n))
        if n in ORDERS:
            g = h * np.uint32(0x9E3779B1)
            g ^= g >> np.uint32(15)
            out.append((g * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 16))
    return out


def counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's n-grams and their shares."""
    grams = ngrams(data)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    buckets, n = np.unique(np.concatenate(grams), return_counts=True)
    return buckets.astype(np.int64), (n / n.sum()).astype(np.float32)


def sampled(text: str) -> np.ndarray:
    """A text for training: whole, or evenly spaced pieces of a long one."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) <= SAMPLE_BYTES:
        return data
    part = SAMPLE_BYTES // SAMPLE_PIECES
    return np.concatenate([data[int(s) : int(s) + part] for s in np.linspace(0, len(data) - part, SAMPLE_PIECES)])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Train on labelled texts; every fifth text is kept for calibration."""
    classes = sorted(set(langs))
    if not classes:
        return None
    known = {c: i for i, c in enumerate(classes)}
    rows = [counts(sampled(t)) for t in texts]
    wanted = np.array([known[x] for x in langs])
    kept = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    rng = np.random.Generator(np.random.PCG64(seed))
    embed = (rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM
    linear, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    train = np.flatnonzero(~kept)
    for step in range(STEPS):
        picked = train[rng.integers(0, len(train), BATCH)]
        rate = np.float32(RATE * (1 - step / STEPS))
        grad_table: dict[str, list[np.ndarray]] = {"at": [], "by": []}
        grad_linear, grad_bias = np.zeros_like(linear), np.zeros_like(bias)
        for i in picked:
            at, share = rows[i]
            hidden = share @ embed[at]
            error = softmax(hidden @ linear + bias)
            error[wanted[i]] -= 1
            grad_linear += np.outer(hidden, error)
            grad_bias += error
            grad_table["at"].append(at)
            grad_table["by"].append(share[:, None] * (linear @ error)[None, :])
        linear -= rate * grad_linear
        bias -= rate * grad_bias / len(picked)
        np.subtract.at(embed, np.concatenate(grad_table["at"]), rate * np.concatenate(grad_table["by"]) * len(classes))
    table = (embed @ linear).astype(np.float32)
    held = np.flatnonzero(kept) if kept.any() else train
    logits = np.array([share @ table[at] + bias for at, share in (rows[i] for i in held)])
    grid = np.geomspace(0.02, 5.0, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), wanted[held]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = np.sort(softmax(logits / temperature).max(axis=1))
    # Calibrated on ordinary texts: at most this share of them may fall below the threshold.
    threshold = float(min(sure[int(REJECT * len(sure))] * 0.75, 0.6))
    return Model(table, bias, classes, temperature, threshold)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most `rows` labelled rows, drawn by a hash of the id; the driver holds those only.

    Rows beyond a share of the hashes are left out before the draw, so that tasks don't each send as many.
    """
    usable = labelled.filter(F.col(lang).isNotNull())
    share = min(1.0, 2.0 * rows / max(1, usable.count()))
    first = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
    drawn = (
        usable.select(F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.crc32(F.col(text)).cast("string"))).alias("_draw"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
        .filter((first < int(share * (1 << 32))) & F.col("_text").rlike(r"\p{L}"))
        .select("_draw", "_lang", _pieces("_text").alias("_text"))
        .orderBy("_draw", "_text", "_lang")
        .limit(rows)
        .collect()
    )
    return fit([r["_text"] for r in drawn], [r["_lang"] for r in drawn])


def _pieces(text: str):
    """What of a text reaches the driver: all of a short one, evenly spaced pieces of a long one."""
    n, part = F.length(text), SAMPLE_BYTES // SAMPLE_PIECES
    cut = [F.substring(F.col(text), (F.lit(k) * (n - part) / F.lit(SAMPLE_PIECES - 1)).cast("int") + 1, F.lit(part)) for k in range(SAMPLE_PIECES)]
    return F.when(n <= SAMPLE_BYTES, F.col(text)).otherwise(F.concat(*cut))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Byte ranges (from, to, end of what may be looked at): whole short texts, parts of a long one."""
    for first, end in pieces(offsets, CHUNK):
        a, b = int(offsets[first]), int(offsets[end])
        if end - first > 1 or b - a <= CHUNK:
            yield a, b, b
        else:
            for at in range(a, b, CHUNK):
                yield at, min(at + CHUNK, b), b


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of each text, over all its bytes."""
    n = len(offsets) - 1
    total, grams = np.zeros((n, len(model.classes))), np.zeros(n)
    sizes = np.diff(offsets)
    for a, b, end in _chunks(offsets):
        first, last = np.searchsorted(offsets, [a, b - 1], side="right") - 1 if b > a else (0, 0)
        inside = np.arange(first, last + 1)
        lengths = np.minimum(offsets[inside + 1], b) - np.maximum(offsets[inside], a) if b - a <= CHUNK and first == last else sizes[inside]
        owner = np.repeat(inside, lengths)
        left = offsets[owner + 1] - np.arange(a, b)
        for order, g in zip(ORDERS, ngrams(data[a : min(b + max(ORDERS) - 1, end)]), strict=False):
            g = g[: b - a]
            ok = left[: len(g)] >= order
            g, who = g[ok], owner[: len(g)][ok]
            grams += np.bincount(who, minlength=n)
            for c in range(len(model.classes)):
                total[:, c] += np.bincount(who, weights=model.table[g, c], minlength=n)
    return softmax((total / np.maximum(grams, 1)[:, None] + model.bias) / model.temperature)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected; one pass, no shuffle.

    `rejected` marks texts without a letter and those whose best probability is under the
    calibrated threshold. Columns of these names in the input are replaced.
    """
    kept = docs.drop("lang_pred", "score", "rejected")
    letters = unused(kept, "letters")
    columns = list(kept.columns)
    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            names, best = np.full(len(has), "und", object), np.zeros(len(has))
            if model is not None and len(has):
                found = scores(model, *flat(batch.column(text)))
                best = np.where(has, found.max(axis=1), 0.0)
                names = np.where(has, np.array(model.classes, object)[found.argmax(axis=1)], "und")
            weak = ~has | (best < (model.threshold if model else 1))
            new = [pa.array(names.tolist(), pa.string()), pa.array(best, pa.float64()), pa.array(weak)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], names=[*columns, "lang_pred", "score", "rejected"])

    return kept.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
