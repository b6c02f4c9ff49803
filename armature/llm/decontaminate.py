"""Benchmark decontamination by canonical templates.

Texts are cut into words, also between digits and letters; punctuation and case are dropped. Numbers, measuring
units after a number and names (capitalised words inside a sentence) become typed placeholders, all other words
stay. A capitalised word that begins a sentence or line may be a name or not: windows over it have both forms,
in the benchmark and in documents. Windows of
eight canonical words of a document are joined by hash with those of the benchmark, so a
question whose numbers, names or units were exchanged still matches. The slots of matching windows
on one diagonal are then checked: a value of the item must always have become the same value in the
document, and different values different ones. Windows are joined by the hash of their words, values included,
too, so verbatim copies match whatever their words are. A document is contaminated by an item when the
windows that pass cover at least half of the item's windows, or of those with enough literal words.

Defined cases: null and empty texts match nothing; an item shorter than a window is one window
of its own length; windows with too few literal words match only word for word, as templates of mere
placeholders match anything; items without any word match nothing; rows are judged one by one, so
repeated rows repeat their results; items with the same text are reported each; null ids are
carried as null. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm.textarrays import BYTE_CODES, SPACE, flat, mix, pieces, powers, spans_hash

WINDOW = 8
#: Literal words a window needs, of WINDOW; shorter windows in proportion, rounded up.
LITERAL = 5
#: Share of an item's windows that must match.
COVER = 0.5
#: Items whose windows are shipped to the tasks at once, by the bytes of their texts.
BLOCK_BYTES = 16 << 20
#: Windows whose forms are made at once; a window has fewer than a hundred.
SLICE = 1 << 17

#: Measuring units.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs "
    "pound pounds ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons pint pints cup cups s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years kmh mph hz khz mhz w kw kwh v volt volts "
    "watt watts j joule joules kb mb gb tb percent degree degrees dollar dollars cent cents euro euros usd eur gbp"
).split()

NUMBER, UNIT, NAME, EITHER = 1, 2, 3, 4
MARKS = np.array([0, 0x1F3A5B7C9D2E4F61, 0x2B4D6F8192A3B4C5, 0x3C5E7F90A1B2C3D4], np.uint64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A to Z and of the capitals of Latin-1 in UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words without punctuation: text of each, kind (0 literal, a placeholder, or EITHER), own hash, template hash (EITHER: as literal)."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # A sentence ends with one of . ! ? before white space, at a line's end and at a text's end.
    kept = ~_PUNCTUATION[data]
    low, own = _lower(data)[kept], owner[kept]
    raw = data[kept]
    ends = np.isin(data, [46, 33, 63, 10, 58])
    seen = np.cumsum(ends)[kept]
    inside = ~SPACE[raw]
    start = inside.copy()
    digit = (raw >= 48) & (raw <= 57)
    start[1:] &= ~inside[:-1] | (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])
    at = np.flatnonzero(start)
    codes = np.where(SPACE[low], np.uint64(0), BYTE_CODES[low])
    h = spans_hash(codes, at, len(low))
    who = own[at]
    n = len(at)
    kind = np.zeros(n, np.uint8)
    if n == 0:
        return who, kind, h, h
    letters = _sum(inside & ~digit, at)
    kind[(letters == 0)] = NUMBER
    upper = ((raw >= 65) & (raw <= 90)) | ((low != raw) & (raw >= 0x80))
    head = upper[at] | ((raw[at] == 0xC3) & np.append(upper, False)[at + 1])
    capitals = _sum(upper, at)
    first = np.ones(n, bool)
    first[1:] = (who[1:] != who[:-1]) | (seen[at][1:] != seen[at][:-1])
    named = (letters > 1) & head & (capitals == 1)
    kind[named] = np.where(first[named], EITHER, NAME)
    unit = np.isin(h, _UNIT_HASHES)
    unit[0] = False
    unit[1:] &= (kind[:-1] == NUMBER) & (who[1:] == who[:-1])
    kind[unit] = UNIT
    return who, kind, h, np.where((kind == 0) | (kind == EITHER), h, MARKS[kind % EITHER])


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    return spans_hash(np.where(SPACE[data], np.uint64(0), BYTE_CODES[data]), starts, len(data))


_UNIT_HASHES = _word_hashes(UNITS)


def windows(doc: tuple, size: int, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First words and hashes of the windows of `size` words inside one text that have enough literals, in slices.

    A window is given once for each form its EITHER words allow. With `known`, forms with a literal that isn't known are left out.
    """
    who, kind, own, template = doc
    n = len(who) - size + 1
    if n <= 0:
        return
    either = kind == EITHER
    literal = np.concatenate([[0], np.cumsum((kind == 0) | either)])
    need = -(-LITERAL * size // WINDOW)
    fit = (who[:n] == who[size - 1 :]) & (literal[size:] - literal[:n] >= need)
    if known is not None:
        strange = np.concatenate([[0], np.cumsum((kind == 0) & ~known)])
        fit &= strange[size:] == strange[:n]
    starts, factors = np.flatnonzero(fit), powers(size + 1)[1:]
    for begin in range(0, len(starts), SLICE):
        at = starts[begin : begin + SLICE]
        literals = literal[at + size] - literal[at]
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h += template[at + k] * factors[k]
        for k in range(size):
            here = at + k
            open_ = either[here]
            kept = ~open_ | known[here] if known is not None else slice(None)
            named = np.flatnonzero(open_ & (literals > need))
            other = h[named] + (MARKS[NAME] - own[here[named]]) * factors[k]
            at, h, literals = np.concatenate([at[kept], at[named]]), np.concatenate([h[kept], other]), np.concatenate([literals[kept], literals[named] - 1])
        yield at, mix(h + np.uint64(size))


def verbatim(who: np.ndarray, own: np.ndarray, size: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of `size` words inside one text, values included; with `known`, of known words."""
    n = len(who) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    fit = who[:n] == who[size - 1 :]
    if known is not None:
        strange = np.concatenate([[0], np.cumsum(~known)])
        fit &= strange[size:] == strange[:n]
    at = np.flatnonzero(fit)
    h, factors = np.zeros(len(at), np.uint64), powers(size + 1)[1:]
    for k in range(size):
        h += own[at + k] * factors[k]
    return at, mix(h + np.uint64(size))


def _ordered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
    h = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
    order = np.argsort(h, kind="stable")
    return at[order], h[order]


class Templates:
    """Canonical items of a block of the benchmark and their windows, sorted by hash of the template and of the words."""

    def __init__(self, texts: list[str]):
        data, offsets = flat(pa.array(texts, pa.large_string()))
        doc = canonical(data, offsets)
        self.who, self.kind, self.own, _ = doc
        n = len(texts)
        self.words = np.bincount(self.who, minlength=n)
        #: Words that stand for themselves somewhere, sorted.
        self.literals = np.unique(self.own[(self.kind == 0) | (self.kind == EITHER)])
        self.vocabulary = np.unique(self.own)
        parts, plain = [], []
        self.sizes = sorted({int(min(w, WINDOW)) for w in self.words if w})
        for size in self.sizes:
            mine = np.minimum(self.words[self.who], WINDOW) == size
            parts += [(at[mine[at]], h[mine[at]]) for at, h in windows(doc, size)]
            at, h = verbatim(self.who, self.own, size)
            plain.append((at[mine[at]], h[mine[at]]))
        self.at, self.h = _ordered(parts)
        self.plain_at, self.plain_h = _ordered(plain)
        #: Whether a window that begins here has enough literals for its slots to be exchanged.
        self.open = np.zeros(len(self.who), bool)
        self.open[self.at] = True
        self.windows = np.bincount(self.who[self.plain_at], minlength=n)
        self.open_windows = np.bincount(self.who[self.open], minlength=n)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    if len(ordered) == 0:
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _hits(ordered: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of equal hashes: in `h` and in the sorted array."""
    some = np.flatnonzero(_among(h, ordered))
    lo, hi = np.searchsorted(ordered, h[some], side="left"), np.searchsorted(ordered, h[some], side="right")
    n = hi - lo
    return np.repeat(some, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _slots(items: Templates, size: int, doc: tuple, d_at: np.ndarray, i_at: np.ndarray) -> np.ndarray:
    """Which window matches keep their slots consistent with the rest of their diagonal.

    Matches are grouped by text, item and diagonal. In a group, the most common value a slot value
    became is taken as its meaning; matches with another meaning, or one shared by two
    values of the item, are dropped.
    """
    who, kind, own, _ = doc
    ok = np.ones(len(d_at), bool)
    shift = np.arange(size)
    there, here = items.kind[i_at[:, None] + shift], kind[d_at[:, None] + shift]
    # A word that may be a name is one where the item has a name, or a word that may be one.
    held = np.where(here == EITHER, np.where(there == 0, 0, NAME), here)
    rows, cols = np.nonzero(held)
    if len(rows) == 0:
        return ok
    group = np.stack([who[d_at], items.who[i_at], d_at - i_at])
    _, group_no = np.unique(group, axis=1, return_inverse=True)
    group_no = group_no.reshape(-1)[rows].astype(np.uint64) * np.uint64(EITHER) + held[rows, cols].astype(np.uint64)
    there, here = items.own[i_at[rows] + cols], own[d_at[rows] + cols]
    for value, image in ((there, here), (here, there)):
        key = mix(value + mix(group_no))
        pairs, inverse, n = np.unique(np.stack([key, image]), axis=1, return_inverse=True, return_counts=True)
        order = np.lexsort((pairs[1], -n, pairs[0]))
        best = np.ones(len(order), bool)
        best[1:] = pairs[0][order][1:] != pairs[0][order][:-1]
        chosen = np.zeros(len(order), bool)
        chosen[order] = best
        ok[rows[~chosen[inverse.reshape(-1)]]] = False
    return ok


def matches(items: Templates, data: np.ndarray, offsets: np.ndarray, cover: float = COVER) -> tuple[np.ndarray, ...]:
    """Text, item that contaminates it, matching windows that are consistent, those of them with another slot value, and windows of the item.

    Counted are all windows of the item, or only those with enough literals where a larger share of them matches.
    """
    out = [np.zeros((5, 0), np.int64)]
    for a, b in pieces(offsets):
        doc = canonical(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        who, _, own, _ = doc
        found = []
        known, listed = _among(own, items.literals), _among(own, items.vocabulary)
        for size in items.sizes:
            pairs = [np.zeros((2, 0), np.int64)]
            for at, h in windows(doc, size, known):
                hit, place = _hits(items.h, h)
                pairs.append(np.stack([at[hit], items.at[place]]))
            at, h = verbatim(who, own, size, listed)
            hit, place = _hits(items.plain_h, h)
            pairs.append(np.stack([at[hit], items.plain_at[place]]))
            # Two windows may match in several forms.
            d_at, i_at = np.unique(np.concatenate(pairs, axis=1), axis=1)
            mine = np.minimum(items.words[items.who[i_at]], WINDOW) == size
            d_at, i_at = d_at[mine], i_at[mine]
            shift = np.arange(size)
            changed = (own[d_at[:, None] + shift] != items.own[i_at[:, None] + shift]).any(axis=1)
            ok = _slots(items, size, doc, d_at, i_at) | ~changed
            d_at, i_at, changed = d_at[ok], i_at[ok], changed[ok]
            found.append(np.stack([who[d_at] + a, items.who[i_at], i_at, changed]))
        if found:
            rows = np.concatenate(found, axis=1)
            # A window of an item counts once for each text; unchanged matches go before changed ones.
            rows = rows[:, np.lexsort(rows[::-1])]
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
            rows = rows[:, new]
            if rows.shape[1]:
                pair, inverse = np.unique(rows[:2], axis=1, return_inverse=True)
                inverse = inverse.reshape(-1)
                n, n_open = np.bincount(inverse), np.bincount(inverse, weights=items.open[rows[2]]).astype(np.int64)
                changed, whole, some = np.bincount(inverse, weights=rows[3]).astype(np.int64), items.windows[pair[1]], items.open_windows[pair[1]]
                fewer = n_open * whole > n * some
                n, whole = np.where(fewer, n_open, n), np.where(fewer, some, whole)
                out.append(np.stack([pair[0], pair[1], n, changed, whole])[:, n >= np.ceil(cover * whole)])
    return tuple(np.concatenate(out, axis=1))


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of bounded bytes, read partition by partition."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        if block and size + len(row["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += 4 * len(row["t"])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that contaminates it: doc_id, item_id, n_windows, n_changed, item_windows, share.

    n_windows counts the item's windows found with consistent slots, n_changed those of them with other slot
    values. The benchmark's windows go to the tasks in blocks of bounded size, one pass over the
    documents for each block; no document is shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, n_windows long, n_changed long, item_windows long, share double"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id, text, block_bytes):
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(block), cover, schema), schema)
        out = out.unionByName(found)
    return out


def _search(block, cover: float, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Templates([t for _, t in block.value])
        ids = pa.array([i for i, _ in block.value], pa.int64())
        for batch in batches:
            who, item, n, changed, whole = matches(items, *flat(batch.column(1)), cover)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who)), ids.take(pa.array(item)), pa.array(n), pa.array(changed), pa.array(whole), pa.array(n / np.maximum(whole, 1))], names=names
            )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates; a row-wise filter without a shuffle."""
    out, schema, names = docs, docs.schema, docs.columns
    for block in item_blocks(benchmark, item_id, text, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = Templates([t for _, t in held.value])
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[matches(items, *flat(batch.column(text)), cover)[0]] = False
                yield batch.filter(pa.array(keep)).select(names)

        out = out.mapInArrow(run, schema)
    return out
