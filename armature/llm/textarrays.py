"""Texts of an Arrow batch as flat byte arrays, and words and hashes over them in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: White space that ends a word: the space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A to Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts handled at once; arrays over their bytes take some ten times as much.
PIECE_BYTES = 4 << 20

_draw = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_CODES = np.where(SPACE, np.uint64(0), BYTE_CODES[LOWER])
BASE = np.uint64(0x9E3779B97F4A7C15)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins; nulls count as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, end) of about `most` bytes; a longer text is a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin; a word never crosses a text."""
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = inside[firsts]
    return np.flatnonzero(start)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans_hash(codes: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """64-bit hash of each run from one start to the next; `codes` has a value for each byte."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    runs = np.diff(np.append(starts, total))
    place = np.arange(starts[0], total) - np.repeat(starts, runs)
    return mix(np.add.reduceat(codes[starts[0] :] * powers(int(runs.max()))[place], starts - starts[0]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the text it is in."""
    starts = word_starts(data, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return spans_hash(WORD_CODES[data], starts, len(data)), owner


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the text each is in, in text order.

    A text of fewer words has one: the hash of its whole sequence. One without words has none.
    """
    words, owner = word_hashes(data, offsets)
    n = len(words)
    factors = powers(size + 1)[1:]
    if n >= size:
        whole = owner[: n - size + 1] == owner[size - 1 :]
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h += words[k : n - size + 1 + k] * factors[k]
        found, where = mix(h[whole]), owner[: n - size + 1][whole]
    else:
        found, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        firsts = np.searchsorted(owner, short)
        few = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            few[has] += words[firsts[has] + k] * factors[k]
        few = mix(few + counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        found, where = np.concatenate([found, few]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        found, where = found[order], where[order]
    return found, where


def distinct_sets(found: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each of n texts, one after another, and where each text's begin."""
    edges = np.searchsorted(where, np.arange(n + 1))
    sets = [np.unique(found[edges[i] : edges[i + 1]]) for i in range(n)]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets
