"""A bidirectional FM-index over a delimited vocabulary, searched for words one error away.

The words stand one after another between delimiters. Two suffix arrays, of that text and of the reversed text, each
give the last column of sorted rotations with counts of symbols at sampled places; a pattern is an interval of
suffix ranks in both, and both are kept in step when the pattern grows by a symbol on either side.

The search scheme for one error has two searches. Each matches one half of the word exactly, from the middle out
to the delimiter, then grows over the other half with one error allowed (a symbol replaced, left out or put in) up
to the other delimiter. One error lies in one of the halves, so one search or the other finds it. The second search
is the first one on the mirrored index and the reversed word. Everything is done for many words at once in numpy.
"""

from __future__ import annotations

import io

import numpy as np

#: Symbols between sampled counts; words searched at once.
SAMPLE = 32
AT_ONCE = 2048
DELIMITER = 0
PLACES = np.arange(SAMPLE)[None, :]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks by doubled prefixes; the end of the text comes before every symbol."""
    n = len(text)
    rank, width = text.astype(np.int64), 1
    while True:
        key = rank * np.int64(max(n, int(rank.max(initial=0)) + 1) + 1)
        key[: n - width if width < n else 0] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        change = np.ones(n, np.int64)
        change[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change) - 1
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


class Column:
    """The last column of one direction, with counts."""

    def __init__(self, last: np.ndarray, symbols: int):
        n = len(last)
        self.last, self.symbols, self.n = last, symbols, n
        blocks = n // SAMPLE + 1
        padded = np.full(blocks * SAMPLE, symbols, np.uint8)
        padded[:n] = last
        self.blocks = padded.reshape(blocks, SAMPLE)
        counts = np.bincount((np.arange(len(padded)) // SAMPLE) * (symbols + 1) + padded, minlength=blocks * (symbols + 1)).reshape(blocks, symbols + 1)[:, :symbols]
        self.before = np.zeros((blocks, symbols), np.int32)
        np.cumsum(counts[:-1], axis=0, out=self.before[1:])
        self.less = np.zeros((blocks, symbols), np.int32)
        np.cumsum(self.before[:, :-1], axis=1, out=self.less[:, 1:])
        totals = np.bincount(last, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(totals)[:-1]]).astype(np.int64)

    def counts(self, symbol: np.ndarray, at: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """How often each symbol, and smaller ones if asked for, stand before a place."""
        block, rest = at // SAMPLE, at % SAMPLE
        tail = np.where(PLACES < rest[:, None], self.blocks[block], np.uint8(self.symbols + 1))
        mine = symbol[:, None].astype(np.uint8)
        equal = self.before[block, symbol] + np.count_nonzero(tail == mine, axis=1)
        return equal, self.less[block, symbol] + np.count_nonzero(tail < mine, axis=1) if smaller else None

    def all_counts(self, at: np.ndarray) -> np.ndarray:
        """How often every symbol stands before a place: a row for each place."""
        block, rest = at // SAMPLE, at % SAMPLE
        tail = np.where(PLACES < rest[:, None], self.blocks[block], np.uint8(self.symbols))
        wide = self.symbols + 1
        found = np.bincount((np.arange(len(at))[:, None] * wide + tail).ravel(), minlength=len(at) * wide).reshape(len(at), wide)
        return self.before[block] + found[:, : self.symbols]


class Index:
    """Words (distinct, without delimiters) in both directions."""

    FIELDS = ("points", "last", "last_back", "word", "word_back")

    def __init__(self, fields: dict[str, np.ndarray]):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        symbols = len(self.points) + 1
        self.left, self.right = Column(self.last, symbols), Column(self.last_back, symbols)

    @classmethod
    def build(cls, words: list[str]) -> Index:
        joined = "\0".join(["", *words, ""])
        text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        points = np.unique(text[text > 0])
        if len(points) > 250:
            raise ValueError("more than 250 different code points")
        codes = (np.searchsorted(points, text) + 1).astype(np.uint8)
        codes[text == 0] = DELIMITER
        fields = {"points": points}
        for last, word, t, number in (("last", "word", codes, range(len(words) + 1)), ("last_back", "word_back", codes[::-1], range(len(words), -1, -1))):
            order = suffix_array(t)
            fields[last] = t[order - 1]
            at = np.cumsum(t == DELIMITER) - 1  # the how-manieth delimiter
            numbers = np.array(number, np.int64)[at[order[: len(words) + 1]]]
            # The word after a delimiter, read in this direction.
            fields[word] = numbers if last == "last" else numbers - 1
        return cls(fields)

    def save(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[Index, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(raw)) as z:
            return cls({name: z[name] for name in cls.FIELDS}), {name: z[name] for name in z.files if name not in cls.FIELDS}

    def mirrored(self) -> Index:
        other = object.__new__(Index)
        other.points, other.last, other.last_back, other.word, other.word_back = self.points, self.last_back, self.last, self.word_back, self.word
        other.left, other.right = self.right, self.left
        return other

    def near(self, queries: list[str], side: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of query and word of pairs one error apart, the error in the right half (side "l" is exact) or the left one ("r")."""
        found = [np.zeros((0, 2), np.int64)]
        for first in range(0, len(queries), AT_ONCE):
            some = queries[first : first + AT_ONCE]
            if side == "l":
                got = Search(self, some, [len(q) // 2 for q in some]).run()
            else:
                got = Search(self.mirrored(), [q[::-1] for q in some], [len(q) - len(q) // 2 for q in some]).run()
            found.append(got + np.array([first, 0]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


class Search:
    """One search of the scheme, for queries whose first `halves` symbols match exactly."""

    def __init__(self, index: Index, queries: list[str], halves: list[int]):
        self.index = index
        text = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
        place = np.searchsorted(index.points, text)
        known = index.points[np.minimum(place, len(index.points) - 1)] == text if len(index.points) else np.zeros(len(text), bool)
        self.size = np.array([len(q) for q in queries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        #: Unknown symbols get the number after the last one, which no interval holds.
        self.codes = np.append(np.where(known, place + 1, len(index.points) + 1), 0)
        self.half = np.array(halves, np.int64)

    def symbol(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Symbol of each query at a place; the delimiter after its end."""
        return np.where(at < self.size[q], self.codes[np.minimum(self.start[q] + at, len(self.codes) - 1)], DELIMITER)

    @staticmethod
    def grow(column: Column, lo: np.ndarray, size: np.ndarray, symbol: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The interval in the column's direction and its size after one more symbol, and, if given, its start in the other direction."""
        known = symbol < column.symbols
        symbol = np.where(known, symbol, 0)
        a, less_a = column.counts(symbol, lo, other is not None)
        b, less_b = column.counts(symbol, lo + size, other is not None)
        return column.first[symbol] + a, np.where(known, b - a, 0), None if other is None else other + less_b - less_a

    def run(self) -> np.ndarray:
        index, n = self.index, self.index.left.n
        q = np.arange(len(self.size))
        lo, back, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), n, np.int64)
        # From the middle to the delimiter on the left, with the interval of the other direction kept in step.
        at = self.half - 1
        done = [(q[:0], back[:0], size[:0])]
        while len(q):
            symbol = np.where(at >= 0, self.codes[self.start[q] + np.maximum(at, 0)], DELIMITER)
            lo, size, back = self.grow(index.left, lo, size, symbol, back)
            keep = size > 0
            end = keep & (at < 0)
            done.append((q[end], back[end], size[end]))
            keep &= at >= 0
            q, lo, back, size, at = q[keep], lo[keep], back[keep], size[keep], at[keep] - 1
        # Then to the right. `at` symbols of the query are read. Of equal symbols in a row the last one is left out, and
        # nothing is put in before a symbol like it: the word is the same, and stands for every place of the row.
        q, back, size = (np.concatenate([d[k] for d in done]) for k in range(3))
        at = self.half[q]
        spent: list[tuple[np.ndarray, ...]] = []
        while len(q):
            symbol = self.symbol(q, at)
            before, after = index.right.all_counts(back), index.right.all_counts(back + size)
            sizes = after - before
            row, put = np.nonzero(sizes[:, 1:])
            put = put + 1
            own, begin, held = q[row], index.right.first[put] + before[row, put], sizes[row, put]
            inside = at < self.size[q]
            other = put != symbol[row]
            replaced = other & inside[row]
            left_out = inside & (symbol != self.symbol(q, at + 1))
            spent.append((own[other], begin[other], held[other], at[row][other]))
            spent.append((own[replaced], begin[replaced], held[replaced], at[row][replaced] + 1))
            spent.append((q[left_out], back[left_out], size[left_out], at[left_out] + 1))
            same = ~other & inside[row]
            q, back, size, at = own[same], begin[same], held[same], at[row][same] + 1
        if not spent:
            return np.zeros((0, 2), np.int64)
        return np.unique(self.rest(*(np.concatenate([s[k] for s in spent]) for k in range(4))), axis=0)

    def rest(self, q: np.ndarray, back: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact to the end and its delimiter; the error is spent."""
        found = [np.zeros((0, 2), np.int64)]
        while len(q):
            end = at >= self.size[q]
            back, size, _ = self.grow(self.index.right, back, size, self.symbol(q, at))
            keep = size > 0
            whole = keep & end
            found.append(np.stack([q[whole], self.index.word_back[back[whole]]], axis=1))
            keep &= ~end
            q, back, size, at = q[keep], back[keep], size[keep], at[keep] + 1
        return np.concatenate(found)
