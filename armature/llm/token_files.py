"""Token ids as flat binary files that can be memory-mapped.

One part is three files below the output folder: `NAME.bin` holds the ids as little-endian
unsigned integers (16 bits if the vocabulary allows it, else 32), `NAME.idx` 64-bit offsets of
documents within the part (one more than there are documents), `NAME.doc` the 64-bit document ids.
Parts follow each other in ascending document id. A manifest in Parquet names the parts in order
with their counts and `base`, the ids of all parts before: a prefix sum over the manifest.

Tasks write under a name of their own attempt; only the parts of the manifest, which come from
tasks that succeeded, belong to the data, so tasks may run twice or be lost.

Defined cases: a null or empty text gives the end id alone. Null document ids come first and are
stored as the smallest 64-bit number. Rows with the same id keep one entry each, ordered by
a hash of the text. An empty table gives an empty manifest. Other columns of the input are not written.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armature.llm.textarrays import flat, mix, pieces, powers
from armature.session import new_dir

#: Smallest 64-bit number, stored for a null id.
NO_ID = -(1 << 63)
#: Words kept by a Python worker between documents; beyond it the memory starts anew.
REMEMBERED = 2_500_000
TABLE = 1 << 22
MANIFEST = "part string, first_doc long, n_docs long, n_tokens long, width int"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


# ---- words ----

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: White space of the splitting pattern.
BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point below 65,536, and whether every Unicode version since 3.2 agrees on it."""
    old, kind, sure = unicodedata.ucd_3_2_0, np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        now = unicodedata.category(chr(c))
        kind[c] = {"L": LETTER, "N": NUMBER}.get(now[0], OTHER)
        sure[c] = now == old.category(chr(c)) and now not in ("Cn", "Cs")
    kind[BLANKS] = BLANK
    sure[0x180E] = False
    return kind, sure


def split_words(points: np.ndarray, starts: np.ndarray) -> np.ndarray | None:
    """Where the pattern of byte-level BPE splits texts; None if a code point is not surely classed.

    The pattern takes, in this order: contractions after an apostrophe, runs of letters, of numbers or of
    other signs, each with one space before, and white space, whose last sign goes on to the next word.
    """
    kind, sure = kinds()
    if len(points) == 0:
        return np.zeros(0, np.int64)
    if points.max() >= 1 << 16 or not sure[points].all():
        return None
    k = kind[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    first[n] = True
    change = np.ones(n, bool)
    change[1:] = k[1:] != k[:-1]
    cut = change | first[:n]
    # White space before something else: its last sign begins a word; a space joins what follows.
    after = np.flatnonzero(cut[1:] & ~first[1:n] & (k[:-1] == BLANK)) if n > 1 else np.zeros(0, np.int64)
    cut[after] = True
    joined = after[points[after] == 32] + 1
    cut[joined] = False
    return _contractions(points, k, cut, first) if (points == 39).any() else np.flatnonzero(cut)


def _contractions(points: np.ndarray, k: np.ndarray, cut: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Apostrophes that begin a word and are followed by s, t, m, d, re, ve or ll are words with them."""
    n = len(points)
    for at in np.flatnonzero((points == 39) & cut[:n]):
        # A sign run that begins with an apostrophe, with no space joined to it.
        after = "".join(map(chr, points[at + 1 : at + 3][~np.logical_or.accumulate(first[at + 1 : at + 3][: n - at - 1])]))
        size = 2 if after[:2] in ("re", "ve", "ll") else 1 if after[:1] in ("s", "t", "m", "d") else 0
        if size:
            cut[at + 1 : at + 1 + size] = False
            if at + 1 + size < n:
                cut[at + 1 + size] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts with a tokenizer file, each different word once as long as it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        form = __import__("json").loads(self.tokenizer.to_str())
        before = form.get("pre_tokenizer") or {}
        #: Only for tokenizers that split by the known pattern and encode each word alone.
        self.by_words = (
            form.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not form["model"].get("dropout")
        )
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        self.special = [t["content"] for t in form.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        #: Open addressing: hash of a word, and its number.
        self.hashes, self.numbers = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int32)
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word; -1 if it isn't known. Hashes are never 0."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        held = self.hashes[slot]
        hit = held == hashes
        out[hit] = self.numbers[slot[hit]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (TABLE - 1)
            held = self.hashes[slot[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.numbers[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Add different words that aren't known."""
        slot = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.hashes[slot[left]] == 0]
            self.hashes[slot[free]] = hashes[free]
            self.numbers[slot[free]] = numbers[free]
            left = left[self.hashes[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & (TABLE - 1)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new, different words."""
        got = self.apart(words)
        n = np.array([len(x) for x in got], np.int64)
        self.put(hashes, (len(self.n) + np.arange(len(words))).astype(np.int32))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, *got])

    def apart(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words go in lines of many, as a line's end splits words without joining any."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if not w[-1].isspace() and "\n" not in w]
        rest = [i for i, w in enumerate(words) if w[-1].isspace() or "\n" in w]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(words[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(own) - 1:
                for i, x in zip(own, np.split(ids, ends), strict=True):
                    out[i] = x
                for i in own[1:]:
                    out[i] = out[i][1:]
            else:
                rest += own
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        found = self._by_words(data, offsets) if self.by_words else None
        if found is not None:
            return found
        n = len(offsets) - 1
        if n > 1 and self.by_words:
            half = n // 2
            a = self.encode(data[: offsets[half]], offsets[: half + 1])
            b = self.encode(data[offsets[half] :], offsets[half:] - offsets[half])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        raw = data.tobytes()
        got = self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in range(n)])
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.array([len(x) for x in got], np.int64)

    def _by_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return None
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = split_words(points, np.searchsorted(lead, offsets[:-1]))
        if cuts is None:
            return None
        starts = lead[cuts]
        sizes = np.diff(np.append(starts, len(data)))
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        place_ = np.arange(len(data)) - np.repeat(starts, sizes)
        hashes = np.maximum(mix(np.add.reduceat(CODES[data] * powers(int(sizes.max()))[place_], starts)), np.uint64(1))
        which = self.find(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            unique, first = np.unique(hashes[new], return_index=True)
            if len(self.n) + len(unique) > REMEMBERED:
                self.clear()
                unique, first, new = *np.unique(hashes, return_index=True), np.arange(len(hashes))
            s = starts[new[first]]
            e = s + sizes[new[first]]
            self.learn(unique, [raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            which[new] = self.find(hashes[new])
        n, at = self.n[which], self.at[which]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(at - (ends - n), n) + np.arange(ends[-1])]
        edges = np.searchsorted(starts, offsets)
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[edges])


_draw = np.random.Generator(np.random.PCG64(99))
CODES = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


# ---- files ----


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 32 << 20) -> DataFrame:
    """Tokenise all rows into files below `out`; returns the manifest, read back from its file.

    Rows are range-partitioned by document id, by a number of partitions that follows the
    bytes of the texts, and written in that order.
    """
    import os

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-int(total) // part_bytes))
    # Ranges are found from a sample of ids and hashes, so no text reaches the driver.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        files, folder = place(out)
        files.create_dir(folder, recursive=True)
        name, streams, first, n_docs, n_tokens = uuid.uuid4().hex, None, None, 0, 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column(1))
            for a, b in pieces(offsets, 2 << 20):
                if streams is None:
                    streams = [files.open_output_stream(f"{folder}/{name}.{x}") for x in ("bin", "idx", "doc")]
                    streams[1].write(np.zeros(1, "<i8").tobytes())
                    first = int(ids[a])
                tokens, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(counts + 1)
                full = np.full(int(ends[-1]), end_id, f"<u{width}")
                own = np.ones(len(full), bool)
                own[ends - 1] = False
                full[own] = tokens
                streams[0].write(full.tobytes())
                streams[1].write((ends + n_tokens).astype("<i8").tobytes())
                streams[2].write(ids[a:b].astype("<i8").tobytes())
                n_docs, n_tokens = n_docs + b - a, n_tokens + int(ends[-1])
        for s in streams or []:
            s.close()
        if streams:
            yield pa.RecordBatch.from_pydict({"part": [name], "first_doc": [first], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": pa.array([width], pa.int32())})

    # The partitions' order is that of the document ids; equal first ids are told apart by it.
    made = ordered.mapInArrow(run, MANIFEST).withColumn("seq", F.spark_partition_id())
    raw = new_dir(spark, "token-parts")
    made.write.parquet(raw)
    parts_made = spark.read.schema(f"{MANIFEST}, seq int").parquet(raw)
    # A row for each part, by far fewer than documents.
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = parts_made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("doc_base", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
    at = f"{out.rstrip('/')}/manifest.parquet"
    manifest.write.parquet(at)
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, seq int, base long, doc_base long").parquet(f"{out.rstrip('/')}/manifest.parquet")


def mapped(files: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the file is local to see, else read."""
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_documents(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and the ids on request.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    manifest = read_manifest(spark, out)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = place(out)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{folder}/{row['part']}"
                ids, idx, doc = mapped(files, f"{stem}.bin", f"<u{row['width']}"), mapped(files, f"{stem}.idx", "<i8"), mapped(files, f"{stem}.doc", "<i8")
                for a in range(0, len(doc), 4096):
                    edges = np.asarray(idx[a : a + 4097])
                    name = np.asarray(doc[a : a + 4096])
                    own = [np.asarray(ids[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                    cols = [
                        pa.array(name, pa.int64(), mask=name == NO_ID),
                        pa.array(edges[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return manifest.select("part", "width", "base").repartition(n, "part").mapInArrow(run, schema)
