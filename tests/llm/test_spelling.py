"""Spelling variants: the FM-index and the whole operator against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from armature.llm import queries, spelling
from armature.llm.fm_index import Index, suffix_array

SF_DIR = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("alphabet, seed", [("ab", 1), ("abcé", 2), ("aÿ", 3)])
def test_index_against_brute_force(alphabet, seed):
    random.seed(seed)
    word = lambda more="": "".join(random.choice(alphabet + more) for _ in range(random.randint(2, 9)))
    words, asked = list({word() for _ in range(150)}), list({word("z") for _ in range(80)})
    index, more = Index.load(Index.build(words).save(counts=suffix_array(__import__("numpy").array([1, 0, 1]))))
    assert more["counts"].tolist() == [1, 2, 0]
    for side in "lr":
        got = list(zip(*(x.tolist() for x in index.near(asked + words, side)), strict=True))
        assert len(got) == len(set(got))
        for i, q in enumerate(asked + words):
            half = len(q) // 2
            exact = (lambda w: w.startswith(q[:half])) if side == "l" else (lambda w: w.endswith(q[half:]))
            found = {j for a, j in got if a == i}
            # Pairs whose error can only lie in the half that is matched exactly belong to the other search.
            assert {j for j, w in enumerate(words) if near(q, w) and not exact(w)} & found == set()
            assert found <= {j for j, w in enumerate(words) if near(q, w)}
    both = {(i, j) for side in "lr" for i, j in zip(*(x.tolist() for x in index.near(words, side)), strict=True)}
    assert both == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


def test_index_of_nothing_and_of_long_words():
    assert [len(x) for x in Index.build([]).near(["abc"], "l")] == [0, 0]
    long = "ab" * 3000
    index = Index.build([long, long[:-1], "x" + long, "b" + long[1:]])
    assert sorted(index.near([long], "l")[1].tolist()) == [1] and sorted(index.near([long], "r")[1].tolist()) == [2, 3]


def expected(rows, every=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    # Words one error apart have a common word one symbol shorter, or one is that of the other.
    shorter = {}
    for w in words:
        for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shorter.setdefault(s, set()).add(w)
    linked = {w: set() for w in words}
    for group in shorter.values():
        for a in group:
            linked[a] |= {b for b in group if b != a and near(a, b)}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in linked[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(linked[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(n):
    random.seed(7)
    base = ["".join(random.choice("abcdeéß") for _ in range(random.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(random.randint(0, 60)):
            w = random.choice(base[: random.randint(1, 40)])
            if random.random() < 0.3:
                k = random.randrange(len(w))
                w = random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice("abé") + w[k:], w[:k] + "x" + w[k + 1 :]])
            out.append(random.choice([w, w.capitalize(), w.upper() if "ß" not in w else w]))
        rows.append((i if i % 9 else None, random.choice([" ", ", ", "\n", "1", "×"]).join(out) if i % 11 else None))
    return [*rows, rows[5], rows[5], (500, ""), (501, "Größe GRÖSSE größe Größe ÀÀÀÀÀ àÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÀ"), (502, "w" * 3_000), (503, "w" * 3_000), (504, "w" * 3_000), (505, ("w" * 2_999 + " ") * 3)]


@pytest.mark.parametrize("shard, same_half", [(40_000, 10_000), (60, 10)])
def test_variants_against_brute_force(spark, shard, same_half):
    rows = texts(150)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert got(spelling.variants(docs, shard=shard, same_half=same_half)) == expected(rows)


def test_every_run_is_misspelt(spark):
    rows = [(k, "letters of the alphabet and letters") for k in range(40)]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1)) == expected(rows, 1)


def test_chain_of_forms_ends_at_the_root(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    rows = [(0, " ".join(w for k, w in enumerate(words) for _ in range(3 << k)))]
    out = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=None).collect()}
    assert {r["root"] for r in out.values()} == {"bbbbc"} and out["aaaaa"]["form"] == "aaaab" and out["bbbbc"]["form"] is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "some other words")], "doc_id long, text string")).collect() == []


def test_query_on_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op11_spelling_variants(spark, SF_DIR)) == expected(rows)
