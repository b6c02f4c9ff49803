"""Suffix dedup, mixing, top-k search, resharding, the Jaccard join and the pipeline on small tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import tracemalloc

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from armature.llm import decontaminate, jaccard_join, mixing, mtree, queries, reshard, suffix_dedup
from armature.llm.components import components
from armature.session import new_dir

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.SQL[name]) is None


# ---- 3 ----


def covered(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else ():
            w = b[k : k + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                cut[k : k + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if cut[j] and (j == 0 or not cut[j - 1]))
        out.append((i, len(b), sum(cut), runs, hashlib.sha256(bytes(x for x, y in zip(b, cut, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def passages(n):
    random.seed(4)
    word = lambda: "".join(random.choice("abé") for _ in range(random.randint(1, 4)))
    shared = [" ".join(word() for _ in range(random.randint(15, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [random.choice(shared)[random.randint(0, 40) :] if random.random() < 0.4 else " ".join(word() for _ in range(20)) for _ in range(random.randint(0, 5))]
        rows.append((i if random.random() > 0.05 else None, " ".join(parts) if random.random() > 0.05 else None))
    return [*rows, (200, "ab" * 200), (201, "x" + "ab" * 150), (201, "x" + "ab" * 150), (201, "y" + shared[0]), (202, "z" * 500), (203, "z" * 120), (205, rows[3][1]), (206, rows[3][1])]


@pytest.mark.parametrize("length, keys, block", [(50, 1_000_000, 1 << 20), (50, 4000, 8000)])
def test_suffix_dedup_against_brute_force(spark, length, keys, block):
    rows = passages(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("anchors", F.lit(2))
    got = sorted((tuple(r) for r in suffix_dedup.dedup(docs, length=length, keys=keys, block_bytes=block).collect()), key=str)
    assert got == covered(rows, length)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op3_suffix_dedup(spark, SF_DIR).collect()), key=str) == covered(rows, 50)


# ---- 5 ----


def test_mix_holds_its_targets(spark):
    random.seed(5)
    rows = [(i if i % 50 else None, random.choice(["a", "a", "a", "b", "c", None]), "w " * random.randint(0, 40) if i % 17 else None) for i in range(900)] + [(7, "b", "w w w")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("place", F.lit("y")).withColumn("level", F.lit(1))
    got = mixing.decisions(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        own = by[r["source_size"]]
        own[0] += r["size"] * r["copies"]
        own[1] = r["target"]
    total = sum(r["size"] for r in got)
    assert abs(sum(o[1] for o in by.values()) - total) < 1e-6 * total
    assert all(abs(taken - target) <= 45 for taken, target, _ in by.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    again = mixing.mix(docs.repartition(5))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.decisions(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert {r["copies"] for r in mixing.decisions(docs.withColumn("text", F.lit(" "))).collect()} == {0}


def test_mix_in_many_slices_is_the_same(spark):
    whole = sorted(map(tuple, mixing.decisions(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()))
    before, mixing.ROWS_PER_SLICE = mixing.ROWS_PER_SLICE, 10
    try:
        assert sorted(map(tuple, mixing.decisions(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect())) == whole
    finally:
        mixing.ROWS_PER_SLICE = before


# ---- 6 ----


def brute_top(rows, k):
    import math

    known = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            v = [math.floor(256 * float(np.float32(c))) for c in x]
            known[i] = min(known.get(i, v), v)
    out = []
    for q, x in known.items():
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in known.items() if i != q and len(y) == len(x)))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 6))
    rows = [(i, [float(v) for v in (base[i % 30] + 0.05 * rng.normal(size=6))]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(1000, 1300)]  # one vector very often
    rows += [(2000, None), (2050, [None] * 6), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, rows[1][1]), (2200, [1.0, 2.0]), (2201, [0.5, 2.0]), (2250, []), (2251, [])]
    rows += [(50, rows[3][1]), rows[60]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("cell", F.lit(2))
    vectors = mtree.prepared(table)
    got = sorted(tuple(r) for r in mtree.search(vectors, vectors.filter("vec_id % 50 = 0"), 5, tree=150).collect())
    assert got == brute_top(rows, 5)
    empty = mtree.prepared(table.limit(0))
    assert mtree.search(empty, empty).count() == 0


def test_tree_leaves_out_pages():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 8)) * 300
    x = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 8)) * 10).astype(np.int64)
    tree = mtree.Tree.load(mtree.Tree.build(x, [[i] for i in range(len(x))], float((x**2).sum(axis=1).max())).save())
    seen = [0, 0]
    for q in range(0, 6000, 600):
        scores = x @ x[q]
        order = np.lexsort((np.arange(len(x)), -scores))
        want = [(int(scores[i]), int(i)) for i in order if i != q][:5]
        assert tree.search(x[q], q, 5, None, seen) == want
        assert tree.search(x[q], q, 5, want[-1][0]) == want
    assert seen[1] < 0.5 * 10 * len(x)


# ---- 7 ----


def test_fewest_moves_is_least():
    random.seed(8)
    for _ in range(30):
        supply = [random.randint(0, 4) for _ in range(3)]
        cuts = sorted(random.randint(0, sum(supply)) for _ in range(2))
        capacity = [cuts[0], cuts[1] - cuts[0], sum(supply) - cuts[1]]
        cost = [[random.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = reshard.fewest_moves(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(3)] == capacity
        units = [i for i, n in enumerate(supply) for _ in range(n)]
        places = [j for j, n in enumerate(capacity) for _ in range(n)]
        best = min((sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(places))), default=0) if len(units) <= 7 else None
        if best is not None:
            assert sum(cost[i][j] * flow[i][j] for i in range(3) for j in range(3)) == best
    flow = reshard.fewest_moves([90, 5, 5], [25, 25, 25, 25])
    assert sum(flow[i][j] for i in range(3) for j in range(4) if i != j) == 65


def test_reshard(spark):
    rows = queries.op7_reshard(spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    import zlib

    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        text = docs.pop(r["doc_id"]).encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert not docs and set(load) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in rows)


def test_reshard_edge_cases(spark):
    rows = [(i, None if i % 9 == 0 else "" if i % 9 == 1 else "x" * (i % 50), i % 2) for i in range(300)] + [(7, "same", 1)] * 5 + [(None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old_shard int").withColumn("block", F.lit(1)).withColumn("first", F.lit("z"))
    docs = docs.drop("block", "first")
    old, new = new_dir(spark, "old"), new_dir(spark, "new")
    reshard.write_old(docs, old)
    layout = reshard.plan(reshard.read_old(spark, old), 5)
    got = reshard.with_slots(reshard.rewrite(spark, old, new, layout)).collect()
    assert len(got) == len(rows)
    load = collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.2 * sum(load.values()) / 5
    empty_old = new_dir(spark, "old")
    reshard.write_old(docs.limit(0), empty_old)
    schema = docs.schema
    nothing = reshard.plan(spark.createDataFrame([], schema), 5)
    assert nothing.moved == 0 and nothing.losing == []


# ---- 9 ----


def word_sets(rows):
    sets = []
    for _, t in rows:
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return sets


def linked(rows):
    sets = word_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(name, least.get(find(i), name))
    return sorted((name, len(sets[i]), least[find(i)] if sets[i] else name) for i, (name, _) in enumerate(rows))


def near_copies():
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(12):
        words = [random.choice(vocabulary) for _ in range(random.choice([3, 5, 6, 8, 12, 20, 60, 200]))]
        for _ in range(9):
            own = list(words)
            for _ in range(random.choice([0, 0, 1, 1, 2, 5])):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(own) if family % 2 else " ".join(own).upper() + "\n"))
    return [*rows, (900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  TWO"), (905, "one two three four"), (906, "a b c d e"), (907, "a b c d e"), (907, "a b c d e")]


@pytest.mark.parametrize("family_bytes", [100, 1 << 20])
def test_jaccard_join_against_brute_force(spark, family_bytes):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, deal=3, centres=2, family_bytes=family_bytes).collect())
    assert got == linked(rows)
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({c for _, n, c in linked(rows) if n} | {900, 901, 902})


def test_one_of_each_where_ids_are_shared(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    # Id 1 names three groups, two of which have a copy under another id.
    rows = [(1, a, "x"), (2, a, "x"), (1, b, "y"), (3, b.upper(), "y"), (1, c, "z"), (1, c.upper(), "z"), (4, "v w x y z aa", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string")
    for parts in (1, 5):
        got = sorted(tuple(r) for r in jaccard_join.one_of_each(docs.repartition(parts)).collect())
        assert got == sorted([(1, a, "x"), (1, b, "y"), (1, c.upper(), "z"), (4, "v w x y z aa", "w")])


def test_jaccard_join_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op9_jaccard_join(spark, SF_DIR).collect()) == linked(rows)


def test_jaccard_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.join(docs).collect()))
    assert got == [(0, 0), (0, 1), (1, 1)]
    assert jaccard_join.join(docs.limit(0)).count() == 0 and jaccard_join.one_of_each(docs).count() == 3


def test_signatures_of_a_block_are_unpacked_in_parts():
    """Those that several classes have, and no more memory than a part of the block takes."""
    rng = np.random.default_rng(11)
    n, parts = 400_000, []
    for _ in range(4):
        names = np.unique(rng.integers(1, 1 << 62, 1000))
        sig, who, own = rng.integers(0, 1 << 19, n // 4) << 20, rng.integers(0, len(names), n // 4).astype("<u2"), rng.integers(0, 8, n // 4) == 0
        high = (sig >> 32).astype(np.uint8) | own.astype(np.uint8) << 7
        parts.append(((sig & 0xFFFFFFFF).astype("<u4"), high, who, names, rng.integers(1, 99, (len(names), 2)).astype("<u2")))
    tracemalloc.start()
    got, largest = [], 0
    for x in jaccard_join._met(parts):
        got.append(x)
        largest = max(largest, len(x[0]))
    held = sum(a.nbytes for x in got for a in x)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    want = {}
    for low, high, who, names, need in parts:
        for s, h, w in zip(low.tolist(), high.tolist(), who.tolist(), strict=True):
            want.setdefault(s | (h & 127) << 32, set()).add((int(names[w]), h >> 7, int(need[w, h >> 7])))
    want = {s for s, x in want.items() if len({k for k, _, _ in x}) > 1 and any(o for _, o, _ in x)}
    assert {int(s) for x in got for s in x[0]} == want and largest < n // 4
    assert peak < 20 * n  # at once they would take some 60 bytes each


def test_linked_sets_share_a_signature():
    """Sets at the very threshold, in one band and in neighbouring ones."""
    rng = np.random.default_rng(10)
    for size in (3, 4, 5, 7, 9, 12, 20, 40, 90, 300):
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = rng.integers(0, len(a) // 4 + 1)
            b = np.delete(a, rng.choice(len(a), drop, replace=False))
            add = 0
            while 100 * len(b) >= 75 * (len(a) + add + 1):
                add += 1
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            if len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            s, w, own, need = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            shared = set(s[w == 0].tolist()) & set(s[w == 1].tolist())
            assert shared, (len(a), len(b))
            # Both share as many signatures in a common band as they say a link needs.
            least = [[len(shared & set(s[(w == i) & (own == bool(k))].tolist())) >= need[i, k] for k in (0, 1)] for i in (0, 1)]
            assert any(least[0]) and any(least[1])


def test_components(spark):
    random.seed(11)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in lone}


# ---- pipeline ----


@pytest.mark.skipif(not os.path.isfile(queries.TOKENIZER), reason="no tokenizer file")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "token_output":
            break
        kept = stage(spark, kept, SF_DIR).cache()
        assert kept.columns == docs.columns
        seen[name] = [tuple(r) for r in kept.select("doc_id", "text", "source").collect()]
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    rejected = set(whole) - {r[0] for r in seen["language_id"]}
    assert len(rejected) <= 2
    want = {c for _, _, c in linked([r[:2] for r in seen["language_id"]])}
    assert sorted(r[0] for r in seen["ngram_jaccard_join"]) == sorted(want)
    dirty = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    assert {r[0] for r in seen["decontamination"]} == want - dirty
    assert {r[0] for r in seen["mixing"]} <= want - dirty
    copies = collections.Counter(r[0] for r in seen["mixing"])
    assert max(copies.values()) <= 3
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in seen["mixing"])


def test_members_of_large_families_meet_near_sizes_only(spark, monkeypatch):
    """Sets of far sizes are not sent to each other; links at the very threshold are found, in one component or several."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(100 * k + i, " ".join(words[: n - i % 2 * (n // 9)] + [f"x{k}"])) for k, n in enumerate((40, 160, 640, 2560)) for i in range(9)]
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t in rows}
    values = {x: i for i, x in enumerate(sorted(set().union(*sets.values())))}
    members = [(1, len(rows), d, np.array(sorted(values[x] for x in s), "<u8").tobytes()) for d, s in sets.items()]
    sent = []
    kept = jaccard_join.settled
    monkeypatch.setattr(jaccard_join, "settled", lambda df, label: (sent.append(kept(df, label)), sent[-1])[1] if label == "jaccard-reach" else kept(df, label))
    df = spark.createDataFrame(members, "family long, n long, class long, set binary")
    got = {r["node"]: r["root"] for r in jaccard_join._large_families(df, 75, 3, 2).collect()}
    linked_ = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked_ and all(got[a] == got[b] for a, b in linked_)
    assert len({got.get(d, d) for d in sets}) == 4
    assert all(r["last_part"] - r["first_part"] < 5 for r in sent[0].collect())  # of 12 parts


def test_classes_that_share_too_few_signatures_are_no_family(spark):
    """Each of a chain shares as many signatures as a link needs, but fewer with any one other; the last two share enough."""
    rows = [(s, c, True, 2) for s in range(1, 30) for c in (s, s + 1)] + [(99, 30, True, 2), (99, 31, True, 2), (98, 30, True, 2), (98, 31, True, 2)]
    shared = spark.createDataFrame(rows, "signature long, class long, own boolean, need int")
    assert [tuple(r) for r in jaccard_join._families(shared).collect()] == [(30, 31)]


@pytest.mark.parametrize("crowd", [1, 2, 5, 64])
def test_linked_classes_are_in_one_family(spark, crowd):
    rows = [r for r in near_copies() if r[1]]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    shared = jaccard_join._shared(jaccard_join._blocks(texts, 3, 5, 75), 3)
    family = {r["node"]: r["root"] for r in components(jaccard_join._families(shared, crowd=crowd)).collect()}
    name = {r["doc_id"]: r["class"] for r in jaccard_join.classes(texts).collect()}
    sets = word_sets(rows)
    links = [(name[a[0]], name[b[0]]) for (a, x), (b, y) in itertools.combinations(zip(rows, sets, strict=True), 2) if x != y and 100 * len(x & y) >= 75 * len(x | y)]
    assert len(links) > 50 and all(family[a] == family[b] for a, b in links)
