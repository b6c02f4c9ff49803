"""Language identification, token files, decontamination, licence and secret scans on small tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from armature.llm import decontaminate, langid, license_scan, queries, secret_scan, token_files
from armature.llm.textarrays import flat, shingles
from armature.session import new_dir

SF_DIR = "/root/testdata/sf0.001"
HAVE = os.path.isfile(queries.TOKENIZER)


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_shingles_are_those_of_words():
    texts = ["A b  c d\te f", "a B c d e f", "a b", "a  B\n", "", None, " \n", "one two three four five"]
    found, where = shingles(*flat(pa.array(texts)))
    sets = [set(found[where == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert sets[2] == sets[3] and len(sets[2]) == 1
    assert sets[4] == sets[5] == sets[6] == set() and len(sets[7]) == 1


# ---- 2 ----


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = queries.op2_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edge_cases(spark):
    model = langid.fit(["the house and the garden"] * 30 + ["das Haus und der Garten"] * 30, ["en", "de"] * 0 + ["en"] * 30 + ["de"] * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the garden and the house", "x"), (4, "der Garten und das Haus", "x"), (None, "the house", "x"), (7, "the house and " * 200_000, "x")]
    docs = docs_of(spark, rows, "doc_id long, text string, score string").withColumn("_letters", F.lit(1)).withColumn("letters", F.lit(2))
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "_letters", "letters", "lang_pred", "score", "rejected"]
    by = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in got.collect()]
    assert sorted(b for b in by if b[0] in (1, 2, 3)) == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert (4, "en", False) in by and (4, "de", False) in by and any(b[0] is None and b[1] == "en" for b in by)
    assert [b for b in by if b[0] == 7][0][1] == "en"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(docs.limit(0).withColumn("lang", F.lit("x")))).collect()} == {"und"}


def test_long_texts_are_scored_whole(spark):
    model = langid.fit(["the house and the garden"] * 30 + ["das Haus und der Garten"] * 30, ["en"] * 30 + ["de"] * 30)
    text = ("the house " * 300_000 + "das Haus " * 20).encode()
    whole = langid.scores(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    before, langid.CHUNK = langid.CHUNK, len(text) + 1
    try:
        at_once = langid.scores(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    finally:
        langid.CHUNK = before
    assert np.allclose(whole, at_once)


# ---- 4 ----


@pytest.mark.skipif(not HAVE, reason="no tokenizer file")
def test_words_split_like_the_tokenizer():
    random.seed(1)
    enc = token_files.Encoder(queries.TOKENIZER)
    marks = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "9", "½", "!", "中", "😀", "'ve", "\x1c", "\x85", "​", "<|endoftext|>"]
    texts = ["".join(random.choice(marks[: random.choice([14, 21])]) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    ids, n = enc.encode(*flat(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.tolist() for x in enc.whole(texts)]


@pytest.mark.skipif(not HAVE, reason="no tokenizer file")
def test_token_files_round_trip(spark):
    texts = [(3, "Hello world"), (1, None), (2, ""), (2, "again"), (2, "again"), (None, "no id"), (9, "x y " * 50_000)]
    docs = docs_of(spark, texts).withColumn("start", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    out = new_dir(spark, "tokens")
    manifest = token_files.write_tokens(docs, out, queries.TOKENIZER, 2, part_bytes=2000)
    got = sorted(token_files.read_documents(spark, out, with_ids=True).collect(), key=lambda r: r["start"])
    enc = token_files.Encoder(queries.TOKENIZER)
    left = list(texts)
    ordered = []
    for r in got:  # rows with the same id may come in any order
        ids = [t for t in left if t[0] == r["doc_id"] and [*enc.whole([t[1] or ""])[0].tolist(), 2] == r["ids"]]
        ordered.append(ids[0])
        left.remove(ids[0])
    assert not left and [r["doc_id"] or 0 for r in got] == sorted(t[0] or 0 for t in texts)
    at = 0
    for r, (name, text) in zip(got, ordered, strict=True):
        ids = [*enc.whole([text or ""])[0].tolist(), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (name, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == at
    empty = new_dir(spark, "tokens")
    token_files.write_tokens(docs.limit(0), empty, queries.TOKENIZER, 2)
    assert token_files.read_documents(spark, empty).count() == 0


# ---- 10 ----


def test_reparameterised_questions_are_found(spark):
    item = "A train leaves the station at 9 with Alice on board and travels 120 km to the city where Bob waits for 3 hours."
    other = "What is the capital of the country that borders both seas and has more than 40 large islands in the north?"
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "Short item here"), (6, item)], "item_id long, text string")
    changed = item.replace("9", "11").replace("Alice", "Carla").replace("120 km", "75 miles").replace("Bob", "Dirk").replace("3 hours", "6 days")
    twice = "We bought 3 apples for Anna and 3 pears for Anna and then 5 plums for Otto at the market near the old bridge."
    mixed = twice.replace("3 apples", "7 apples").replace("3 pears", "8 pears")
    bench2 = spark.createDataFrame([(7, twice)], "item_id long, text string")
    rows = [(10, "Intro text. " + item + " More text."), (11, "Intro " + changed + " end"), (12, "Nothing of interest here at all, only prose of an ordinary kind."), (13, None), (14, ""), (None, item), (16, item.lower()), (16, "short ITEM, here!")]
    docs = docs_of(spark, rows).withColumn("item_id", F.lit(0)).withColumn("share", F.lit(0))
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["n_changed"] > 0) for r in decontaminate.contaminated(docs, benchmark).collect()))
    assert got == [(0, 1, False), (0, 6, False), (10, 1, False), (10, 6, False), (11, 1, True), (11, 6, True), (16, 5, False)] or got == [
        (0, 1, False), (0, 6, False), (10, 1, False), (10, 6, False), (11, 1, True), (11, 6, True), (16, 1, False), (16, 5, False), (16, 6, False)]
    blocked = decontaminate.contaminated(docs, benchmark, block_bytes=50)
    assert sorted((r["doc_id"] or 0, r["item_id"], r["n_changed"] > 0) for r in blocked.collect()) == got
    clean = [r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()]
    assert set(clean) == {12, 13, 14} | ({16} if len(got) == 7 else set()) and decontaminate.clean(docs, benchmark).columns == docs.columns
    # A value that became two different ones is no consistent exchange.
    strict = decontaminate.contaminated(docs_of(spark, [(1, mixed), (2, twice.replace("3", "7"))]), bench2).collect()
    found = {r["doc_id"]: r["n_windows"] for r in strict}
    assert found[2] > found.get(1, 0)
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_names_that_begin_sentences_are_exchanged(spark):
    item = "Tom has 5 red apples in his bag. Anna gives him 3 more apples after school. How many apples does Tom have now?"
    heavy = "Peter carries a box of 12kg from the store to the old house on the hill.\nMaria helps him there."
    changed = item.replace("Tom", "Mia").replace("Anna", "Cara").replace("5", "7").replace("3", "4")
    glued = heavy.replace("Peter", "Hugo").replace("12kg", "30 lb").replace("Maria", "Jana").replace("\n", " ")
    rows = [(1, changed), (2, "We read: " + changed.replace(". ", ".\n") + " Then we left."), (3, item.replace(". ", " ")), (4, glued), (5, heavy), (6, changed.replace("does Mia", "does Otto"))]
    benchmark = spark.createDataFrame([(1, item), (2, heavy)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert set(got) >= {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)} and not {(k, 2) for k in (1, 2, 3, 6)} & set(got)
    assert got[1, 1]["share"] == got[2, 1]["share"] == got[4, 2]["share"] == 1.0 and got[1, 1]["n_changed"] > 0
    # Tom became two people.
    assert (6, 1) not in got or got[6, 1]["share"] < 1.0
    assert [r["doc_id"] for r in decontaminate.clean(docs_of(spark, [(1, changed), (7, "Mia has a dog.")]), benchmark).collect()] == [7]


def test_verbatim_copies_with_few_literals_are_found(spark):
    items = ["What is 15 + 27 * 3 - 8?", "Compute 12 * 34 + 56 * 78.", "Solve 3x + 5 = 20.", "What is 25% of 480?", "Add 4 to 9, 16 to 25, 36 to 49, 64 to 81 and then name the next number of the row"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(k, f"Intro. {t} The end.") for k, t in enumerate(items)] + [(10, "What is 16 + 28 * 4 - 9? What is 30% of 500?"), (11, items[4].upper()), (12, items[4].split(" next")[0]), (13, "Solve it.")]
    docs = docs_of(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(got) == {(k, k) for k in range(5)} | {(11, 4), (12, 4)}
    assert all(r["n_changed"] == 0 and r["n_windows"] <= r["item_windows"] and r["share"] <= 1.0 for r in got.values())
    assert got[0, 0]["share"] == got[4, 4]["share"] == got[11, 4]["share"] == 1.0 and 0.5 <= got[12, 4]["share"] < 1.0
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()) == [10, 13]


def test_benchmark_passages_of_the_documents(spark):
    """Brute force: a document with all words of an item in a row is reported, and one without eight of them is not."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    flat_words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if f" {flat_words(i['text'])} " in f" {flat_words(d['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontaminate(spark, SF_DIR).collect()}
    assert want == got and want


# ---- 1 ----


def test_licences(spark):
    model = license_scan.train(spark)
    held = [(k, p, f) for k, (p, f, kept) in enumerate(license_scan.labelled()) if kept]
    found = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, [(k, p.replace("\n", " ")) for k, p, _ in held]), model).collect()}
    families = [(f, found[k]["family"] if k in found else license_scan.UNKNOWN) for k, _, f in held]
    assert np.mean([a == b for a, b in families]) > 0.9
    assert all(b == license_scan.UNKNOWN for a, b in families if a == license_scan.UNKNOWN)
    rows = [(1, "Intro\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "The driver needs a license"), (4, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"), (None, "Released under the MIT License."), (6, "word " * 100_000 + "license")]
    docs = docs_of(spark, rows).withColumn("family", F.lit("x")).withColumn("words", F.lit("y"))
    got = sorted(((r["doc_id"] or 0), r["paragraph"], r["family"], r["confirmed"]) for r in license_scan.scan(docs, model).collect())
    assert got == [(0, 0, "mit", True), (1, 1, "mit", True), (1, 2, "cc-by-nc", True), (4, 0, "apache-2.0", True)]
    assert license_scan.scan(docs.limit(0), model).count() == 0


def test_wrapped_licences(spark):
    model = license_scan.train(spark)
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
    filler = "\n".join(["some words of a long text that has no blank line in it at all"] * 30)
    longest = max(len(re.findall(r"[^\W_]+", x)) for texts in license_scan.TEMPLATES.values() for x in texts)
    assert longest <= license_scan.STRETCH
    commented = "import os\n\n# " + gpl.replace("\n", "\n# ") + "\n#\n# Other words.\n"
    rows = [(1, "MIT\n\n" + mit), (2, commented), (3, "Intro\n \t\n" + bsd), (4, filler + "\n" + mit + "\n" + filler), (5, "Er ging mit dem Hund.\nSie kam mit der Katze\nund mit dem Zug."), (5, "one\ntwo"), (None, gpl.replace(" ", "\n"))]
    got = {((r["doc_id"] or 0), r["paragraph"], r["family"]) for r in license_scan.scan(docs_of(spark, rows), model).collect() if r["confirmed"]}
    assert got == {(0, 0, "gpl"), (1, 2, "mit"), (2, 2, "gpl"), (3, 2, "bsd"), (4, 0, "mit")}
    assert {r["doc_id"] for r in license_scan.scan(docs_of(spark, rows), model).collect()} == {None, 1, 2, 3, 4}


# ---- 8 ----

PATTERNS = [
    re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in PATTERNS[2].finditer(text) if len(m.group()) >= 24]
    return sorted(found)


def test_secrets_against_regular_expressions(spark):
    random.seed(2)
    marks = ["secret", "token", ":", "=", " ", '"', "a", "é", "😀", "AKIA", "ABCDEFGHIJKLMNOPQ0", "0123456789abcdef", "\n", "api_key", "APIKEY", "password", "-", "ſecret"]
    rows = [(i, "".join(random.choice(marks) for _ in range(random.randint(0, 30)))) for i in range(400)] + [(500, None), (None, "token=abcdef"), (502, ""), (503, "token=abcdef"), (503, "token=abcdef")]
    docs = docs_of(spark, rows).withColumn("found", F.lit(1)).withColumn("_t", F.lit("x")).withColumn("_base", F.lit("y"))
    ratios = secret_scan.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    got = secret_scan.scan(docs, ratios).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s["start"], s["kind"], s["end"]) for s in r["found"] if s["kind"] < 3] == base_spans(r["text"] or "")
    assert secret_scan.scan(docs.limit(0), ratios).count() == 0


def test_random_strings_are_told_from_identifiers(spark):
    ratios = secret_scan.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    random.seed(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(random.choice(letters) for _ in range(32)) for _ in range(60)]
    plain = ["getCustomerAddressById", "MAX_CONNECTION_TIMEOUT_MS", "internationalization", "2024010112345678", "-" * 30, "the_quick_brown_fox_jumps", "https//example/path/to/file"]
    got = {r["text"]: r["found"] for r in secret_scan.scan(docs_of(spark, list(enumerate(keys + plain))), ratios).collect()}
    assert sum(bool(got[k]) for k in keys) >= 57 and not any(got[p] for p in plain)
    clean = secret_scan.scan(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"), ratios)
    assert clean.filter(F.exists("found", lambda s: s["kind"] == 3)).count() == 0


def test_secret_digest(spark):
    for r in queries.op8_secret_scan(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        spans = base_spans(r["text"] or "")
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_secret_scan_of_very_long_runs_and_many_tokens(spark):
    """A run of a million characters, and ten thousand tokens in one text, are judged whole."""
    import random
    import string

    random.seed(1)
    token = lambda n: "".join(random.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts = ["x " + token(1_000_000) + " y", " ".join(token(24) for _ in range(10_000)), "get_user_" * 20_000]
    ratios = secret_scan.fit(secret_scan.random_strings(spark).unionByName(secret_scan.ordinary_strings(spark)))
    got = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in got[0].found] == [(2, 1_000_002)]
    assert len(got[1].found) > 9_900 and got[2].found == []
