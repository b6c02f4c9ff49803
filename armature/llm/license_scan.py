"""License scans: a trained paragraph classifier over sparse word n-grams.

Candidates are single lines and the joined lines of paragraphs, which end at lines without a letter or digit
(bare comment marks count as such). Paragraphs of several lines are read in stretches of 2 * STRETCH words that begin every
STRETCH words, so each run of as many words, more than any template has, lies whole in one. A candidate's features are its
word n-grams (one to three lower-cased words) that hold at least one cue word. All with a cue word or a stem of a licence word
are scored; others are of no family. A multinomial
logistic regression over these features is fitted on labelled paragraphs made from the templates below
(whole, in parts, with other names and years) and on ordinary paragraphs that use the same
words, the class `unknown`. A family is predicted when its probability passes a threshold calibrated on labelled
paragraphs kept out of the fit, else the paragraph is unknown. A prediction is confirmed when the
best template of its family shares enough of its word trigrams with the paragraph.

A paragraph's stretches add a row for a family that they confirm and no single line of it does, and one for an
unconfirmed family where nothing else of the paragraph is of any.

Everything is DataFrame functions and Spark's own logistic regression: one pass over the texts, no
shuffle of texts (only of the outcomes) and no Python on executors. Templates, vocabulary and weights don't grow with the corpus.

Defined cases: null and empty texts have no paragraphs; a text that is one very long line is one paragraph;
rows are judged one by one, so repeated rows and null ids repeat their results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Share of labelled ordinary paragraphs, kept out of the fit, that may pass the threshold, and its least value.
FALSE_SHARE = 0.0
LEAST = 0.5
#: Share of a template's trigrams that confirms a prediction.
CONFIRM = 0.6
#: Words of any stretch that is seen whole; the longest template has fewer.
STRETCH = 64

#: Words that features must hold one of.
CUES = (
    "license licence licensed licences licenses licensing sublicense copyright copyrighted copyleft permission permissions warranty warranties "
    "redistribution redistributions redistribute spdx gpl lgpl agpl gnu apache mit isc bsd mozilla mpl unlicense cc cc0 creativecommons commons "
    "noncommercial attribution sharealike proprietary confidential unencumbered merchantability infringement"
).split()
#: What a lower-cased candidate must hold one of to be looked at, if not a cue word.
STEMS = "licen|copyr|copyleft|permission|warrant|redistribut|spdx|gpl|cc by|cc-by|cc0|proprietary|merchantab|all rights|unencumbered"
LOOKED_AT = STEMS + r"|(?<![\p{L}\p{N}])(?:" + "|".join(CUES) + r")(?![\p{L}\p{N}])"

#: Notices of licence families, as they stand in headers and documents.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain under the Unlicense.",
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ],
    "proprietary": [
        "Copyright 2020 Example Corporation. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the copyright owner.",
    ],
}

#: Ordinary paragraphs with the same words.
ORDINARY = [
    "The driver showed an expired license to the officer.",
    "Her fishing licence is valid until the end of the season.",
    "He asked for permission to leave the room early.",
    "The warranty on the washing machine covers two years.",
    "Copyright law differs from country to country.",
    "The license plate was covered with mud.",
    "The Apache helicopter landed behind the hill.",
    "Students at MIT presented their robots last week.",
    "The redistribution of income was debated in parliament.",
    "The house of commons voted on the proposal.",
    "A business license costs fifty dollars a year.",
    "They were permitted to enter after the concert.",
    "The wildebeest and the gnu graze on the same plains.",
    "The teacher gave permission for a copy of the book to be used in class.",
    "Attribution of the painting to the young master is uncertain.",
    "The store sells software, licenses and hardware of any kind.",
    "The pilot renewed his licence under the new rules.",
    "Proprietary blends of spices make the dish special.",
    "This letter is confidential and for you alone.",
    "The lawyer explained the patent, the license fee and the terms.",
    "We walked across the commons in the morning sun.",
    "Licensing of taxi drivers is a task of the city.",
    "The poet took some license with the facts.",
    "An infringement of the rules leads to a penalty.",
    "No warranty was given when the used car was sold.",
    "Please send a copy of your license and permit to the office.",
    "The version of the story that he told was free of details.",
    "The Mozilla office is on the third floor.",
    "You may use the room with the permission of the owner.",
    "The general public was not admitted to the hearing about the license.",
    "Er kam mit dem Zug und ging mit seiner Schwester nach Hause.",
    "Das Haus mit dem roten Dach steht am Ende der Stadt.",
    "Wir fahren mit den Kindern an das Meer.",
    "Sie spricht mit ihm und mit der Mutter.",
    "Ein Brot mit Butter, bitte.",
    "Mit der Zeit wurde es still.",
]


def words_of(paragraph: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column, size: int) -> Column:
    """All runs of `size` words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.concat_ws(" ", F.slice(words, i + 1, size)))).otherwise(F.array().cast("array<string>"))


def features(words: Column) -> Column:
    """n-grams of one to three words with a cue in them; stretches away from cues are not looked at."""
    cues = F.array(*[F.lit(c) for c in CUES])
    at = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(cues, w), i).otherwise(-1)), lambda i: i >= 0)

    def around(i: Column) -> Column:
        out = []
        for size in (1, 2, 3):
            for back in range(size):
                begin = i - back
                out.append(F.when((begin >= 0) & (begin + size <= F.size(words)), F.concat_ws(" ", F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.lit(size)))))
        return F.array_compact(F.array(*out))

    return F.array_distinct(F.flatten(F.transform(at, around)))


# ---- training ----


@lru_cache(1)
def labelled() -> list[tuple[str, str, bool]]:
    """Paragraph, family, and whether it is kept for calibration."""
    out = []
    fronts = ["", "# ", "// ", " * ", "Copyright (c) {y} {n}. ", "{n} {y}: "]
    names, years = ["Jane Doe", "The Authors", "Example Foundation", "Contributors"], ["1999", "2007", "2015", "2021"]
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, ORDINARY)]:
        for k, text in enumerate(texts):
            parts = [text]
            pieces = text.replace(";", ",").split(", ")
            if family != UNKNOWN and len(pieces) > 2:
                half = len(pieces) // 2
                parts += [", ".join(pieces[:half]), ", ".join(pieces[half:])]
            for part in parts:
                for j, front in enumerate(fronts):
                    if family == UNKNOWN and j > 3:
                        continue
                    head = front.format(y=years[(j + k) % 4], n=names[(j + k) % 4])
                    out.append((head + part, family, (j + k) % 4 == 3))
    return out


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]  # by word n-gram, then class
    bias: tuple[float, ...]
    threshold: float


def train(spark: SparkSession) -> Model:
    """Fit on the labelled paragraphs, some hundreds; their count is that of the fixed values above."""
    rows = labelled()
    classes = sorted({f for _, f, _ in rows})
    data = _rows(spark, [{"paragraph": p, "label": float(classes.index(f)), "held": held} for p, f, held in rows], "paragraph string, label double, held boolean")
    data = data.withColumn("words", words_of(F.col("paragraph"))).withColumn("grams", features(F.col("words")))
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=1 << 16).fit(data.filter("not held"))
    ready = counter.transform(data).cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False).fit(ready.filter("not held"))
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    # The threshold stands over all ordinary paragraphs kept out of the fit.
    unknown = classes.index(UNKNOWN)
    over = [max(x for i, x in enumerate(r["probability"]) if i != unknown) for r in fitted.transform(ready.filter("held and label = " + str(unknown))).select("probability").collect()]
    ready.unpersist()
    over.sort()
    false = over[min(len(over) - 1, math.floor(len(over) * (1 - FALSE_SHARE)))] if over else 0.0
    return Model(tuple(classes), tuple(counter.vocabulary), tuple(tuple(round(float(x), 6) for x in col) for col in weights.T), tuple(round(float(x), 6) for x in bias), min(0.9, max(LEAST, false)))


# ---- scan ----


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schema.split(", "))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _texts(values: list[str]) -> Column:
    """A constant array of texts without line ends."""
    return F.split(F.lit("\n".join(values)), "\n")


def _templates(spark: SparkSession) -> dict[str, list[list[str]]]:
    rows = _rows(spark, [{"family": f, "k": k, "t": t} for f, texts in TEMPLATES.items() for k, t in enumerate(texts)], "family string, k int, t string")
    words = words_of(F.col("t"))
    out: dict[str, list[list[str]]] = {}
    for r in rows.select("family", "k", F.array_distinct(F.when(F.size(words) < 3, F.array(F.concat_ws(" ", words))).otherwise(grams(words, 3))).alias("g")).orderBy("family", "k").collect():
        out.setdefault(r["family"], []).append(r["g"])
    return out


def classified(lines: DataFrame, model: Model) -> DataFrame:
    """Rows with words, as they are, with family and probability of the likeliest class."""
    n = len(model.classes)
    flat = F.split(F.lit(",".join(repr(x) for w in model.weights for x in w)), ",").cast("array<double>")
    bias = F.split(F.lit(",".join(repr(x) for x in model.bias)), ",").cast("array<double>")
    place = F.transform(features(F.col("words")), lambda g: F.array_position(_texts(list(model.vocabulary)), g).cast("int"))
    added = F.aggregate("_at", bias, lambda acc, i: F.zip_with(acc, F.slice(flat, (i - 1) * n + 1, n), lambda a, b: a + b))
    scored = lines.withColumn("_at", F.filter(place, lambda i: i > 0)).withColumn("_l", added).withColumn("_top", F.array_max("_l"))
    sums = F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top")))
    family = F.get(_texts(list(model.classes)), (F.array_position("_l", F.col("_top")) - 1).cast("int"))
    # A row of one made by explode: filters on the outcome are then not evaluated below, several times over.
    out = scored.withColumn("_best", F.explode(F.array(F.struct(family.alias("family"), (F.lit(1.0) / sums).alias("probability")))))
    return out.select("*", "_best.family", "_best.probability").drop("_at", "_l", "_top", "_best")


def candidates(docs: DataFrame) -> DataFrame:
    """Lines and stretches of paragraphs to be scored: place of the row and first line of the paragraph (_row, _block), paragraph, joined, cut sides, words, notice."""
    rows = docs.filter(F.lower("text").rlike(LOOKED_AT)).withColumn("_row", F.monotonically_increasing_id())
    # Lines get their number before them; a line without a letter or digit becomes a mark between paragraphs.
    lines = F.split(F.translate("text", "\x01\x02\x03", "   "), "\n")
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x03"), x)).otherwise("\x02"))
    blocks = rows.select("doc_id", "_row", F.explode(F.split(F.array_join(marked, "\n"), "\x02")).alias("_text")).filter(F.lower("_text").rlike(LOOKED_AT))
    blocks = blocks.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x != "")).withColumn("_block", F.regexp_extract("_text", "\x01([0-9]+)\x03", 1).cast("long"))
    # A row of one made by explode: the words are then not cut again for each use.
    words = words_of(F.regexp_replace("_text", "\x01[0-9]+\x03", " "))
    blocks = blocks.withColumn("_words", F.explode(F.array(F.when(F.size("_lines") > 1, words).otherwise(F.array().cast("array<string>")))))
    n = F.size("_words")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - STRETCH - 1, F.lit(0)), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))

    def one(x: Column) -> Column:
        text = F.substring_index(x, "\x03", -1)
        number = F.regexp_extract(x, "\x01([0-9]+)\x03", 1).cast("long")
        return F.struct(number.alias("paragraph"), F.lit(False).alias("joined"), F.lit(False).alias("cut_before"), F.lit(False).alias("cut_after"), words_of(text).alias("words"), text.alias("notice"))

    def stretch(i: Column) -> Column:
        part = F.slice("_words", i + 1, F.lit(2 * STRETCH))
        return F.struct(F.col("_block").alias("paragraph"), F.lit(True).alias("joined"), (i > 0).alias("cut_before"), (i + 2 * STRETCH < n).alias("cut_after"), part.alias("words"), F.array_join(part, " ").alias("notice"))

    single = F.transform(F.filter("_lines", lambda x: F.lower(x).rlike(LOOKED_AT)), one)
    cues = F.array(*[F.lit(c) for c in CUES])
    whole = F.filter(F.transform(starts, stretch), lambda x: F.arrays_overlap(x["words"], cues))
    return blocks.select("doc_id", "_row", "_block", F.explode(F.concat(single, whole)).alias("_c")).select("doc_id", "_row", "_block", "_c.*")


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """A row for each notice: doc_id, paragraph (number of its first line, from 0), family, probability, similarity, confirmed, notice.

    The notice of joined lines is the words of the stretch.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    best = classified(candidates(rows), model)
    found = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold)).withColumn("trigrams", grams(F.col("words"), 3))
    shares, edges = [], []
    for family, own in _templates(docs.sparkSession).items():
        each = [F.size(F.array_intersect("trigrams", _texts(g))) / len(g) for g in own]
        shares.append(F.when(F.col("family") == family, F.greatest(*each) if len(each) > 1 else each[0]))
        ends = _texts(sorted({x for g in own for x in g}))
        clipped = (F.col("cut_before") & F.array_contains(ends, F.get("trigrams", F.lit(0)))) | (F.col("cut_after") & F.array_contains(ends, F.element_at("trigrams", -1)))
        edges.append(F.when(F.col("family") == family, clipped))
    clipped = F.when(F.col("cut_before") | F.col("cut_after"), F.coalesce(*edges)).otherwise(False)
    close = found.withColumn("similarity", F.coalesce(*shares)).withColumn("confirmed", F.col("similarity") >= confirm).withColumn("_clipped", F.coalesce(clipped, F.lit(False)))
    close = close.select("doc_id", "_row", "_block", "paragraph", "joined", "family", "probability", "similarity", "confirmed", "_clipped", "notice")

    block, same = Window.partitionBy("_row", "_block"), Window.partitionBy("_row", "_block", "family")
    order = same.orderBy("joined", F.desc("confirmed"), F.desc("similarity"), F.desc("probability"))
    seen = close.withColumn("_line_of_it", F.max(F.expr("not joined and confirmed")).over(same)).withColumn("_others", F.max(F.expr("not joined or confirmed")).over(block)).withColumn("_most", F.max("similarity").over(block))
    seen = seen.withColumn("_place", F.row_number().over(order)).withColumn("_lines", F.sum(F.expr("if(joined, 0, 1)")).over(same))
    # A notice that a stretch's end cuts may look like that of another family; the next stretch has it whole.
    added = F.expr("joined and _place = _lines + 1 and not (_clipped and similarity < _most)") & F.when(F.col("confirmed"), ~F.col("_line_of_it")).otherwise(~F.col("_others"))
    return seen.filter(~F.col("joined") | added).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed", "notice")
