"""Operator 2, license scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line with a word, or a block of such lines up to a blank one, joined,
as licence texts are mostly wrapped. Its features are the word n-grams, one to three
words long, that hold an anchor word (license, permission, gnu, ...). Multinomial
logistic regression over them gives each licence family, and an unknown class, a
probability; a temperature fitted on held-out paragraphs calibrates these. A family is
reported if its probability passes a bound and a template of the same family shares
enough of its word pairs with the paragraph.

The model is trained here, on paragraphs made from the templates below: some 2,000,
whatever the corpus, so that weights and templates have a fixed size. Paragraphs
without an anchor have no features and are unknown by construction; the others are
classified once for each distinct text, so a line that a third of all documents carry
is one row. Scoring is joins and aggregates only.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import WORD, fresh, join_hot, text_of, without

UNKNOWN = "unknown"
MIN_PROBABILITY, MIN_SIMILARITY = 0.7, 0.5
#: Paragraphs made for training from each template, and one in so many held out.
MADE, HELD_OUT = 24, 4

# Customary notices of licence families.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Distributed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "Released under CC BY-NC 4.0 for noncommercial use",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0",
        "Released into the public domain under CC0 1.0 Universal",
    ],
    "proprietary": [
        "All rights reserved",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher",
        "This software is proprietary and confidential. Unauthorized copying is prohibited",
    ],
}
#: What speaks of such things and grants nothing.
OTHER = [
    "A valid driving licence is required to rent a car",
    "The license plate of the car was lost",
    "He has permission to leave the room early",
    "She studied at MIT before she moved to the coast",
    "The public was asked to use the general entrance",
    "The museum has a license to sell drinks",
    "Creative people in common rooms like to talk",
    "The apache helicopter flew over the hills",
    "The fishing license costs ten dollars and the fee is due in May",
    "Please read the license before you install anything",
    "The software is distributed to schools in the city",
    "Copyright law was changed in that year and rights were reserved for authors",
    "A gnu is a large antelope and the mozilla is not",
    "The terms of the agreement were not published",
]
#: A feature holds one of these: words of the templates that prose in any language rarely has
#: (so not "mit", "by" or "sa", which features have beside an anchor).
ANCHORS = (
    "license licensed licence licenses apache gnu gpl lgpl agpl bsd mozilla mpl creative commons cc cc0 nc attribution "
    "sharealike noncommercial spdx identifier permission permitted redistribute redistribution software copyright rights reserved "
    "proprietary confidential waived domain public warranty"
).split()
_TOKEN = re.compile(r"[a-z0-9]+")
_ANCHORED = "(?i)\\b(" + "|".join(ANCHORS) + ")\\b"
#: A line without letters and digits (a comment's frame, say) parts blocks as a blank one does. Possessive: no recursion.
_LETTER = r"[\p{L}\p{N}]"
_BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
_FILLER = "the of this in work file text page note below here all code data and project see also by our team site".split()


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


def ngrams(words: list[str], most: int = 3) -> set[str]:
    """The distinct n-grams of up to ``most`` words that hold an anchor."""
    out = set()
    for n in range(1, most + 1):
        for i in range(len(words) - n + 1):
            part = words[i : i + n]
            if any(w in ANCHORS for w in part):
                out.add(" ".join(part))
    return out


def training_rows(seed: int = 7, left_out: int | None = None) -> tuple[list[set[str]], list[int], list[str]]:
    """Features and classes of paragraphs made from the templates by dropping and adding words.

    ``left_out`` leaves every family without its template of that number, to see how texts
    fare that no training paragraph was made from.
    """
    rng = random.Random(seed)
    classes = [UNKNOWN, *TEMPLATES]
    xs, ys = [], []

    def vary(words: list[str], drop: float) -> list[str]:
        kept = [w for w in words if rng.random() > drop] or words
        around = lambda: rng.choices(_FILLER, k=rng.randint(0, 4))
        return [*around(), *kept, *around()]

    for k, name in enumerate(classes):
        for i, t in enumerate(OTHER if k == 0 else TEMPLATES[name]):
            for _ in range(MADE if not k or i != left_out else 0):
                xs.append(ngrams(vary(tokens(t), 0.12)))
                ys.append(k)
    every = [w for ts in TEMPLATES.values() for t in ts for w in tokens(t)]
    for _ in range(len(ys) // 3):  # the words without their order, and prose with one of them
        words = rng.choices(every, k=rng.randint(2, 12)) if rng.random() < 0.4 else [*rng.choices(_FILLER, k=8), rng.choice(ANCHORS)]
        rng.shuffle(words)
        xs.append(ngrams(words))
        ys.append(0)
    return xs, ys, classes


@lru_cache(maxsize=4)
def model(left_out: int | None = None) -> tuple[dict[str, list[float]], list[float], list[str], float]:
    """(weights by feature, biases, classes, held-out accuracy); biases and weights are calibrated."""
    xs, ys, classes = training_rows(left_out=left_out)
    vocabulary = {g: i for i, g in enumerate(sorted({g for x in xs for g in x}))}
    x = np.zeros((len(xs), len(vocabulary)))
    for i, gs in enumerate(xs):
        for g in gs:
            x[i, vocabulary[g]] = 1 / max(1.0, len(gs)) ** 0.5
    y = np.eye(len(classes))[ys]
    held = np.arange(len(xs)) % HELD_OUT == 0
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    xt, yt = x[~held], y[~held]
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(400):  # gradient descent with momentum
        d = (soft(xt @ w + b) - yt) / len(xt)
        mw, mb = 0.9 * mw - 4.0 * (xt.T @ d + 1e-5 * w), 0.9 * mb - 4.0 * d.sum(axis=0)
        w, b = w + mw, b + mb
    z = x[held] @ w + b
    temperature = min((0.5 + 0.1 * k for k in range(40)), key=lambda t: -np.log(soft(z / t)[y[held] == 1] + 1e-12).sum())
    accuracy = float((z.argmax(axis=1) == y[held].argmax(axis=1)).mean())
    w, b = np.round(w / temperature, 6), np.round(b / temperature, 6)
    return {g: w[i].tolist() for g, i in vocabulary.items()}, b.tolist(), classes, accuracy


def held_out_recall(number: int) -> tuple[int, int]:
    """(families found, families asked) on the templates of that number, by a model that has not seen them."""
    weights, biases, classes, _ = model(number)
    right = asked = 0
    for family, ts in TEMPLATES.items():
        if len(ts) > number:
            grams = ngrams(tokens(ts[number]))
            z = np.array(biases) + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(classes))) / max(1, len(grams)) ** 0.5
            right, asked = right + (classes[int(z.argmax())] == family), asked + 1
    return right, asked


_WORDS = r"regexp_extract_all(lower(paragraph), '[a-z0-9]+', 0)"
_HAS = "exists(p, x -> x in (" + ", ".join(f"'{a}'" for a in ANCHORS) + "))"


def classify(paragraphs: DataFrame) -> DataFrame:
    """Distinct ``paragraph`` texts with family, probability and similarity.

    The family is ``unknown`` where the best class is, where its probability is below
    ``MIN_PROBABILITY``, or where no template of it reaches ``MIN_SIMILARITY``.
    """
    spark = paragraphs.sparkSession
    weights, biases, classes, _ = model()
    # weights have six places: their sums as decimals are the same in any order
    wide = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, w array<double>").withColumn("w", F.expr("transform(w, x -> cast(x as decimal(18, 6)))"))
    shapes = [(k, i, len(p), g) for k, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in [_pairs(tokens(t))] for g in p]
    shapes = spark.createDataFrame(shapes, "family string, template int, size int, gram string")
    # words are bound once for each paragraph: as a column they would be made anew for each n-gram
    bound = lambda body: F.expr(f"transform(array({_WORDS}), words -> {body})[0]")
    grams = f"array_distinct(flatten(transform(sequence(1, 3), n -> transform(filter(transform(sequence(1, greatest(size(words) - n + 1, 1)), i -> slice(words, i, n)), p -> size(p) = n and {_HAS}), p -> array_join(p, ' ')))))"
    pairs = "array_distinct(if(size(words) < 2, words, transform(sequence(1, size(words) - 1), i -> array_join(slice(words, i, 2), ' '))))"
    d = paragraphs.select("paragraph").distinct().select("paragraph", bound(grams).alias("grams"), bound(pairs).alias("pairs"))
    # weights and templates are of fixed size, some thousand rows
    hits = d.select("paragraph", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(wide), "gram")
    sums = hits.groupBy("paragraph").agg(F.first("n").alias("n"), *[F.sum(F.element_at("w", k + 1)).cast("double").alias(f"z{k}") for k in range(len(classes))])
    scale = F.lit(1.0) / F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    zs = [F.col(f"z{k}") * scale + F.lit(b) for k, b in enumerate(biases)]
    top = F.greatest(*zs)
    total = sum((F.exp(z - F.col("top")) for z in zs), F.lit(0.0))
    best = F.coalesce(*[F.when(z == F.col("top"), F.lit(c)) for z, c in zip(zs, classes, strict=True)])
    scored = sums.withColumn("top", top).select("paragraph", best.alias("class"), (F.lit(1.0) / total).alias("probability"))
    pairs = d.select("paragraph", F.explode("pairs").alias("gram"))
    like = pairs.join(F.broadcast(shapes), "gram").groupBy("paragraph", "family", "template").agg((F.count(F.lit(1)) / F.first("size")).alias("s"))
    like = like.groupBy("paragraph", F.col("family").alias("class")).agg(F.max("s").alias("similarity"))
    out = scored.join(like, ["paragraph", "class"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("probability") >= MIN_PROBABILITY) & (F.col("similarity") >= MIN_SIMILARITY)
    return out.select("paragraph", F.when(sure, F.col("class")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"))


def _pairs(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} or set(words)


def _parts(text: Column) -> Column:
    """(block, whole, paragraph): the lines of each block that hold an anchor, and blocks of several lines as one."""
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: x.rlike(_LETTER))

    def parts(b: Column, i: Column) -> Column:
        row = lambda whole: lambda x: F.struct(i.alias("block"), F.lit(whole).alias("whole"), x.alias("paragraph"))
        joined = F.filter(F.array(F.array_join(lines(b), " ")), lambda x: F.size(lines(b)) > 1)
        return F.concat(F.transform(lines(b), row(False)), F.transform(joined, row(True)))

    return F.filter(F.flatten(F.transform(F.split(text, _BLANK), parts)), lambda x: x["paragraph"].rlike(_ANCHORED))


def scan_licenses(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with n_paragraphs, n_anchored, n_licensed, ``families`` (sorted, comma-joined) and ``best``.

    Paragraphs and anchored ones are counted in lines. A block of lines counts in
    n_licensed once if its lines joined show a family that none of them shows alone.
    ``best`` is the family of the most probable line or block, null without one. Null and
    empty texts have no paragraphs. Repeated rows have equal results. Lines and blocks of
    any length are classified whole. An empty table gives no rows. Texts are read once:
    their paragraphs with an anchor are written as a table, with the row they are of.
    Without ``keep_text`` the result lacks the texts.
    """
    df = without(df, "n_paragraphs", "n_anchored", "n_licensed", "families", "best")
    row, parts = fresh(df, "__row", "__parts")
    d = df.withColumn("n_paragraphs", F.size(F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(WORD))).cast("long"))
    none = F.expr("cast(array() as array<struct<block:int,whole:boolean,paragraph:string>>)")
    d = d.withColumn(parts, F.when(text_of(text).rlike(_ANCHORED), _parts(text_of(text))).otherwise(none)).withColumn(row, F.monotonically_increasing_id())
    d = write_stage(d if keep_text else d.drop(text), "paragraphs")
    held = d.where(F.size(parts) > 0)
    each = held.select(F.col(row).alias("row"), F.explode(parts).alias("part")).select("row", "part.*")
    known = classify(each).where(F.col("family") != UNKNOWN)
    known = write_stage(known.join(each.groupBy("paragraph").agg(F.count(F.lit(1)).alias("n")), "paragraph"), "licensed")
    # a line that a third of all documents carry is a hot key
    met = join_hot(each, known, "paragraph", ["row", "block"], "n")
    known = F.col("family").isNotNull()
    blocks = met.groupBy("row", "block").agg(
        F.count_if(~F.col("whole")).alias("n_anchored"),
        F.count_if(known & ~F.col("whole")).alias("n_licensed"),
        F.collect_set(F.when(known & ~F.col("whole"), F.col("family"))).alias("shown"),
        F.collect_set(F.when(known & F.col("whole"), F.col("family"))).alias("joined"),
        F.max(F.when(known, F.struct("probability", "family"))).alias("top"),
    )
    blocks = blocks.withColumn("n_licensed", F.col("n_licensed") + F.size(F.array_except("joined", "shown")))
    per = blocks.groupBy("row").agg(
        F.sum("n_anchored").alias("n_anchored"),
        F.sum("n_licensed").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union("shown", "joined"))))), ",").alias("families"),
        F.max("top").getField("family").alias("best"),
    )
    hit = held.join(per.withColumnRenamed("row", f"{row}_"), F.col(row) == F.col(f"{row}_"), "left").drop(f"{row}_")
    rest = d.where(F.size(parts) == 0).withColumns({"n_anchored": F.lit(0).cast("long"), "n_licensed": F.lit(0).cast("long"), "families": F.lit(""), "best": F.lit(None).cast("string")})
    return rest.unionByName(hit).drop(row, parts)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families of all documents."""
    return scan_licenses(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
