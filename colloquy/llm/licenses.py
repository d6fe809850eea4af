"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a document, or all of several lines without a blank one between them (a wrapped
notice), once comment leaders are stripped; a line with nothing else is blank. It is described by its distinct word n-grams of one to three words.
A softmax regression over the sparse n-grams of the licence templates gives each licence family and
the class ``unknown`` a probability; the probabilities are calibrated by a temperature fitted on paragraphs
of templates that a first model has not seen (one of every family with three or more). The predicted family is
confirmed when one of its templates has at least ``CONFIRM`` of its word trigrams in the paragraph (a template of
one or two words: all of it) and all of its words with digits, which tell versions apart, and no other family's
template is nearer. Reported are all
paragraphs with a confirmed family, and as ``unknown`` the lines that the classifier takes for some family's
with a probability of ``LIKELY`` or more but no template confirms. A notice over several lines is one row if it
is confirmed as a whole and none of its lines has its family alone; ``lines`` tells how many lines there are.

The classifier is trained when it is first used, from the templates below: each is varied by a rule
(words dropped, other words around it), and ``unknown`` is trained on filler and on scrambled licence
words. Scanning uses built-in Spark functions only. A paragraph that has none of the words of ``keys()`` is left
out before it is split into words. That changes no confirmed row: of each template so many n-grams hold a key
that fewer than ``CONFIRM`` of them are without one.

Defined cases: null and empty texts have no paragraph to report; repeated rows are reported each; a
null ``doc_id`` stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
CONFIRM = 0.7
#: Probability from which a line that no template confirms is reported as a licence of unknown family.
LIKELY = 0.9
SAMPLES, ROUNDS = 60, 300
_WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Sentences by which licences are declared, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License, Version 2.0",
        "Apache License 2.0",
    ],
    "artistic-2.0": [
        "This is free software, licensed under the Artistic License 2.0.",
    ],
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "bsd-2-clause": [
        "Released under the BSD 2-Clause License.",
        "Licensed under the Simplified BSD License.",
        "BSD 2-Clause License",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "cc-by-3.0": [
        "Licensed under CC BY 3.0.",
        "CC BY 3.0",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "CC BY 4.0",
        "Licensed under CC-BY-4.0.",
        "Available under CC-BY-4.0.",
        "Creative Commons Attribution 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "CC BY-NC 4.0",
        "CC BY NC 4.0",
        "Licensed under CC-BY-NC-4.0.",
        "Available under CC-BY-NC-4.0.",
        "Creative Commons Attribution-NonCommercial 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "Available under CC-BY-SA-4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC BY-SA 4.0",
    ],
    "cc-by-sa-3.0": [
        "Licensed under CC BY-SA 3.0.",
        "CC BY-SA 3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ],
    "cc0-1.0": [
        "CC0 1.0 Universal Public Domain Dedication",
        "CC0 1.0 Universal",
        "CC0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Eclipse Public License 2.0",
    ],
    "gpl-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "GNU General Public License v2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
        "GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "ISC License",
    ],
    "lgpl-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU Lesser General Public License v2.1",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License v3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Available under the terms of the Mozilla Public License 2.0.",
        "Mozilla Public License 2.0",
        "Mozilla Public License, version 2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without prior written permission.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "The author has waived all copyright and related or neighboring rights to this work.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "Released under the zlib License.",
    ],
    "wtfpl": [
        "Do What The Fuck You Want To Public License, version 2",
    ],
}
#: Identifiers of the SPDX list, by family.
IDS = {
    "agpl-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache-2.0"],
    "artistic-2.0": ["Artistic-2.0"],
    "bsd-2-clause": ["BSD-2-Clause"],
    "bsd-3-clause": ["BSD-3-Clause"],
    "bsl-1.0": ["BSL-1.0"],
    "cc-by-3.0": ["CC-BY-3.0"],
    "cc-by-4.0": ["CC-BY-4.0"],
    "cc-by-nc-4.0": ["CC-BY-NC-4.0"],
    "cc-by-sa-3.0": ["CC-BY-SA-3.0"],
    "cc-by-sa-4.0": ["CC-BY-SA-4.0"],
    "cc0-1.0": ["CC0-1.0"],
    "epl-2.0": ["EPL-2.0"],
    "gpl-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "gpl-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "isc": ["ISC"],
    "lgpl-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "lgpl-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL-2.0"],
    "public-domain": ["Unlicense"],
    "wtfpl": ["WTFPL"],
    "zlib": ["Zlib"],
}
#: What stands before the text of a comment's line.
LEADER = r"^\s*(?:(?:<!--|[/*#;%>|!\"'-]+|(?i:dnl|rem)(?=\s|$))\s*)*"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def ngrams(seq: list[str]) -> set[str]:
    return {" ".join(seq[i : i + n]) for n in (1, 2, 3) for i in range(len(seq) - n + 1)}


@lru_cache(maxsize=1)
def templates() -> dict[str, list[str]]:
    """All templates by family: sentences, stated identifiers, and identifiers that tell themselves by a digit."""
    out = {family: list(many) for family, many in TEMPLATES.items()}
    for family, ids in IDS.items():
        out[family] += [f"SPDX-License-Identifier: {i}" for i in ids] + [i for i in ids if any(c.isdigit() for c in i)]
    return out


def order(template: str) -> int:
    """Words of the n-grams by which a template is compared: three, or all of a shorter one."""
    return min(3, len(words(template)))


def confirming(template: str) -> list[str]:
    """The n-grams that confirm a template."""
    return sorted(g for g in ngrams(words(template)) if g.count(" ") == order(template) - 1)


def versions(template: str) -> list[str]:
    """Words with a digit: a paragraph must have all of them, or it is of another version."""
    return sorted({w for w in words(template) if any(c.isdigit() for c in w)})


@lru_cache(maxsize=1)
def keys() -> tuple[str, ...]:
    """Words of which every confirmed paragraph has one, chosen greedily; long ones or with digits, as these are rare."""
    every = [confirming(t) for many in templates().values() for t in many]
    able = sorted({w for own in every for g in own for w in g.split(" ") if len(w) > 5 or len(w) > 2 and any(c.isdigit() for c in w)})
    chosen: list[str] = []
    bare = lambda own, more: sum(not any(k in g for k in more) for g in own)
    while open_ := [own for own in every if bare(own, chosen) >= CONFIRM * len(own)]:
        best = min(able, key=lambda w: sum(bare(own, [*chosen, w]) for own in open_))
        if all(bare(own, [*chosen, best]) == bare(own, chosen) for own in open_):
            raise ValueError(f"no key for {open_[0]}")
        chosen.append(best)
    return tuple(k for k in chosen if not any(o != k and o in k for o in chosen))


class Model:
    """Families (``unknown`` last), one weight row per n-gram, and the bias, all scaled by the temperature."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float]):
        self.families, self.weights, self.bias = families, weights, bias


def _examples(rng: random.Random) -> list[tuple[list[str], str, bool, float]]:
    """Words, family, whether the example is of a template kept back for calibration, and its weight (a template's add up to one)."""
    filler = ["".join(rng.choice(["ba", "ne", "the", "ing", "or", "st", "de", "la"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    common = "the a of and to in is for with this that we you it on as by be or not use read see more text page file work part".split()
    pick = lambda n: [rng.choice(filler if rng.random() < 0.6 else common) for _ in range(n)]
    every = [w for many in TEMPLATES.values() for t in many for w in words(t)]
    out = []
    for family, many in templates().items():
        for place, t in enumerate(many):
            # a short template has few variants, and loses none of its words
            short = len(words(t)) < 4
            times = SAMPLES // 4 if short else SAMPLES
            for _ in range(times):
                seq = [w for w in words(t) if short or rng.random() > 0.06]
                out.append((pick(rng.choice([0, 0, 3, 12])) + seq + pick(rng.choice([0, 0, 3, 12])), family, len(many) > 2 and place == len(many) // 2, 1 / times))
    for _ in range(SAMPLES * 12):
        seq = [rng.choice(every) for _ in range(rng.randint(1, 12))]
        out.append((pick(rng.randint(0, 20)) + (seq if rng.random() < 0.5 else []) + pick(rng.randint(0, 20)), UNKNOWN, rng.random() < 0.2, 1.0))
    return out


@lru_cache(maxsize=1)
def train(seed: int = 11) -> Model:
    """Softmax regression by gradient descent, then the temperature with the least held-out loss."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    grams = sorted({g for many in templates().values() for t in many for g in ngrams(words(t))})
    column = {g: i for i, g in enumerate(grams)}
    rng = random.Random(seed)
    rows = _examples(rng)
    rng.shuffle(rows)
    x, y = np.zeros((len(rows), len(grams)), np.float32), np.zeros(len(rows), int)
    back, each = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    for i, (seq, family, *_) in enumerate(rows):
        x[i, [column[g] for g in ngrams(seq) if g in column]] = 1
        y[i] = families.index(family)
    w, b = _regression(x[~back], y[~back], len(families), each[~back])
    z, right = x[back] @ w + b, y[back]

    def loss(scale: float) -> float:
        s = z * scale
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(s)), right]).mean())

    scale = min(np.linspace(0.3, 4, 38), key=loss)
    w, b = _regression(x, y, len(families), each)
    return Model(families, {g: (w[i] * scale).astype(float).round(6).tolist() for g, i in column.items()}, (b * scale).astype(float).round(6).tolist())


def _regression(x: np.ndarray, y: np.ndarray, classes: int, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression by gradient descent with momentum; ``each`` weighs the examples within
    their class, and every class counts alike."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    share = (each / (target * each[:, None]).sum(0).clip(1e-9)[y] / classes)[:, None].astype(np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * share
        speed_w = np.float32(0.9) * speed_w + x.T @ g + np.float32(1e-5) * w
        speed_b = np.float32(0.9) * speed_b + g.sum(0)
        w -= np.float32(1.0) * speed_w
        b -= np.float32(1.0) * speed_b
    return w, b


def _grams(seq: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(seq) - (n - 1), F.lit(1)))
    runs = F.transform(at, lambda i: F.array_join(F.slice(seq, i, n), " "))
    return F.when(F.size(seq) >= n, runs).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """Paragraphs with a licence or a mark of one: ``doc_id``, ``paragraph`` (from 0), ``family``, ``probability``, ``similarity``, ``lines``."""
    spark = docs.sparkSession
    model = train()
    k = len(model.families)
    # in an array function the text is lower-cased once for all words
    has = lambda c, some: F.exists(F.array(F.lower(c)), lambda low: reduce(or_, [F.contains(low, F.lit(m)) for m in some]))
    able = keys()
    # each line that is not blank gets its number and a mark in front; empty lines then part the paragraphs
    bare = lambda line: F.regexp_replace(line, F.lit(LEADER), F.lit(""))
    numbered = lambda line, i: F.when(F.rlike(bare(line), F.lit(r"\S")), F.concat(i.cast("string"), F.lit("\x01"), bare(line))).otherwise("")
    blocks = F.split(F.array_join(F.transform(F.split("text", "\n", -1), numbered), "\n"), "\n{2,}", -1)
    rows = docs.where(has(F.col("text"), able)).select("doc_id", F.explode(blocks).alias("_text"))
    rows = rows.where(has(F.col("_text"), able)).withColumn("_block", F.monotonically_increasing_id())
    kind = "struct<paragraph:int,lines:int,line:string>"
    parts = F.split(F.btrim("_text", F.lit("\n")), "\n", -1)
    lines = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x01", 1).cast("int").alias("paragraph"), F.lit(1).alias("lines"), F.regexp_replace(p, r"^\d+\x01", "").alias("line")).cast(kind))
    rows = rows.select("doc_id", "_block", lines.alias("_lines"))
    joined = F.struct(F.col("_lines")[0]["paragraph"], F.size("_lines"), F.array_join(F.col("_lines.line"), " ")).cast(kind)
    able_lines = F.filter("_lines", lambda p: has(p["line"], able))
    rows = rows.select("doc_id", "_block", F.explode(F.when(F.size("_lines") > 1, F.concat(able_lines, F.array(joined))).otherwise(able_lines)).alias("_p"))
    rows = rows.select("doc_id", "_block", "_p.*")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_words", F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)))
    rows = rows.withColumns({"_two": F.array_distinct(_grams(F.col("_words"), 2)), "_three": F.array_distinct(_grams(F.col("_words"), 3))})
    near = []
    for family in model.families[:-1]:
        likeness = []
        for t in templates()[family]:
            own = confirming(t)
            if len(own) == 1:
                shared = F.array_contains((None, "_words", "_two", "_three")[order(t)], own[0]).cast("double")
            else:
                shared = F.size(F.array_intersect(F.col("_three"), F.array(*[F.lit(g) for g in own]))) / F.lit(len(own))
            for v in versions(t) if order(t) == 3 else ():
                shared = F.when(F.array_contains("_words", v), shared).otherwise(0.0)
            likeness.append(shared)
        near.append(F.greatest(*likeness) if len(likeness) > 1 else likeness[0])
    rows = rows.withColumn("_near", F.array(*near, F.lit(0.0)))
    grams = F.array_distinct(F.concat("_words", "_two", "_three"))
    each = rows.select("_row", "_block", "doc_id", "paragraph", "lines", "_near", F.explode_outer(grams).alias("gram"))
    table = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>")
    each = each.join(F.broadcast(table), "gram", "left")
    sums = each.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("_block").alias("_block"),
        F.first("paragraph").alias("paragraph"),
        F.first("lines").alias("lines"),
        F.first("_near").alias("_near"),
        F.array(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) + F.lit(model.bias[i]) for i in range(k)]).alias("_z"),
    )
    top = F.array_max("_z")
    place = F.array_position(F.col("_z"), top).cast("int")
    total = F.aggregate(F.transform("_z", lambda z: F.exp(z - top)), F.lit(0.0), lambda a, b: a + b)
    names = F.array(*[F.lit(f) for f in model.families])
    sums = sums.withColumn("_at", place).withColumn("similarity", F.element_at("_near", F.col("_at")))
    # no other family's templates may be nearer than those of the predicted one
    sure = (F.col("similarity") >= CONFIRM) & (F.col("similarity") >= F.array_max("_near"))
    sums = sums.where(F.col("_at") < k).select(
        "doc_id",
        "_block",
        sure.alias("_sure"),
        F.col("paragraph").cast("long"),
        F.when(sure, F.element_at(names, F.col("_at"))).otherwise(UNKNOWN).alias("family"),
        (F.lit(1.0) / total).alias("probability"),
        "similarity",
        "lines",
    ).where(sure | (F.col("probability") >= LIKELY))
    block = Window.partitionBy("_block")
    alone = F.collect_set(F.when((F.col("lines") == 1) & F.col("_sure"), F.col("family"))).over(block)
    whole = F.max((F.col("lines") > 1) & F.col("_sure")).over(block)
    out = sums.withColumns({"_alone": alone, "_whole": whole})
    # a notice over several lines goes once: its lines are no rows where it is confirmed, nor is it where they are
    single = (F.col("lines") == 1) & (F.col("_sure") | ~F.col("_whole"))
    joined = (F.col("lines") > 1) & F.col("_sure") & ~F.array_contains("_alone", F.col("family"))
    return out.where(single | joined).drop("_block", "_sure", "_alone", "_whole")
