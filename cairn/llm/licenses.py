"""Licence scans: a trained paragraph classifier over word bigrams, confirmed against templates.

Blank lines part paragraphs; within one, lines are joined, so that wrapped notices are whole. A
paragraph is read in windows of ``SPAN`` words that overlap by half, so that a notice counts the same
wherever it stands. The features of a window are the bigrams of its lower-cased words [a-z0-9]+ that
occur in some training notice, but for those of two function words. A multinomial logistic
regression weighs them: its classes are ``none``, the licence families, and ``unknown``, which is
trained from notices of other licences (``FOREIGN``) and from the families' own notices with the
licence's name replaced; so what tells a family is its name and its own wording. It is trained on
the driver from the notices, varied with a fixed seed, and from at most ``max_negatives`` windows of
the corpus; one temperature, fitted on other variants, other names and licences kept aside
(``ASIDE``), calibrates all classes. A window that is likelier a licence than not is of the likeliest
family if its probability is ``sure`` or more, else ``unknown``. A family is confirmed if the window
and one of its templates share enough bigrams, one of which at least occurs in no other notice, and
none makes another licence's name of the family's (``FURTHER``: MIT-0 isn't MIT); ``NEAR`` has such licences for training.

The scan is a pass with SQL functions: only windows around a trigger word are made at all, their
bigrams are joined with the broadcast weights (a table fixed in size by the notices), and summed.
Every feature that speaks for a licence has a trigger word, so a window without one is ``none``.
"""
from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: one line for each notice, by family
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
        "Licensed under Apache 2.0.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "MIT licensed. See LICENSE for details.",
        "The MIT License (MIT)",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD-3-Clause",
        "Modified BSD License",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPL-3.0",
        "Distributed under the terms of the GNU GPL v3.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "License: LGPL-2.1",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "License: AGPL-3.0",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "License: ISC",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "License: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "License: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "License: CC-BY-NC-4.0",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "License: CC0-1.0",
    ],
}
#: notices of other licences and of none
FOREIGN = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the PostgreSQL License.",
    "All rights reserved.",
    "Copyright (c) 2014 The Authors. All rights reserved.",
    "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "This product is licensed, not sold. By installing this software you accept the terms of this end user license agreement.",
    "You may not copy, modify, distribute or reproduce this material without the prior written permission of the copyright holder.",
    "No part of this publication may be reproduced without the written permission of the publisher.",
    "Use of this file is subject to the terms of the license agreement.",
    "Available under the Open Data Commons Open Database License.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: OFL-1.1",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
]
#: notices of licences whose names begin as a family's do
NEAR = [
    "SPDX-License-Identifier: MIT-0",
    "License: MIT-0",
    "Licensed under the MIT-0 License.",
    "Licensed under the MIT No Attribution License.",
    "Licensed under the Apache License, Version 1.1.",
    "SPDX-License-Identifier: Apache-1.1",
    "Licensed under CC BY-ND 4.0.",
    "SPDX-License-Identifier: CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.",
    "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under CC BY-NC-ND 4.0.",
    "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
]
#: bigrams that make another licence of a family's name; a window with one of them confirms no such family
FURTHER = {
    "MIT": ["mit 0", "mit no"],
    "Apache-2.0": ["apache 1", "version 1"],
    "CC-BY": ["by nd", "attribution noderivatives"],
    "CC-BY-SA": ["nc sa", "noncommercial sharealike"],
    "CC-BY-NC": ["nc sa", "nc nd", "noncommercial sharealike", "noncommercial noderivatives"],
}
#: licences kept aside from training, for calibration
ASIDE = [
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the University of Illinois/NCSA Open Source License.",
    "This is free and unencumbered software released into the public domain.",
    "Copyright 2020 Example Ltd. All rights reserved. Confidential.",
    "This program is licensed under the Academic Free License version 3.0.",
    "SPDX-License-Identifier: EUPL-1.2",
]
#: prose with words of notices
PROSE = [
    "He lost his driving license on the way to work and had to see the clerk for another.",
    "The software was free of charge until version 2.0 came out under a new name.",
    "Permission to build was granted by the council, without any conditions.",
    "The terms of the agreement between the two kings were read to all persons present.",
    "Copies of the book were distributed in the public library, and the rest were sold.",
    "You can obtain a copy of the map at the office; use it as you like.",
    "She wrote the documentation and the source code of the program in one summer.",
    "The general public was not admitted to the creative writing class.",
    "The foundation released a report under the title of its last conference.",
    "Either version of the story may be true, but the limitations of both are plain.",
    "Sie verloren mit 0 zu 3, und mit no name Schuhen war der Weg zu weit.",
    "Er kam mit 0 Punkten nach Hause, mit no als einzigem englischen Wort.",
]
#: what names a licence in the templates; replaced by other names where ``unknown`` is trained
_NAMED = re.compile(r"GNU (?:Lesser |Affero )?General Public|Creative Commons Attribution(?:-\w+)?|CC BY(?:-\w\w)?|\bCC0 1\.0(?: Universal)?|Mozilla Public|Apache|MIT|BSD(?:-style)?|\bISC|\b[LA]?GPL\b|\bMPL\b|Free Software Foundation|http\S+|(?<=Identifier: )\S+")
_SYLLABLES = {0: "bar dol fen gar kel lum mor nar pel quo ros sil tav vun wex zan".split(), 1: "ar bex cor dun el fi gon hal ix jor ka lo myr nu ost pra".split()}
#: windows of the corpus with these may be notices of licences not listed here, and are no negatives
_MAYBE = re.compile("licen[cs]|copyright|rights reserved|spdx")
#: words a window, and from one window's start to the next
SPAN, STEP = 60, 30
#: bigrams of two of these tell nothing of a licence and are no features
FUNCTION_WORDS = frozenset("a all an and any are as at be but by can for from had has have if in is it its may no not of on one or other that the their they this to was we were which will with you your".split())
FAMILIES = list(TEMPLATES)
CLASSES = ["none", *FAMILIES, "unknown"]


def words(line: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))


def bigrams(line: str) -> set[str]:
    w = words(line)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def features(line: str) -> set[str]:
    """The bigrams of a notice that are features: those with a word that isn't a function word."""
    return {g for g in bigrams(line) if not FUNCTION_WORDS.issuperset(g.split())}


def _notices() -> list[tuple[int, str]]:
    return [(c, t) for c, ts in enumerate(TEMPLATES.values(), 1) for t in ts]


def own_features() -> list[set[str]]:
    """For each family the features that occur in its templates and in no other notice."""
    by = [set().union(*map(features, ts)) for ts in TEMPLATES.values()]
    foreign = set().union(*map(features, FOREIGN))
    return [g - foreign - set().union(*[o for k, o in enumerate(by) if k != c]) for c, g in enumerate(by)]


def _renamed(notice: str, rng, kind: int) -> str | None:
    """The notice with the licence's name replaced by one of no meaning; None if it has no name."""
    name = lambda _: " ".join("".join(rng.choice(_SYLLABLES[kind], rng.integers(1, 4))).capitalize() for _ in range(rng.integers(1, 3)))
    out, n = _NAMED.subn(name, notice)
    return out if n else None


def variants(rng, filler: list[str], each: int, kind: int, foreign: list[str], near: tuple[str, ...] = ()) -> tuple[list[str], list[int]]:
    """Windows that hold a notice, and their classes: words left out or replaced, prose around it."""
    out, y = [], []

    def varied(notice, c, k):
        kept, last = [], 0
        for m in _NAMED.finditer(notice):  # names stay whole
            kept += [(w, False) for w in notice[last : m.start()].split()] + [(m.group(), True)]
            last = m.end()
        kept += [(w, False) for w in notice[last:].split()]
        own = [w if named or k < 2 or rng.random() > 0.08 else rng.choice(filler) for w, named in kept]
        room = max(0, SPAN - len(words(" ".join(own))))
        if k % 2:
            around = rng.choice(filler, rng.integers(0, room + 1)).tolist()
            cut = rng.integers(0, len(around) + 1)
            own = [*around[:cut], *own, *around[cut:]]
        own = " ".join(own)
        out.append(" ".join(words(own)[:SPAN]))
        y.append(c)

    for c, notice in _notices():
        for k in range(each):
            varied(notice, c, k)
            if other := _renamed(notice, rng, kind):
                varied(other, len(CLASSES) - 1, k)
    for notice in foreign:
        for k in range(2 * each):
            varied(notice, len(CLASSES) - 1, k)
    for notice in near:
        for k in range(2 * each):
            varied(notice, len(CLASSES) - 1, k % 2)  # with all its words: one of them makes the difference
    return out, y


def _vectors(lines: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(lines), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for row, line in zip(x, lines):
        row[[vocabulary[g] for g in bigrams(line) if g in vocabulary]] = 1
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@functools.lru_cache(4)
def train(negatives: tuple[str, ...], rounds: int = 150, each: int = 12, seed: int = 11):
    """(vocabulary, weights (bigrams and intercept x classes), temperature); ``negatives`` are windows of the corpus."""
    notices = [t for _, t in _notices()] + FOREIGN + NEAR
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*map(features, notices))))}
    texts = [bigrams(t) for t in [*notices, *ASIDE]]
    held = lambda g: max((len(g & t) / len(t) for t in texts), default=0)
    clean = [n for n in negatives if (g := bigrams(n)) and held(g) < 0.5 and not _MAYBE.search(n)]
    filler = [w for n in clean[:400] for w in n.split()[:20]] or ["lorem", "ipsum"]

    def made(kind, own):
        rng = np.random.Generator(np.random.PCG64(seed + kind))
        lines, y = variants(rng, filler, each if kind == 0 else 4, kind, ASIDE if kind else FOREIGN, tuple(NEAR))
        # prose that holds single bigrams of notices, as any may
        grams = sorted(vocabulary)
        for _ in range(400 if kind == 0 else 150):
            some = rng.choice(filler, rng.integers(0, SPAN)).tolist()
            for g in rng.choice(grams, rng.integers(1, 3)):
                some.insert(int(rng.integers(0, len(some) + 1)), str(g))
            lines.append(" ".join(some))
            y.append(0)
        # and what makes another licence of a name, which is prose by itself ("mit 0" is German)
        for g in sorted({g for gs in FURTHER.values() for g in gs}):
            for _ in range(24 if kind == 0 else 8):
                some = rng.choice(filler, rng.integers(0, SPAN - 2)).tolist()
                some.insert(int(rng.integers(0, len(some) + 1)), g)
                lines.append(" ".join(some))
                y.append(0)
        lines += own + [""] * 20
        return _vectors(lines, vocabulary), np.array(y + [0] * (len(own) + 20))

    x, y = made(0, [n for k, n in enumerate(clean) if k % 4] + PROSE[::2])
    x2, y2 = made(1, clean[::4] + PROSE[1::2])
    weigh = lambda y: np.where(y == 0, len(y) / 2 / max(1, (y == 0).sum()), len(y) / 2 / max(1, (y > 0).sum()))
    weight, target = weigh(y).astype(np.float32)[:, None] / len(y), np.eye(len(CLASSES), dtype=np.float32)[y]
    w = np.zeros((x.shape[1], len(CLASSES)), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):  # Adam on the whole set
        g = x.T @ ((softmax(x @ w) - target) * weight) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    w = w.astype(np.float64)
    z, own = x2 @ w, weigh(y2)
    loss = lambda t: float(-(own * np.log(softmax(z / t)[np.arange(len(z)), y2] + 1e-300)).sum())
    return vocabulary, w, float(min(np.geomspace(0.25, 16, 49), key=loss))


def triggers(vocabulary: dict[str, int], w: np.ndarray, negatives: tuple[str, ...]) -> list[str]:
    """A word of each feature that speaks for some licence: the one that prose has least."""
    seen: dict[str, int] = {}
    for n in negatives:
        for x in n.split():
            seen[x] = seen.get(x, 0) + 1
    speaks = [g for g, i in vocabulary.items() if (w[i, 1:] > w[i, 0]).any()]
    if w[-1].argmax():
        raise ValueError("the model must find no licence in a window without features")
    return sorted({min((x for x in g.split() if x not in FUNCTION_WORDS), key=lambda x: (seen.get(x, 0), x)) for g in speaks})


def _paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row (one for each document), paragraph, words of every paragraph."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.split(F.translate(docs["text"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "\n[ \\t-\\r]*\n").alias("parts"))
    return texts.select("doc_id", "row", F.posexplode("parts").alias("paragraph", "part")).select("doc_id", "row", "paragraph", F.filter(F.split("part", "[^a-z0-9]+"), lambda w: w != "").alias("words"))


def sampled_windows(docs: DataFrame, max_negatives: int = 2000) -> tuple[str, ...]:
    """Windows of the ``max_negatives`` // 4 documents with the lowest id hash, the four with the lowest hash of each at most."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_negatives // 4)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STEP))
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    some = _paragraphs(chosen).select("doc_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, SPAN), " "))).alias("w")).filter("w <> ''")
    few = some.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("w").alias("h"), "w"))), 1, 4).alias("some"))
    return tuple(sorted(r.w for r in few.select(F.explode("some.w").alias("w")).collect()))


def windows(docs: DataFrame, words_that_count: list[str]) -> DataFrame:
    """doc_id, row, paragraph, word (the window's first), grams (its different bigrams), of the windows with one of the words."""
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*words_that_count), i)), lambda i: i.isNotNull())
    hits = _once(_paragraphs(docs).select("doc_id", "row", "paragraph", "words", F.array_distinct(F.transform(at, lambda i: F.floor(i / STEP).cast("int"))).alias("spans")).filter(F.size("spans") > 0))
    starts = F.array_distinct(F.concat(F.col("spans"), F.transform("spans", lambda k: k - 1)))
    # the last window isn't made if the one before reaches the end
    useful = F.filter(starts, lambda k: (k == 0) | ((k > 0) & (k * STEP + SPAN - STEP < F.size("words"))))
    cut = _once(hits.select("doc_id", "row", "paragraph", "words", F.explode(useful).alias("k")).select("doc_id", "row", "paragraph", (F.col("k") * STEP).alias("word"), F.slice("words", F.col("k") * STEP + 1, SPAN).alias("words")))
    pair = lambda w, i: F.concat_ws(" ", w, F.get(F.col("words"), i + 1))
    return cut.filter(F.size("words") > 1).select("doc_id", "row", "paragraph", "word", F.array_distinct(F.transform(F.slice("words", 1, F.size("words") - 1), pair)).alias("grams"))


def scan(docs: DataFrame, sure: float = 0.6, overlap: float = 0.5, max_negatives: int = 2000) -> DataFrame:
    """doc_id, paragraph, word, family, probability, template_overlap, confirmed: a row for each family found in a paragraph.

    paragraph counts from 0, word is where the likeliest window of it begins. probability is the
    family's, for ``unknown`` that of being a licence but not of the likeliest family; a window
    found unknown beside one of a family is that notice's fringe and not counted. template_overlap
    is the share of a template's bigrams in the window (of 24, if it has more). Null, empty and
    one-word texts have none; documents that repeat come out repeated; null doc_ids stay null; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    negatives = sampled_windows(docs, max_negatives)
    vocabulary, w, temperature = train(negatives)
    notices = [features(t) for _, t in _notices()]
    owner, own = [c - 1 for c, _ in _notices()], own_features()
    # what speaks against a family outweighs all that is its own
    own_less = lambda g, c: int(g in own[c]) - 1000 * int(g in FURTHER.get(FAMILIES[c], ()))
    rows = [(g, [float(v) for v in w[i]], [int(g in t) for t in notices], [own_less(g, c) for c in range(len(FAMILIES))]) for g, i in vocabulary.items()]
    weights = F.broadcast(spark.createDataFrame(rows, "gram string, w array<double>, m array<int>, o array<int>"))
    parts = _once(windows(docs, triggers(vocabulary, w, negatives)))
    hits = parts.select("doc_id", "row", "paragraph", "word", F.explode("grams").alias("gram")).join(weights, "gram")
    sums = hits.groupBy("row", "paragraph", "word", "doc_id").agg(
        *[F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(len(CLASSES))], *[F.sum(F.col("m")[t]).alias(f"m{t}") for t in range(len(notices))], *[F.sum(F.col("o")[c]).alias(f"o{c}") for c in range(len(FAMILIES))])
    scores = [(F.col(f"w{c}") + F.lit(float(w[-1, c]))) / temperature for c in range(len(CLASSES))]
    shared = [F.least(F.lit(1.0), F.col(f"m{t}") / F.lit(float(min(24, len(n))))) for t, n in enumerate(notices)]
    ours = F.array(*[F.greatest(*g) if len(g) > 1 else g[0] for g in ([o for o, c in zip(shared, owner) if c == k] for k in range(len(FAMILIES)))])
    key = ["doc_id", "row", "paragraph", "word"]
    z = _once(sums.select(*key, F.array(*scores).alias("z"), ours.alias("overlaps"), F.array(*[F.col(f"o{c}") for c in range(len(FAMILIES))]).alias("own")))
    odds = _once(z.select(*key, "overlaps", "own", F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("odds")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, v: a + v)
    p = _once(odds.select(*key, "overlaps", "own", F.transform("odds", lambda o: o / total).alias("p"))).filter(F.col("p")[0] < 0.5)
    best = F.array_max(F.transform(F.slice("p", 2, len(FAMILIES)), lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    found = _once(p.select(*key, "overlaps", "own", "p", best.alias("best")))
    at, certain = (1 - F.col("best.i")).cast("int"), F.col("best.v") >= sure
    over = F.element_at("overlaps", at)
    found = found.select(
        *key, F.when(certain, F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), at)).otherwise("unknown").alias("family"),
        F.when(certain, F.col("best.v")).otherwise(1 - F.col("p")[0] - F.col("best.v")).alias("probability"),
        over.alias("template_overlap"), (certain & (over >= overlap) & (F.element_at("own", at) > 0)).alias("confirmed"))
    near = W.partitionBy("row", "paragraph").orderBy("word").rangeBetween(-STEP, STEP)
    found = found.withColumn("beside", F.max((F.col("family") != "unknown").cast("int")).over(near)).filter("family <> 'unknown' or beside = 0")
    top = F.max(F.struct("confirmed", "probability", (-F.col("word")).alias("word"), "template_overlap")).alias("top")
    one = found.groupBy("row", "doc_id", "paragraph", "family").agg(top)
    return one.select("doc_id", "paragraph", (-F.col("top.word")).alias("word"), "family", "top.probability", "top.template_overlap", "top.confirmed")


def _once(df: DataFrame) -> DataFrame:
    """Keeps the optimizer from writing these columns' expressions out again wherever they are used."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def op9_query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
