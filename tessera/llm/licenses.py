"""Licence scan: a trained paragraph classifier, in DataFrame functions only.

Sparse logistic regressions over word unigrams and bigrams, one per licence family and
one for notices of no known family, judge every paragraph of every text.  They are
trained on the driver from the notice templates below: whole, shortened, mixed with each
other and set among other words, against paragraphs that speak of licences without
granting one.  Each is calibrated on variants it has not seen.  A family counts only
where comparison with its templates confirms it, and one paragraph may name several.

Paragraphs are parted by lines without letters or digits, so a wrapped notice is read as
one.  A long paragraph is judged in windows of WINDOW words, each overlapping the next
by half, so that a notice of up to half a window is seen whole.  Words and pairs of words
meet the features, a list of bounded size, in a broadcast join; a window's features are
kept as bits, so what is shuffled is a row of fixed size per window that holds any.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Probability that a verdict needs, and share of a template's word pairs to be found.
MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.6
WINDOW, STRIDE = 64, 32
#: A point counts as part of a word before a digit alone, as in version numbers.
POINTS, WORD_GAPS = r"\.(?![0-9])", "[^a-z0-9.]+"
PARAGRAPH_GAPS = r"\n[^a-z0-9]*\n"

# Short notices by licence family, in words of the public licence texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the terms of the Apache License 2.0", "released under the Apache 2.0 license",
    ),
    "mit": (
        "Released under the MIT License", "SPDX-License-Identifier: MIT", "Licensed under the MIT license", "distributed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "isc": (
        "Licensed under the ISC license", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "released under the GPL", "licensed under the GNU GPL version 2", "licensed under GPL v2 or later", "GPL v3 or later", "GPL v2 or later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-or-later", "released under the LGPL",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "LGPL v2.1 or later",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU Lesser General Public License v2.1",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "released under the AGPL",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "AGPL v3 or later",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0",
    ),
    "epl": (
        "made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License 1.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0", "CC BY 4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0", "CC BY-SA 4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC-SA 4.0", "CC BY-NC 4.0", "CC BY-NC-ND 4.0",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain",
    ),
    "proprietary": (
        "All rights reserved", "No part of this publication may be reproduced without written permission", "Copyright 2020 the authors. All rights reserved",
    ),
}
# Notices of no known family; X stands for any name.
UNNAMED = (
    "Licensed under the X License", "Released under the X License", "released under the terms of the X license", "SPDX-License-Identifier: X",
    "distributed under the X public license version 1.1", "This work is licensed under the X license", "licensed under X 2.0", "see the X license for the terms of use",
    "made available under the X license agreement",
)
# Paragraphs that name licences or rights without a notice.
OTHERS = (
    "the driver had to show a valid license at the checkpoint", "a fishing licence costs ten pounds a year", "the software license agreement was signed in march",
    "copyright law protects original works of authorship", "the pub lost its licence to sell alcohol", "see the license file for details",
    "licensed under terms agreed with the customer", "licensed to practice medicine in two states", "the general public was invited to the hearing",
    "version 3 of the report was released in april", "poetic license is granted to every author", "he works at mit and studies physics",
    "the apache helicopter landed", "licensed under the old school", "released under the bridge", "the license plate was missing",
    "this work is the first of its kind", "without warranty the purchase is risky", "the creative commons room on the first floor is open", "the song entered the public domain last year",
    "the terms of the agreement were published by the foundation", "the film was released under a new title in 2019", "permission was granted by the council free of charge",
    "the mozilla browser and the eclipse editor are free software", "any person may obtain a copy of this report at the office", "the general public license fee for television rose again",
    "a boost in software sales was reported", "she studied the history of the gnu project and the free software foundation", "the rights of the authors are reserved for the next chapter",
    "no part of the house was left standing", "use of the source in binary forms is discussed in section 2.0", "the following conditions are met by all candidates",
    "modify the recipe and distribute the dough over the tray", "attribution of the painting is uncertain", "the international agreement 4.0 was signed",
)
# Words that count only in pairs.
STOP = frozenset("a an and any are as at be by can for from in into is it its may no not of on or that the this to under use was were with you".split())


def words_of(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAPS, re.sub(POINTS, " ", text.lower())) if w]


def grams(words: list[str]) -> set[str]:
    return {*(w for w in words if w not in STOP), *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray  # features x classes, calibration included
    bias: np.ndarray
    templates: tuple[tuple[int, tuple[int, ...]], ...]  # (class, its word pairs as feature numbers)

    def logits(self, text: str) -> dict[str, float]:
        at = {g: i for i, g in enumerate(self.features)}
        held = [at[g] for g in grams(words_of(text)) if g in at]
        return dict(zip(self.classes, (self.weights[held].sum(axis=0) + self.bias).tolist(), strict=True))


def _variants(rng: np.random.Generator, n: int) -> tuple[list[set[str]], np.ndarray]:
    """Training paragraphs as gram sets, and the classes of each as 0/1 columns."""
    families = list(TEMPLATES)
    filler = sorted({w for text in OTHERS for w in words_of(text)} - {"license", "licence", "licensed", "mit", "apache", "public", "domain", "reserved"})
    pick = lambda pool: pool[int(rng.integers(len(pool)))]
    rows, labels = [], []

    def add(parts: list[list[str]], *named: int) -> None:
        words = [w for part in parts for w in part if rng.random() < 0.97]
        around = rng.choice(filler, int(rng.integers(0, 30))).tolist()
        cut = int(rng.integers(0, len(around) + 1))
        rows.append(grams([*around[:cut], *words, *around[cut:]]))
        labels.append([int(y in named) for y in range(len(families) + 1)])

    for y, family in enumerate(families):
        for _ in range(n):
            add([words_of(pick(TEMPLATES[family]))], y)
        for _ in range(n // 3):
            other = int(rng.integers(len(families)))
            add([words_of(pick(TEMPLATES[family])), *([["or"], ["and"], []][int(rng.integers(3))],), words_of(pick(TEMPLATES[families[other]]))], y, other)
    for _ in range(4 * n):
        name = rng.choice(filler, int(rng.integers(1, 3))).tolist() if rng.random() < 0.3 else ["zz"]
        add([[x for w in words_of(pick(UNNAMED)) for x in (name if w == "x" else [w])]], len(families))
    for _ in range(8 * n):
        add([words_of(pick(OTHERS))])
    for _ in range(4 * n):  # words of a notice, out of order
        words = words_of(pick(TEMPLATES[pick(families)]))
        add([[w for w in rng.permutation(words).tolist() if rng.random() < 0.4]])
    return rows, np.array(labels, dtype=np.float32)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) for which sigmoid(a z + b) fits y best, by Newton steps; a stays positive."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, d = p * (1 - p) + 1e-4, p - y
        h = np.array([[np.sum(w * z * z) + 1, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(d * z) + (a - 1), np.sum(d)]))
        a, b = max(0.2, a - float(step[0])), b - float(step[1])
    return a, b


@lru_cache(maxsize=1)
def trained() -> Model:
    """The classifiers; training is repeatable and takes a second or two."""
    rng = np.random.default_rng(5)
    families = list(TEMPLATES)
    rows, y = _variants(rng, 120)
    held, held_y = _variants(rng, 60)
    names = sorted({g for pool in [*TEMPLATES.values(), UNNAMED, OTHERS] for t in pool for g in grams(words_of(t)) if g != "x" and not {"x"} & set(g.split())})
    at = {g: i for i, g in enumerate(names)}

    def matrix(found: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(found), len(names)), dtype=np.float32)
        for i, r in enumerate(found):
            x[i, [at[g] for g in r if g in at]] = 1
        return x

    x = matrix(rows)
    w, b = np.zeros((len(names), y.shape[1]), np.float32), np.full(y.shape[1], -2, np.float32)
    for epoch in range(50):
        rate = 2.0 / (1 + epoch / 10)
        for part in np.array_split(rng.permutation(len(y)), len(y) // 32):
            d = 1 / (1 + np.exp(-(x[part] @ w + b))) - y[part]
            w -= rate * (x[part].T @ d / len(part))
            b -= rate * d.mean(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * 1e-4, 0)  # sparse: small weights go
    z = matrix(held) @ w + b
    fits = [_platt(z[:, c], held_y[:, c]) for c in range(y.shape[1])]
    scale, shift = np.array([f[0] for f in fits]), np.array([f[1] for f in fits])
    pairs = {g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t)) if " " in g}
    used = [i for i, g in enumerate(names) if np.abs(w[i]).max() > 0 or g in pairs]
    features = tuple(names[i] for i in used)
    number = {g: i for i, g in enumerate(features)}
    templates = tuple((f, tuple(sorted(number[g] for g in grams(words_of(t)) if " " in g))) for f, family in enumerate(families) for t in TEMPLATES[family])
    return Model((*families, UNKNOWN), features, np.round(w[used] * scale, 4).astype(float), np.round(b * scale + shift, 4).astype(float), templates)


def _literal(value) -> Column:
    if isinstance(value, list | tuple | np.ndarray):
        return F.array(*map(_literal, value))
    return F.lit(value.item() if isinstance(value, np.generic) else value)


def _feature_tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """(lead, slot, bit, gain) of every word that is a feature or leads one, and of the
    empty word, with nulls where it is none; and the same of pairs, by `pair`.  gain
    bounds what a feature adds to any logit."""
    gain = np.maximum(model.weights, 0).max(axis=1).round(4)
    bit = lambda i: 1 << i % 63
    own = {g: (i // 63, bit(i), float(gain[i])) for i, g in enumerate(model.features)}
    leads = sorted({g.split(" ")[0] for g in own} | {""})
    none = (None, None, None)
    one = [(w, *own.get(w, none)) for w in leads]
    two = [(g, *v) for g, v in own.items() if " " in g]
    shown = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}L" if isinstance(x, int) else f"{x}D"

    def values(rows: list[tuple], names: str) -> DataFrame:
        listed = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
        return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")

    return values(one, "lead, u_slot, u_bit, u_gain"), values(two, "pair, b_slot, b_bit, b_gain")


def _windows(paragraphs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, para, window and the feature bits m0, m1, ... of the windows that hold
    enough features for any verdict; all windows of para 0, which stand for the rows."""
    spark = paragraphs.sparkSession
    words = F.split(F.regexp_replace("paragraph", POINTS, " "), WORD_GAPS)
    placed = paragraphs.select(*keys, "para", words.alias("__w")).select(
        *keys, "para", F.posexplode(F.arrays_zip(F.col("__w").alias("w"), F.slice("__w", 2, F.greatest(F.size("__w") - 1, F.lit(1))).alias("v"))).alias("pos", "at")
    )
    one, two = _feature_tables(spark, model)
    led = placed.join(F.broadcast(one), F.col("at.w") == F.col("lead"))
    hits = led.join(F.broadcast(two), F.concat("at.w", F.lit(" "), "at.v") == F.col("pair"), "left")
    hits = hits.where(F.col("u_slot").isNotNull() | F.col("b_slot").isNotNull() | (F.col("para") == 0))
    last = F.floor(F.col("pos") / STRIDE).cast("int")
    hits = hits.withColumn("window", F.explode(F.when(last > 0, F.array(last, last - 1)).otherwise(F.array(last))))
    own = lambda i, n: F.when(F.col(f"{n}_slot") == i, F.col(f"{n}_bit")).otherwise(F.lit(0).cast("long"))
    slots = range(-(-len(model.features) // 63))
    bits = [F.bit_or(own(i, "u").bitwiseOR(own(i, "b"))).alias(f"m{i}") for i in slots]
    gain = F.sum(F.coalesce("u_gain", F.lit(0.0)) + F.coalesce("b_gain", F.lit(0.0))).alias("gain")
    found = hits.groupBy(*keys, "para", "window").agg(*bits, gain, F.count("*").alias("n"))
    need = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY)) - float(model.bias.max())
    return found.where((F.col("para") == 0) | (F.col("gain") >= need - 1e-6))


def _judged(windows: DataFrame, model: Model) -> DataFrame:
    """windows with `families`, the confirmed ones, and `unnamed`."""
    slots = range(-(-len(model.features) // 63))
    masks = F.array(*(F.col(f"m{i}") for i in slots))
    held = F.filter(
        _literal(list(range(len(model.features)))),
        lambda g: F.getbit(F.element_at(masks, F.floor(g / 63).cast("int") + 1), (g % 63).cast("int")) == 1,
    )
    out = windows.withColumn("held", F.when(F.col("para") > 0, held).otherwise(F.array().cast("array<int>")))
    z = F.aggregate("held", _literal(model.bias), lambda acc, g: F.zip_with(acc, F.element_at(_literal(model.weights), g + 1), lambda a, b: a + b))
    out = out.withColumn("z", z)
    least = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    by_family = [
        F.when(
            (F.element_at("z", f + 1) >= least)
            & F.greatest(*(F.size(F.array_intersect("held", _literal(list(t)))) / F.lit(len(t)) for c, t in model.templates if c == f), F.lit(0.0)).__ge__(MIN_OVERLAP),
            F.lit(name),
        )
        for f, name in enumerate(model.classes[:-1])
    ]
    named = F.array_compact(F.array(*by_family))
    seen = F.col("para") > 0
    return out.withColumn("families", F.when(seen, named).otherwise(F.array().cast("array<string>"))).withColumn(
        "unnamed", seen & (F.element_at("z", len(model.classes)) >= least)
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licences (families found, in order, comma-joined), n_notices (paragraphs
    with a family) and n_unknown (paragraphs with a notice of no known family).

    Null, empty and licence-free texts have an empty list and zero counts.  Every row has
    its own answer; rows repeating a doc_id are judged by their own texts.  Other columns
    are ignored; an empty table gives an empty result.
    """
    model = trained()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Two hashes name a text, 128 bits, so that equal rows are judged once and counted.
    keys = ["doc_id", "h1", "h2"]
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.lower(text).alias("low"))
    parts = F.concat(F.array(F.lit("")), F.split("low", PARAGRAPH_GAPS))
    paragraphs = named.select(*keys, F.posexplode(parts).alias("para", "paragraph"))
    judged = _judged(_windows(paragraphs, model, keys), model)
    each = judged.groupBy(*keys, "para").agg(
        F.array_distinct(F.flatten(F.collect_set("families"))).alias("families"), F.max("unnamed").alias("unnamed"), F.max(F.when(F.col("para") == 0, F.col("n"))).alias("n")
    )
    some = F.size("families") > 0
    found = each.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("licences"),
        F.count_if(some).alias("n_notices"), F.count_if(~some & F.col("unnamed")).alias("n_unknown"), F.max("n").alias("n"),
    )
    part = 1 << 16  # of equal rows, so many are listed at a time
    batches = found.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))))
    rows = batches.withColumn("__r", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(part).cast("long"), F.col("n") - F.col("__b") * part))))
    return rows.select("doc_id", "licences", F.col("n_notices").cast("long").alias("n_notices"), F.col("n_unknown").cast("long").alias("n_unknown"))
