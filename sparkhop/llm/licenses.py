"""Licence scans, in DataFrame functions only.

Each line of a text is a paragraph, and so is each run of up to ``RUN_LINES``
lines without a blank one between, for notices that are wrapped.  A logistic regression on hashed word
unigrams and bigrams says whether it speaks of a licence; a multinomial one with
a class for unknown licences names the family.  Both are sparse, trained here on
variants of the templates below, on made-up licences for the unknown class, and
on at most ``SAMPLE_LINES`` lines of the corpus as ordinary text; the second is
calibrated by a temperature fitted on held-out variants.  A family counts only
if its calibrated probability reaches ``SURE`` and the line holds most word
bigrams of one of its templates; otherwise the line counts as unknown.  A run
counts only if its first and its last line each add bigrams of such a template;
its lines then are of its family, unless one is named by itself or by a shorter
run.

Training runs on the driver over a bounded sample.  Scoring is one pass of
column expressions with the weights as literals of fixed size.

Defined results: null and empty texts have no lines; rows with one key are
counted together, so repeated rows add up; a null key is one group; an empty
table gives no rows.  Key and text alone are read, under names of their own, so
other columns cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest_hashes

BUCKETS = 4096
SAMPLE_LINES = 4000
#: Characters of a training line at most, from all over the line.
SAMPLE_CHARS = 1000
#: Weight of all ordinary training lines for each unit of licence lines.
ORDINARY = 4.0
GATE = 0.5
SURE = 0.5
CONFIRM = 0.6
RUN_LINES = 5
#: Words that say little; texts are searched for them only where others do not do.
COMMON = set("0 1 2 3 4 a and any are as at be by conditions copy domain extent files following for found free from general in into is it kind march may modify not of on or person possible provided public released rights source subject terms that the this to under version with without work you".split())
SCALE = 1000  # weights are kept in thousandths

#: Well-known sentences of public licences, by family.  Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["licensed under the GNU Affero General Public License, version 3", "GNU AGPL v3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the 3-clause BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL, version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License"],
    "mit": [
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "proprietary": ["All rights reserved", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
}
UNKNOWN = "unknown"
CLASSES = [*TEMPLATES, UNKNOWN]
_SPLIT = "[^a-z0-9]+"


def _words(line: str) -> list[str]:
    return [w for w in re.split(_SPLIT, line.lower()) if w]


def _hash(w: str, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(w.encode(), seed=seed)


def buckets(line: str) -> list[int]:
    """The features of a line; the same as ``_features`` in columns."""
    w = _words(line)
    found = {_hash(a) % BUCKETS for a in w} | {_hash(b, _hash(a)) % BUCKETS for a, b in zip(w, w[1:])}
    return sorted(found)


def _features(ws: Column) -> Column:
    one = F.transform(ws, lambda w: F.xxhash64(w))
    two = F.transform(F.sequence(F.lit(2), F.size(ws)), lambda i: F.xxhash64(ws[i - 2], ws[i - 1]))
    both = F.when(F.size(ws) > 1, F.concat(one, two)).otherwise(one)
    return F.array_distinct(F.transform(both, lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))


def _variants(r: np.random.Generator, line: str, n: int) -> list[str]:
    """The line with words dropped at its ends, other case, words around it."""
    around = "see file for details copyright 2019 2021 2024 the authors project notice this code text page is by and our".split()
    out = [line, line + "."]
    for _ in range(n):
        w = line.split()
        if len(w) > 6 and r.random() < 0.5:
            a = int(r.integers(0, len(w) // 3))
            w = w[a:]
        for _ in range(int(r.integers(0, 6))):
            w.insert(0 if r.random() < 0.5 else len(w), str(r.choice(around)))
        t = " ".join(w)
        out.append(t.upper() if r.random() < 0.1 else t.lower() if r.random() < 0.2 else t)
    return out


def _unknowns(r: np.random.Generator, n: int) -> list[str]:
    """Statements of licences that do not exist."""
    shapes = ["Licensed under the {} License", "Released under the {} License, version {}", "This work is licensed under the {} Public License", "Distributed under the terms of the {} licence agreement", "{} Open Licence {}", "SPDX-License-Identifier: {}"]
    name = lambda: "".join(r.choice(list("bcdfglmnprstvz")) + r.choice(list("aeiou")) for _ in range(int(r.integers(2, 5)))).title()
    return [str(r.choice(shapes)).format(name(), int(r.integers(1, 9))) for _ in range(n)]


class _Sparse:
    """Rows of features, each scaled to length 1, by row and by column."""

    def __init__(self, lines: list[str]):
        found = [buckets(line) or [0] for line in lines]
        size = np.array([len(f) for f in found])
        self.rows = len(found)
        self.at = np.concatenate([np.array(f) for f in found])
        self.value = np.repeat(1 / np.sqrt(size), size)[:, None]
        self.starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.argsort(self.at, kind="stable")
        self.row = np.repeat(np.arange(self.rows), size)[order]
        self.column_value = self.value[order]
        self.columns, self.column_starts = np.unique(self.at[order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at] * self.value, self.starts, axis=0)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((BUCKETS, g.shape[1]))
        out[self.columns] = np.add.reduceat(g[self.row] * self.column_value, self.column_starts, axis=0)
        return out


def _regress(x: _Sparse, y: np.ndarray, classes: int, weight: np.ndarray | None = None, rounds: int = 100, rate: float = 2.0, shrink: float = 2e-5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated proximal steps; the
    shrinkage makes it sparse."""
    w, b = np.zeros((BUCKETS, classes)), np.zeros(classes)
    before, hot = (w, b), np.eye(classes)[y]
    weight = np.ones(len(y)) if weight is None else weight
    weight = (weight / weight.sum())[:, None]
    for i in range(rounds):
        k = i / (i + 3)
        v, c = w + k * (w - before[0]), b + k * (b - before[1])
        z = x.times(v) + c
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - hot) * weight
        before = (w, b)
        w = v - rate * (x.transposed(g) + decay * v)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)
        b = c - rate * g.sum(0)
    return w, b


class Model:
    def __init__(self, ordinary: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        family = [(line, k) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name] for line in _variants(r, t, 24)]
        family += [(line, len(TEMPLATES)) for line in _unknowns(r, 500)]
        known = re.compile("licen[cs]|copyright|rights reserved", re.IGNORECASE)
        plain = [t for t in ordinary if not known.search(t)]
        plain += ["", "permission to enter the software lab", "the public work of the version", "free use of the rights of way", "version 2 of the general report", "the general public was there", "see the file for details", "copyright office opens at nine", "a license plate was found on the road", "his driving licence had expired"]
        held = r.random(len(family)) < 0.25
        text, y = [t for t, _ in family], np.array([k for _, k in family])
        pick = lambda mask: [t for t, m in zip(text, mask) if m]
        w, b = _regress(_Sparse(pick(~held)), y[~held], len(CLASSES))
        z = _Sparse(pick(held)).times(w) + b
        losses = []
        for t in (temperatures := np.geomspace(0.25, 4, 25)):
            q = z / t - (z / t).max(1, keepdims=True)
            losses.append(-(q - np.log(np.exp(q).sum(1, keepdims=True)))[np.arange(len(q)), y[held]].mean())
        best = temperatures[int(np.argmin(losses))]
        self.family, self.family_bias = w / best, b / best
        # ordinary lines outnumber licence lines by far in any corpus, and weigh so here
        weight = np.r_[np.ones(len(text)), np.full(len(plain), ORDINARY * len(text) / len(plain))]
        g, c = _regress(_Sparse(text + plain), np.r_[np.ones(len(text), int), np.zeros(len(plain), int)], 2, weight)
        self.gate, self.gate_bias = g[:, 1] - g[:, 0], float(c[1] - c[0])


def sample_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = SAMPLE_LINES) -> list[str]:
    """One line each of ``limit`` documents at most: those of the smallest
    hashes, the line by the hash, too; of a longer line the ``SAMPLE_CHARS``
    characters from a place that the hash chooses in the whole line."""
    chosen = smallest_hashes(docs.select(key).where(F.col(key).isNotNull()), key, limit).distinct()
    rows = docs.join(F.broadcast(chosen), key, "left_semi").where(F.length(text) > 0).select(F.xxhash64(key).alias("h"), F.split(F.col(text), "\n").alias("lines"))
    rows = rows.select("h", F.col("lines")[F.pmod("h", F.size("lines")).cast("int")].alias("line"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("line") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("h", F.substring("line", start, F.lit(SAMPLE_CHARS)).alias("line"))
    return [r[1] for r in sorted(rows.limit(limit).collect())]


def _literal(values: np.ndarray) -> Column:
    whole = np.round(np.clip(values, -2000, 2000) * SCALE).astype(np.int64)
    return F.split(F.lit(",".join(map(str, whole.tolist()))), ",").cast("array<int>")  # folded to one literal


def _sum(at: Column, weights: Column) -> Column:
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, i: acc + F.element_at(weights, i + 1))


def cues() -> list[str]:
    """Words of which a text that holds any template has at least one: long words
    of each template, as many as leave too few bigrams to confirm it."""
    out: set[str] = set()
    for t in (t for templates in TEMPLATES.values() for t in templates):
        want, w = _wanted(t), sorted(set(_words(t)), key=lambda x: (x not in out, x in COMMON, -len(x), x))
        while sum(not out & set(p.split()) for p in want) >= CONFIRM * len(want):
            out.add(w.pop(0))
    return sorted(out)


def _wanted(template: str) -> list[str]:
    w = _words(template)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])} or set(w))


def _pairs(ws: Column) -> Column:
    pairs = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(2), F.size(ws)), lambda i: F.concat_ws(" ", ws[i - 2], ws[i - 1]))).otherwise(ws)
    return F.array_distinct(pairs)


def lines(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, paragraph, family, probability) of each line that speaks of
    a licence; ``line`` counts from 0, ``paragraph`` is the line or the run that
    it is judged by."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, F.xxhash64(whole).alias("copy"), F.split(whole, "\n").alias("all"), F.when(F.lower(whole).rlike(f"(?<![a-z0-9])({'|'.join(cues())})(?![a-z0-9])"), F.lit(RUN_LINES)).otherwise(F.lit(1)).alias("most"))
    rows = rows.select(key, "copy", F.posexplode(F.transform("all", lambda _, i: F.slice(F.col("all"), i + 1, F.col("most")))).alias("line", "next"))
    rows = rows.select(key, "copy", "line", "next", F.explode(F.sequence(F.lit(1), F.size("next"))).alias("n"))
    rows = rows.select(key, "copy", "line", "n", F.slice("next", F.lit(1), F.col("n")).alias("run"))
    rows = rows.where((F.col("n") == 1) | ~F.exists("run", lambda x: ~x.rlike("(?i)[a-z0-9]"))).withColumn("paragraph", F.array_join("run", "\n"))
    # explode(array(x)) computes x once: filters are not moved below it with a copy of x
    once = lambda name, c: rows.select("*", F.explode(F.array(c)).alias(name))
    rows = once("ws", F.filter(F.split(F.lower("paragraph"), _SPLIT), lambda w: w != "")).where(F.size("ws") > 0)
    rows = once("at", _features(F.col("ws")))
    root = F.sqrt(F.size("at"))
    gate = _sum(F.col("at"), _literal(model.gate)) / SCALE / root + F.lit(model.gate_bias)
    rows = rows.where(F.lit(1.0) / (F.lit(1.0) + F.exp(-gate)) >= GATE)
    for k, name in enumerate(CLASSES):
        rows = rows.withColumn(f"z_{k}", _sum(F.col("at"), _literal(model.family[:, k])) / SCALE / F.sqrt(F.size("at")) + F.lit(float(model.family_bias[k])))
    z = [F.col(f"z_{k}") for k in range(len(CLASSES))]
    rows = rows.withColumn("top", F.greatest(*z))
    rows = rows.withColumn("probability", F.lit(1.0) / sum((F.exp(c - F.col("top")) for c in z), F.lit(0.0)))
    guess = F.coalesce(*(F.when(c == F.col("top"), F.lit(name)) for c, name in zip(z, CLASSES)))
    rows = rows.withColumn("guess", guess)
    split = lambda run: F.filter(F.split(F.lower(F.array_join(run, "\n")), _SPLIT), lambda w: w != "")
    rows = once("pairs", _pairs(F.col("ws")))
    rows = once("start_pairs", _pairs(split(F.slice("run", F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))))))
    rows = once("end_pairs", _pairs(split(F.slice("run", F.lit(2), F.greatest(F.col("n") - 1, F.lit(1))))))

    def held(pairs: str, template: str) -> Column:
        return F.size(F.array_intersect(F.col(pairs), F.array(*map(F.lit, _wanted(template)))))

    confirmed = F.lit(False)
    for name, templates in TEMPLATES.items():
        some = F.lit(False)
        for t in templates:
            n = held("pairs", t)
            some = some | (n >= CONFIRM * len(_wanted(t))) & ((F.col("n") == 1) | (held("start_pairs", t) < n) & (held("end_pairs", t) < n))
        confirmed = confirmed | (F.col("guess") == name) & some
    family = F.when((F.col("probability") >= SURE) & confirmed, F.col("guess")).otherwise(F.lit(UNKNOWN))
    rows = rows.withColumn("family", family).where((F.col("n") == 1) | (F.col("family") != UNKNOWN))
    # each line by the shortest paragraph that names it; equal rows count on their own
    rank = F.when(F.col("family") == UNKNOWN, F.lit(RUN_LINES + 1)).otherwise(F.col("n"))
    judged = rows.select(key, "copy", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n") - 1)).alias("line"), rank.alias("rank"), F.col("line").alias("start"), "paragraph", "family", "probability")
    judged = judged.groupBy(*judged.columns).agg(F.count(F.lit(1)).alias("copies"))
    best = judged.groupBy(key, "copy", "line").agg(F.min(F.struct("rank", "start", "paragraph", "family", "probability", "copies")).alias("best"))
    return best.select(key, "line", "best.paragraph", "best.family", "best.probability", F.explode(F.sequence(F.lit(1), F.col("best.copies"))).alias("_")).drop("_")


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_license_lines, families, least_probability) of each key."""
    found = lines(docs, model, key, text).select(key, "family", "probability")
    every = docs.select(key, F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("probability"))
    return every.unionByName(found).groupBy(key).agg(F.count("family").alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.min("probability").alias("least_probability"))
