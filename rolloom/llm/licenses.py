"""License scans by a trained paragraph classifier with template confirmation.

A paragraph is a run of lines with words; lines without any (blank ones, or comment marks
alone) divide paragraphs. Line ends are white space, and marks at the edges of words fall
away, so a notice wrapped at any column, with or without comment marks, has the words of its
template in a row. Scored are all lines, and in paragraphs of several lines or many words also
overlapping windows of ``WINDOW`` words, so that neither a line end nor text around a notice
hides it. Features are words in lower case and pairs of neighbouring words, as far as the
templates have them. Multinomial logistic regression on these sparse features tells license
families apart and from other text. It is trained on the templates below in many variants
(cut, with words missing, inside other text), on hard sentences that use the same words
otherwise, and on a bounded sample of the corpus's own lines and windows. A temperature fitted
on variants kept back calibrates the probabilities; below ``LEAST`` a line with license words
is ``unknown``. A prediction is confirmed when its span holds enough of a template of the
family, in word triples. Overlapping windows of one family are one finding; a line that is
confirmed by itself stands for the windows over it.

Whole texts are scored, without a shuffle. Null and empty texts have no lines; repeated rows
give repeated results; a null key is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.arrow_text import lookup, map_text, mix, slices, span_hashes, words

#: Corpus paragraphs trained on at most, variants of a template, least probability, and least share of a template's triples.
PARAGRAPHS, VARIANTS, LEAST, CONFIRM = 4_000, 40, 0.8, 0.6
#: Words of a window and between the starts of two windows.
WINDOW, STRIDE = 48, 24
#: Notices by which licenses are given, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "bsd": [
        "Released under the 3-clause BSD License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "Released under CC0 1.0 into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2024 the authors. All rights reserved.", "This document is confidential and proprietary. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
#: Sentences with the same words that give no license.
OTHERS = (
    "He got his driving license in May and drove to the public library.",
    "The album was released under pressure from the label in version two of the plan.",
    "Permission to enter the source of the river was granted by the general.",
    "The software is distributed on disks and the public can copy files at work.",
    "A doctor is licensed to work under the terms of this state.",
    "The apache helicopter, version 2, has a source of power in its tail.",
    "All creative people have common rights to free time in general.",
    "Use of the software without the license key is not possible in version 3.",
)
NONE, UNKNOWN = "none", "unknown"
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text column with the row and the line (in the row, from 0) of each; and first line numbers by row."""
    w = words(pc.utf8_lower(column))
    start, end, row = w.start.copy(), w.end.copy(), w.row
    for tail in (False, True):
        going = np.arange(len(start))
        while len(going):
            going = going[(start[going] < end[going]) & _PUNCTUATION[w.data[end[going] - 1 if tail else np.minimum(start[going], len(w.data) - 1)]]]
            if tail:
                end[going] -= 1
            else:
                start[going] += 1
    kept = start < end
    start, end, row = start[kept], end[kept], row[kept]
    feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
    first = feeds[w.offsets[:-1]]
    return (span_hashes(w.data, start, end - start) if len(start) else np.zeros(0, np.uint64)), row, feeds[start] - first[row], first


def hits(h: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of features among words: first word, feature, and words it takes (1, or 2 for a pair), by first word."""
    pairs = mix(h[:-1] * _PAIR + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    one, two = lookup(feature, h), lookup(feature, pairs)
    at = np.concatenate([np.flatnonzero(one >= 0), np.flatnonzero(two >= 0)])
    order = np.argsort(at, kind="stable")
    found = np.concatenate([one[one >= 0], two[two >= 0]])
    size = np.concatenate([np.ones(int((one >= 0).sum()), np.int64), np.full(int((two >= 0).sum()), 2)])
    return at[order], found[order], size[order]


@dataclass
class Units:
    """What is scored: word ranges with their paragraph, and whether they are lines or windows."""

    start: np.ndarray
    end: np.ndarray
    paragraph: np.ndarray
    is_line: np.ndarray


def units(row: np.ndarray, line: np.ndarray) -> Units:
    """Lines, and windows of the paragraphs that have several lines or more words than a window."""
    none = np.zeros(0, np.int64)
    if not len(row):
        return Units(none, none, none, none.astype(bool))
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    step = np.concatenate([[2], line[1:] - line[:-1]])
    first = np.flatnonzero(new_row | (step != 0))
    last = np.append(first[1:], len(row))
    begins = np.flatnonzero(new_row | (step > 1))
    ends = np.append(begins[1:], len(row))
    paragraph = np.searchsorted(begins, first, side="right") - 1
    n_lines = np.bincount(paragraph, minlength=len(begins))
    wide = np.flatnonzero((n_lines > 1) | (ends - begins > WINDOW))
    many = 1 + np.maximum(0, -(-(ends - begins - WINDOW) // STRIDE))[wide]
    own = np.repeat(wide, many)
    number = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    left = begins[own] + number * STRIDE
    right = np.minimum(left + WINDOW, ends[own])
    flag = np.concatenate([np.ones(len(first), bool), np.zeros(len(own), bool)])
    return Units(np.concatenate([first, left]), np.concatenate([last, right]), np.concatenate([paragraph, own]), flag)


def features_of(u: Units, h: np.ndarray, feature: np.ndarray, cues: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units that hold features (or cues among them, if given), and each one's different features: unit, owner, feature."""
    at, x, size = hits(h, feature)
    a, b = np.searchsorted(at, u.start), np.searchsorted(at, u.end)
    if cues is None:
        chosen = np.flatnonzero(b > a)
    else:
        total = np.concatenate([[0], np.cumsum(cues[x])])
        chosen = np.flatnonzero(total[b] > total[a])
    many = (b - a)[chosen]
    owner = np.repeat(np.arange(len(chosen)), many)
    place = np.arange(len(owner)) + np.repeat(a[chosen] - (np.cumsum(many) - many), many)
    inside = at[place] + size[place] <= u.end[chosen][owner]
    code = np.unique(owner[inside] * len(feature) + x[place[inside]])
    return chosen, code // len(feature), code % len(feature)


def _triples(h: np.ndarray) -> set[int]:
    """Hashes of word triples of one paragraph; shorter ones are one tuple."""
    return {hash(tuple(h[i : i + 3].tolist())) for i in range(max(1, len(h) - 2))} if len(h) else set()


@dataclass
class Model:
    """Sorted features, weights by feature and class (``none`` first), biases, temperature, and template triples by family."""

    feature: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    heat: float
    families: list[str]
    triples: dict[str, list[set[int]]]
    cues: np.ndarray


def _variants(rng: np.random.Generator, text: str, filler: list[str]) -> Iterator[str]:
    given = text.split()
    for i in range(VARIANTS):
        own = list(given)
        if i % 3 == 1 and len(own) > 8:
            a = int(rng.integers(0, len(own) // 3))
            own = own[a : a + max(6, int(len(own) * rng.uniform(0.5, 0.9)))]
        if i % 3 == 2:
            own = [x for x in own if rng.random() > 0.1] or own
        extra = [str(x) for x in rng.choice(filler, int(rng.integers(0, 12)))]
        yield " ".join([*extra[: len(extra) // 2], *own, *extra[len(extra) // 2 :]])


def train(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES, paragraphs: int = PARAGRAPHS, seed: int = 11) -> Model:
    """Fit the classifier on template variants and at most ``paragraphs`` paragraphs of the corpus."""
    families = [NONE, *templates]
    rng = np.random.default_rng(seed)
    def all_features(text: str) -> np.ndarray:
        h = tokens(pa.array([text]))[0]
        return np.concatenate([h, mix(h[:-1] * _PAIR + h[1:])])

    own = [all_features(t) for ts in templates.values() for t in ts]
    feature = np.unique(np.concatenate(own))
    triples = {f: [_triples(tokens(pa.array([t]))[0]) for t in ts] for f, ts in templates.items()}
    filler = sorted({w for t in OTHERS for w in t.lower().strip(".").split()})

    def rows_of(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Features of the units of texts, and the row of each."""
        h, row, line, _ = tokens(column)
        u = units(row, line)
        chosen, owner, x = features_of(u, h, feature)
        return np.split(x, np.searchsorted(owner, np.arange(1, len(chosen)))) if len(chosen) else [], row[u.start[chosen]]

    def corpus():
        def each(column):
            lists, row = rows_of(column)
            out: list[list] = [[] for _ in range(len(column))]
            for x, r in zip(lists, row, strict=True):
                out[r].append({"place": len(out[r]), "x": x.tolist()})
            return [pa.array(out, pa.list_(pa.struct([("place", pa.int64()), ("x", pa.list_(pa.int32()))])))]

        return each

    n = docs.count()
    h = F.pmod(F.xxhash64(text, F.lit("licenses")), F.lit(1 << 30))
    thin = docs.where(h < int(min(1.0, paragraphs / 4 / max(n, 1)) * (1 << 30))).select(F.col(text).alias("t"), h.alias("h"))
    found = map_text(thin, "t", ["h"], {"f": "array<struct<place:bigint,x:array<int>>>"}, corpus).select("h", F.inline("f"))
    drawn = [np.array(r["x"], np.int64) for r in found.orderBy(F.xxhash64("h", "place"), "h", "place", F.col("x").cast("string")).limit(paragraphs).collect()]
    # paragraphs that look like a template are no examples of other text
    whole = [set(lookup(feature, g).tolist()) for g in own]
    drawn = [x for x in drawn if not any(len(w & set(x.tolist())) >= 0.7 * len(w) for w in whole)]

    xs, ys = [], []
    for f, ts in templates.items():
        for t in ts:
            for v in _variants(rng, t, filler):
                xs += rows_of(pa.array([v.replace("\n", " ")]))[0][:1]
                ys += [families.index(f)] * (len(xs) - len(ys))
    for t in OTHERS:
        for v in _variants(rng, t, filler):
            xs += rows_of(pa.array([v]))[0][:1]
            ys += [0] * (len(xs) - len(ys))
    xs += [*drawn, np.zeros(0, np.int64)]
    ys += [0] * (len(xs) - len(ys))
    y = np.array(ys)
    back = rng.random(len(y)) < 0.25
    weight, bias = _fit([x for x, b in zip(xs, back, strict=True) if not b], y[~back], len(feature), len(families))
    held = np.array([weight[x].sum(0) + bias for x, b in zip(xs, back, strict=True) if b])
    heats = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
    heat = max(heats, key=lambda t: float(np.log(np.maximum(_softmax(held * t)[np.arange(len(held)), y[back]], 1e-9)).sum())) if len(held) else 1.0
    # words that speak for a license more than for other text
    cues = weight[:, 1:].max(1) > weight[:, 0] + 0.5
    return Model(feature, weight, bias, heat, families, triples, cues)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _fit(xs: list[np.ndarray], y: np.ndarray, n: int, classes: int, steps: int = 250, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on presence features by Adam; classes weigh the same."""
    x = np.concatenate(xs)
    row = np.repeat(np.arange(len(xs)), [len(v) for v in xs])
    share = 1.0 / np.maximum(np.bincount(y, minlength=classes), 1)[y]
    share /= share.sum()
    target = np.zeros((len(xs), classes))
    target[np.arange(len(xs)), y] = 1
    w, b = np.zeros((n, classes)), np.zeros(classes)
    m, v = np.zeros((n + 1, classes)), np.zeros((n + 1, classes))
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(row, w[x, c], len(xs)) for c in range(classes)], 1) + b
        d = (_softmax(z) - target) * share[:, None]
        g = np.stack([np.bincount(x, d[row, c], n) for c in range(classes)], 1) + 2 * ridge * w
        g = np.vstack([g, d.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


@dataclass
class Finding:
    """A span of words taken for a notice."""

    start: int
    end: int
    family: str
    probability: float
    similarity: float = 0.0
    confirmed: bool = False


def _similarity(h: np.ndarray, f: Finding, triples: dict[str, list[set[int]]]) -> float:
    mine = _triples(h[f.start : f.end])
    return max(len(mine & t) / len(t) for t in triples[f.family])


def _trimmed(h: np.ndarray, f: Finding, triples: dict[str, list[set[int]]]) -> None:
    """Cut a span of windows to the words of its family's templates."""
    known = set().union(*triples[f.family])
    at = [i for i in range(f.start, max(f.start + 1, f.end - 2)) if hash(tuple(h[i : i + 3].tolist())) in known]
    if at:
        f.start, f.end = at[0], min(f.end, at[-1] + 3)


def findings(h: np.ndarray, u: Units, chosen: np.ndarray, p: np.ndarray, model: Model, least: float, confirm: float) -> list[Finding]:
    """Findings from the probabilities of units, paragraph by paragraph."""
    best = p.argmax(1)
    out: list[Finding] = []
    by_paragraph: dict[int, list[int]] = {}
    for i in np.flatnonzero(best > 0).tolist():
        by_paragraph.setdefault(int(u.paragraph[chosen[i]]), []).append(i)
    overlap = lambda f, g: f.start < g.end and g.start < f.end
    for members in by_paragraph.values():
        lines, windows, doubts = [], [], []
        for i in members:
            k = chosen[i]
            f = Finding(int(u.start[k]), int(u.end[k]), model.families[int(best[i])], float(p[i, best[i]]))
            if f.probability >= least:
                (lines if u.is_line[k] else windows).append(f)
            elif u.is_line[k]:
                f.similarity, f.family = _similarity(h, f, model.triples), UNKNOWN
                doubts.append(f)
        for f in lines:
            f.similarity = _similarity(h, f, model.triples)
            f.confirmed = f.similarity >= confirm
        sure = [f for f in lines if f.confirmed]
        merged: list[Finding] = []
        for f in sorted(windows, key=lambda f: f.start):
            if any(overlap(f, g) and f.family == g.family for g in sure):
                continue
            near = next((g for g in merged if g.family == f.family and overlap(f, g)), None)
            if near:
                near.end, near.probability = max(near.end, f.end), max(near.probability, f.probability)
            else:
                merged.append(f)
        for f in merged:
            f.similarity = _similarity(h, f, model.triples)
            f.confirmed = f.similarity >= confirm
            _trimmed(h, f, model.triples)
        wide = [f for f in merged if f.confirmed]
        sure += wide
        # what is not confirmed stands only where nothing confirmed does; a line goes before windows
        rest = [f for f in lines if not f.confirmed and not any(overlap(f, g) for g in wide)]
        rest += [f for f in merged if not f.confirmed and not any(overlap(f, g) for g in [*sure, *rest])]
        out += sure + rest + [f for f in doubts if not any(overlap(f, g) for g in [*sure, *rest])]
    return out


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """One row per finding: the key, ``line`` (its first, from 0), ``last_line``, ``family``, ``probability``, ``similarity``, ``confirmed``.

    ``family`` is ``unknown`` where license words stand in a line but no family is likely enough.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        now = Model(**shared.value)
        classes = len(now.families)
        for batch in batches:
            for part in slices(batch, "t"):
                h, row, line, _ = tokens(part.column(1))
                u = units(row, line)
                chosen, owner, x = features_of(u, h, now.feature, now.cues)
                z = np.stack([np.bincount(owner, now.weight[x, c], len(chosen)) for c in range(classes)], 1) + now.bias if len(chosen) else np.zeros((0, classes))
                found = findings(h, u, chosen, _softmax(z * now.heat), now, least, confirm) if len(chosen) else []
                at = np.array([f.start for f in found], np.int64)
                last = np.array([f.end - 1 for f in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row[at], pa.int64())), pa.array(line[at], pa.int64()), pa.array(line[last], pa.int64()), pa.array([f.family for f in found], pa.string()),
                        pa.array([f.probability for f in found], pa.float64()), pa.array([f.similarity for f in found], pa.float64()), pa.array([f.confirmed for f in found], pa.bool_()),
                    ],
                    ["id", "line", "last_line", "family", "probability", "similarity", "confirmed"],
                )

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, line bigint, last_line bigint, family string, probability double, similarity double, confirmed boolean")
    return found.toDF(key, "line", "last_line", "family", "probability", "similarity", "confirmed")
