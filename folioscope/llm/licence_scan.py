"""Licence notices in texts: a trained paragraph classifier, confirmed against templates.

A paragraph is what stands between lines without a word, so a notice may be wrapped. Of a paragraph
the stretches are classified that share neighbouring words with any template; no other can be
confirmed. A multinomial logistic regression on hashed word n-grams names a licence family or the
unknown class; its temperature is calibrated on examples it was not fitted on. A family counts only
if, of all templates, the stretch is closest to one of that family's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.logistic import Sparse, stacked
from folioscope.llm.registry import query
from folioscope.llm.shared import sample_ids, table
from folioscope.llm.vectext import LOWER, chained, mixed, raw, slices, word_hashes, words

#: Documents whose lines teach the unknown class, stretches of each, and words of a stretch, at most.
BACKGROUND_DOCS, BACKGROUND_LINES, BACKGROUND_WORDS = 400, 8, 60
CELLS = 1 << 14
#: Least calibrated chance of a family, and least similarity to one of its templates.
SURE_FROM, ALIKE_FROM = 0.5, 0.5
#: Likeness from which the closest template decides, whatever family was predicted.
CERTAIN_FROM = 0.9
#: Words without a template's neighbours that may lie inside a loose and a close stretch, and words of
#: a longer one that are classified together.
GAP, CLOSE, WINDOW = 10, 2, 80
#: A notice that has less than this of its template is dropped beside a better one.
WHOLE_FROM = 0.6
UNKNOWN = "unknown"

# Notices by which licence families are named and granted.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU GPL, version 2.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
    ],
}
# Sentences that speak of licences, versions and rights without granting any.
LOOKALIKES = [
    "She renewed her driver's license at the office in town.",
    "A licence to fish in the river costs forty crowns a year.",
    "The restaurant lost its license after the inspection.",
    "Version 3 of the report was released under embargo on Monday.",
    "The public library is open until four in the afternoon.",
    "Apache helicopters flew over the general's camp.",
    "The court granted permission to appeal.",
    "All rights reserved by the management.",
    "Commons and lords voted on the attribution of the painting.",
    "He studied at MIT and released his first record there.",
]

_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_PLAIN = LOWER.copy()
_PLAIN[_MARK] = 0x20


class Lines(NamedTuple):
    """N-gram cells of all lines with a word: at[first[i]:first[i + 1]]; word bounds and texts."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: list[np.ndarray] | np.ndarray
    first_word: np.ndarray
    pairs: np.ndarray
    first_pair: np.ndarray


def lines(column: pa.Array) -> tuple[np.ndarray, Lines]:
    """Lines of a column of texts. Case and punctuation do not count; a line number counts from 0."""
    data, bounds = raw(column)
    breaks = np.flatnonzero(data == 0x0A)
    ends = np.sort(np.concatenate((breaks + 1, bounds[1:])))
    cuts = np.concatenate(([0], ends))
    w = words(_PLAIN[data], cuts)
    owner = np.searchsorted(bounds, cuts[:-1], "right") - 1
    # A cut at a text's end repeats as the next text's start; lines without words drop out below.
    number = np.arange(len(cuts) - 1) - (np.searchsorted(cuts[:-1], bounds[:-1], "right") - 1)[np.clip(owner, 0, max(0, len(bounds) - 2))]
    h = word_hashes(_PLAIN[data], w.start, w.end)
    pairs, at = chained(h, 2, w.first) if len(h) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    first_pair = np.searchsorted(at, w.first)
    has = np.diff(w.first) > 0
    return data, Lines(
        owner[has], number[has], cuts[:-1][has], cuts[1:][has], h,
        np.append(w.first[:-1][has], w.first[-1]), pairs, np.append(first_pair[:-1][has], first_pair[-1]),
    )


class Model(NamedTuple):
    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float


def _rows(found: Lines) -> list[tuple[np.ndarray, np.ndarray]]:
    cell = np.uint64(CELLS)
    out = []
    for i in range(len(found.text)):
        one = found.words[found.first_word[i] : found.first_word[i + 1]] % cell
        two = mixed(found.pairs[found.first_pair[i] : found.first_pair[i + 1]]) % cell + cell
        at = np.concatenate((one, two)).astype(np.int32)
        out.append((at, np.full(len(at), len(at) ** -0.5, np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _scores(x: Sparse, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, w.shape[1])), np.cumsum(w[x.at] * x.value[:, None], axis=0, dtype=np.float64)))
    return total[x.bounds[1:]] - total[x.bounds[:-1]] + bias


def _examples() -> tuple[list[str], list[str]]:
    """Notices with words left out or others around them, by fixed turns; families of each."""
    texts, names = [], []
    around = [t.split() for t in LOOKALIKES]
    for family, notices in TEMPLATES.items():
        for notice in notices:
            own = notice.split()
            for turn in range(24):
                kept = [v for i, v in enumerate(own) if turn % 6 == 0 or len(own) < 6 or (i * 7 + turn) % 11]
                extra = around[turn % len(around)][: turn % 3 * 2]
                texts.append(" ".join([*kept, *extra] if turn % 2 else [*extra, *kept]))
                names.append(family)
            # Inside a longer line: prose on both sides of the notice or of a half of it.
            for turn in range(6):
                before, after = around[turn], around[(turn + 3) % len(around)]
                part = own if turn % 3 or len(own) < 12 else own[: len(own) // 2] if turn else own[len(own) // 2 :]
                texts.append(" ".join([*before[-6:], *part, *after[:6]]))
                names.append(family)
    for turn in range(24):
        for text in LOOKALIKES:
            own = text.split()
            texts.append(" ".join(v for i, v in enumerate(own) if turn == 0 or (i * 5 + turn) % 9))
            names.append(UNKNOWN)
    return texts, names


def _background(text: str) -> Iterator[str]:
    """Stretches of lines from across a text that share less than half of any notice's words."""
    known = [set(_words(t)) for ts in TEMPLATES.values() for t in ts]
    own = [v for v in text.split("\n") if v.strip()]
    for line in own[:: -(-len(own) // BACKGROUND_LINES) or 1]:
        w = line.split()
        at = zlib.crc32(line.encode()) % max(1, len(w) - BACKGROUND_WORDS + 1)
        part = " ".join(w[at : at + BACKGROUND_WORDS])
        held = set(_words(part))
        if held and max(len(held & n) / len(n) for n in known) < 0.5:
            yield part


def fit(docs: DataFrame) -> Model:
    """Fit on variants of the templates and, as unknown, on stretches of a bounded sample of ``docs``.

    The stretches are cut where their texts are; one task trains on them, and the driver gets the
    weights. Works without any rows.
    """
    ids = sample_ids(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", BACKGROUND_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").dropna()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_background(text), pa.string())], ["part"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _trained(sorted(p for batch in batches for p in batch.column("part").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in (model.weights.tobytes(), model.bias.tobytes())] + [pa.array([model.sharpness])],
            ["weights", "bias", "sharpness"],
        )

    found = (
        sample.mapInArrow(cut, "part string")
        .repartition(1)
        .mapInArrow(train, "weights binary, bias binary, sharpness double")
        .first()
    )
    if found is None:
        return _trained([])
    families = [*TEMPLATES, UNKNOWN]
    weights = np.frombuffer(found.weights, np.float32).reshape(-1, len(families))
    return Model(families, weights, np.frombuffer(found.bias, np.float64), found.sharpness)


def _trained(background: list[str]) -> Model:
    texts, names = _examples()
    names += [UNKNOWN] * len(background)
    families = [*TEMPLATES, UNKNOWN]
    _, found = lines(pa.array([t.replace("\n", " ") for t in [*texts, *background]], pa.string()))
    rows = _rows(found)
    y = np.zeros((len(rows), len(families)))
    for row, of in enumerate(found.text):
        y[row, families.index(names[of])] = 1
    turn = np.arange(len(rows)) % 5 == 4
    x = stacked([r for r, t in zip(rows, turn, strict=True) if not t])
    owner = np.repeat(np.arange(x.rows()), np.diff(x.bounds))
    w, bias = np.zeros((2 * CELLS, len(families))), np.zeros(len(families))
    m, v = np.zeros_like(w), np.zeros_like(w)
    rate = 0.1
    for step in range(1, 61):
        gap = (_softmax(_scores(x, w, bias)) - y[~turn]) / max(1, x.rows())
        g = np.stack(
            [np.bincount(x.at, weights=gap[owner, j] * x.value, minlength=2 * CELLS) for j in range(len(families))], axis=1
        ) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * gap.sum(axis=0)
    z = _scores(stacked([r for r, t in zip(rows, turn, strict=True) if t]), w, bias)
    target = y[turn].argmax(axis=1)
    loss = {
        s: float(-np.log(_softmax(s * z)[np.arange(len(z)), target] + 1e-12).mean())
        for s in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
    }
    return Model(families, w.astype(np.float32), bias, min(loss, key=loss.get))


def _words(text: str) -> list[str]:
    data = _PLAIN[np.frombuffer(text.encode(), np.uint8)]
    w = words(data, np.array([0, len(data)]))
    return [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]


class _Template(NamedTuple):
    family: str
    text: str
    words: frozenset[str]
    pairs: frozenset[tuple[str, str]]


def _templates() -> list[_Template]:
    out = []
    for family, notices in TEMPLATES.items():
        for text in notices:
            w = _words(text)
            out.append(_Template(family, text, frozenset(w), frozenset(zip(w, w[1:], strict=False))))
    return out


#: A stretch of fewer words than this is measured against as many of a template's.
FRAGMENT = 12


def _likeness(own: list[str], t: _Template) -> float:
    """Share of the words and neighbouring words of a template that a stretch has, evenly weighed.

    A stretch shorter than the template is taken as a fragment of it, and measured by its own length.
    """
    held, pairs = set(own), set(zip(own, own[1:], strict=False))
    share = lambda a, b: len(a & b) / max(1, min(len(a), max(FRAGMENT, len(b))))
    return 0.5 * share(t.words, held) + 0.5 * share(t.pairs, pairs)


class _Paragraphs(NamedTuple):
    """Words of a slice's texts: byte bounds, hashes, text and line of each; pairs inside paragraphs."""

    plain: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    text: np.ndarray
    line: np.ndarray
    pairs: np.ndarray
    #: The first word of each pair, and the paragraph that each word is of.
    at: np.ndarray
    paragraph: np.ndarray


def _paragraphs(data: np.ndarray, bounds: np.ndarray) -> _Paragraphs:
    plain = _PLAIN[data]
    w = words(plain, bounds)
    h = word_hashes(plain, w.start, w.end)
    line = np.concatenate(([0], np.cumsum(data == 0x0A)))[w.start] if len(h) else np.zeros(0, np.int64)
    opens = np.ones(len(h), bool)
    opens[1:] = (np.diff(line) > 1) | (np.diff(w.text) > 0)
    first = np.append(np.flatnonzero(opens), len(h))
    pairs, at = chained(h, 2, first) if len(h) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return _Paragraphs(plain, w.start, w.end, h, w.text, line, pairs, at, np.cumsum(opens) - 1)


def _template_pairs() -> np.ndarray:
    """Hashes of all neighbouring words of templates, in order."""
    joined = [t.encode() for ts in TEMPLATES.values() for t in ts]
    data = np.frombuffer(b"\n\n".join(joined), np.uint8)
    return np.unique(_paragraphs(data, np.array([0, len(data)])).pairs)


def _stretches(p: _Paragraphs, known: np.ndarray) -> np.ndarray:
    """Rows (first, end) of words that may be a notice: runs of template neighbours with small gaps.

    Each run counts as a whole, or in overlapping windows if it is long. Its parts without gaps, and
    those on one line, count by themselves too: prose may stand around a notice, or another notice.
    """
    place = np.minimum(np.searchsorted(known, p.pairs), len(known) - 1)
    hit = p.at[known[place] == p.pairs]
    if not len(hit):
        return np.zeros((0, 2), np.int64)
    out = []
    for column, gap in ((p.paragraph, GAP), (p.paragraph, CLOSE), (p.line, CLOSE)):
        cut = np.flatnonzero((np.diff(hit) > gap) | (np.diff(column[hit]) > 0) | (np.diff(p.paragraph[hit]) > 0))
        first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(hit) - 1]))
        some = last > first
        out.append(np.stack((hit[first[some]], hit[last[some]] + 2), axis=1))
    found = np.concatenate(out)
    size = found[:, 1] - found[:, 0]
    windows = [
        (at, min(at + WINDOW, end))
        for first, end in found[size > WINDOW].tolist()
        for at in range(first, end - WINDOW // 2, WINDOW // 2)
    ]
    return np.unique(np.concatenate((found[size <= WINDOW], np.array(windows, np.int64).reshape(-1, 2))), axis=0)


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and where each range begins."""
    size = end - first
    begins = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(first - begins, size), begins


def _classified(p: _Paragraphs, spans: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The most likely family of each stretch, and its calibrated chance."""
    cell = np.uint64(CELLS)
    family, chance = np.zeros(len(spans), np.int64), np.zeros(len(spans))
    for begin in range(0, len(spans), 4096):
        part = spans[begin : begin + 4096]
        at, first = _ranges(part[:, 0], part[:, 1])
        z = np.add.reduceat(model.weights[(p.h[at] % cell).astype(np.int64)], first, axis=0).astype(np.float64)
        low, high = np.searchsorted(p.at, part[:, 0]), np.searchsorted(p.at, part[:, 1] - 1)
        at, first = _ranges(low, high)
        z += np.add.reduceat(model.weights[(mixed(p.pairs[at]) % cell + cell).astype(np.int64)], first, axis=0)
        grams = part[:, 1] - part[:, 0] + high - low
        chances = _softmax(model.sharpness * (z * grams[:, None] ** -0.5 + model.bias))
        family[begin : begin + 4096] = chances.argmax(axis=1)
        chance[begin : begin + 4096] = chances.max(axis=1)
    return family, chance


class _Notice(NamedTuple):
    weight: float
    first: int
    end: int
    family: str
    chance: float
    likeness: float
    template: str
    whole: bool


def _confirmed(p: _Paragraphs, first: int, end: int, family: str, chance: float, templates: list[_Template]) -> _Notice | None:
    own = [p.plain[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(p.start[first:end], p.end[first:end], strict=True)]
    like, _, best = max(((_likeness(own, t), t.family == family, t) for t in templates), key=lambda x: (x[0], x[1], x[2].text))
    if like < ALIKE_FROM or (best.family != family and like < CERTAIN_FROM):
        return None
    shared = [i for i, pair in enumerate(zip(own, own[1:], strict=False)) if pair in best.pairs]
    if not shared:
        return None
    distinct = len({(own[i], own[i + 1]) for i in shared})
    return _Notice(like * distinct, first + shared[0], first + shared[-1] + 2, best.family, chance, like, best.text, distinct >= WHOLE_FROM * len(best.pairs))


FIELDS = "doc_id long, line int, start long, end long, family string, chance double, likeness double, template string"


def _found(part: pa.RecordBatch, model: Model, templates: list[_Template], known: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """(row, notice) for each confirmed notice of a slice, in the order of the texts."""
    data, bounds = raw(part.column("text"))
    p = _paragraphs(data, bounds)
    spans = _stretches(p, known)
    if not len(spans):
        return
    family, chance = _classified(p, spans, model)
    named = np.flatnonzero((family != model.families.index(UNKNOWN)) & (chance >= SURE_FROM))
    notices_ = [
        _confirmed(p, int(spans[i, 0]), int(spans[i, 1]), model.families[family[i]], float(chance[i]), templates) for i in named
    ]
    # Of notices that overlap, that with most of a template counts; a fragment beside it does not.
    taken: list[_Notice] = []
    used = np.full(len(p.h), -1)
    for n in sorted((n for n in notices_ if n), key=lambda n: (-n.weight, n.first, n.end)):
        reach = 0 if n.whole else GAP
        if not (used[max(0, n.first - reach) : n.end + reach] == p.paragraph[n.first]).any():
            used[n.first : n.end] = p.paragraph[n.first]
            taken.append(n)
    newlines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    held: _Notice | None = None
    joined: list[_Notice] = []
    for n in sorted(taken, key=lambda n: n.first):
        near = held is not None and n.family == held.family and n.first - held.end <= GAP
        if near and p.paragraph[n.first] == p.paragraph[held.first]:
            joined[-1] = held = max(held, n)._replace(first=held.first, end=n.end)
        else:
            joined.append(held := n)
    ids = part.column("doc_id").to_pylist()
    for n in joined:
        row = int(p.text[n.first])
        at, stop = int(bounds[row]), int(bounds[row + 1])
        start, end = int(p.start[n.first]), int(p.end[n.end - 1])
        # Marks that touch the last word belong to the notice.
        while end < stop and data[end] > 0x20:
            end += 1
        line = int(newlines[start] - newlines[at])
        yield row, (ids[row], line, start - at, end - at, n.family, n.chance, n.likeness, n.template)


def notices(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each confirmed licence notice in (doc_id, text).

    Columns: doc_id, line (of its first word, from 0), start and end (bytes in the UTF-8 text),
    family, chance (calibrated), likeness to the closest template, and that template. Notices of
    one family that follow one another in a paragraph are one. Null and empty texts have none.
    Texts are read whole; repeated rows give their notices each time; a null doc_id stays null;
    other columns are not read. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, known = _templates(), _template_pairs()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [r for _, r in _found(part, held.value, templates, known)]
                names = [f.split(" ")[0] for f in FIELDS.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)


def licences(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_notices, families) for every row of (doc_id, text): families in order, joined by blanks.

    Rows as in ``notices``; a row without any has 0 and an empty text. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, known = _templates(), _template_pairs()
        for batch in batches:
            for part in slices(batch, "text"):
                own: list[list[str]] = [[] for _ in range(part.num_rows)]
                for row, notice in _found(part, held.value, templates, known):
                    own[row].append(notice[4])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([" ".join(sorted(set(x))) for x in own], pa.string()),
                    ],
                    ["doc_id", "n_notices", "families"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_notices long, families string"
    )


@query("op7_licence_scan")
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: n_notices, and its families in alphabetical order, joined by blanks."""
    docs = table(spark, sf_dir, "documents")
    return licences(docs, fit(docs))
