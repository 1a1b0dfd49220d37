"""License scans: a trained paragraph classifier, with template comparison.

A sparse logistic regression over word 1- and 2-grams tells licence families and an "unknown" class.  It is fitted on the
driver from the notices below, varied at random, and from paragraphs of a bounded hash sample of the corpus as unknown
ones (``SAMPLE_DOCS``); a temperature, fitted on notices and paragraphs left out, calibrates its probabilities.  Lines
are judged in windows of ``WINDOW`` words that overlap by half, by prefix sums of each n-gram's weights.  Windows also run
over line breaks, up to a line without words, so that wrapped notices are found; they are reported by their first line, and only
where no line of theirs holds the family by itself; a line that has only words of such a notice is no other one.  A window that is predicted as a family is confirmed if it holds enough of the words of one of its templates.
One map over whole texts.

Defined cases: null and empty texts have no paragraphs; blank lines are none; repeated rows are reported each; null ids
are reported as null; an empty corpus only lacks the corpus part of the unknown class.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import batch, text_map
from .fit import text_chunks
from .kernel import BYTE_POLY, BYTE_TABLE, Chunk, U64, mix

# Usual short notices of each family.
NOTICES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL, version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Released under the LGPL, version 3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
# Ordinary sentences that share words with notices.
ORDINARY = ["He lost his driving license on the way to work.", "The rights of the people were not reserved for later.", "She released the book under a new name.", "All of the work is done in public.", "The general version of this public law is free.", "Apache helicopters were used in the war.", "She studied at MIT and works there now.", "A table was reserved for all of them.", "Permission to use the room was granted.", "The software was free and the source was open.", "The terms of the contract were common.", "Attribution of the work is hard."]
FAMILIES = ["unknown", *sorted(NOTICES)]
BITS = 15
WINDOW = 40
#: Windows whose n-grams are summed at once.
BLOCK = 1 << 13
#: Bounds of the unknown class: documents, bytes of text in all, and paragraphs of one document.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 2 << 20
SAMPLE_PARAGRAPHS = 20
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Grams:
    """Tokens of a chunk, their 1- and 2-gram buckets, windows of lines and then, from ``wrapped`` on, windows over lines."""

    def __init__(self, chunk: Chunk):
        line = chunk.data == 10
        self.start, self.end, _ = chunk.runs(TOKEN[chunk.data])
        self.low = chunk.lowered()
        h = BYTE_POLY[0].runs(BYTE_TABLE[0][self.low], self.start, self.end)
        lines_before = np.concatenate([[0], np.cumsum(line)])
        self.doc = np.searchsorted(chunk.offsets, self.start, "right") - 1
        self.line = lines_before[self.start] - lines_before[chunk.offsets[:-1]][self.doc]
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.line[1:] != self.line[:-1])
        self.first = np.flatnonzero(new)
        size = np.diff(np.append(self.first, n))
        joined = np.zeros(n, bool)
        joined[:-1] = (self.doc[1:] == self.doc[:-1]) & (self.line[1:] - self.line[:-1] <= 1)
        self.one = (mix(h) >> U64(64 - BITS)).astype(np.int64)
        pair = np.zeros(n, np.int64)
        pair[:-1] = (mix(h[:-1] * U64(31) + mix(h[1:])) >> U64(64 - BITS)).astype(np.int64)
        self.two, self.joined = pair, joined
        half = WINDOW // 2
        count = np.maximum(1, -(-(size - WINDOW) // half) + 1)
        par = np.repeat(np.arange(len(size)), count)
        rank = np.arange(len(par)) - np.repeat(np.cumsum(count) - count, count)
        self.lo = self.first[par] + rank * half if n else np.zeros(0, np.int64)
        self.hi = np.minimum(self.lo + WINDOW, (self.first + size)[par]) if n else np.zeros(0, np.int64)
        self.wrapped = len(self.lo)
        if n:
            starts = -(-size // half)
            par = np.repeat(np.arange(len(size)), starts)
            lo = self.first[par] + (np.arange(len(par)) - np.repeat(np.cumsum(starts) - starts, starts)) * half
            stops = np.flatnonzero(~joined) + 1
            hi = np.minimum(lo + WINDOW, stops[np.searchsorted(stops, lo, "right")])
            over = hi > (self.first + size)[par]
            self.lo, self.hi = np.concatenate([self.lo, lo[over]]), np.concatenate([self.hi, hi[over]])

    def logits(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Of each window, by prefix sums of what each token and each pair adds, over blocks of windows: double precision
        and short sums, so that a window's value does not depend on how much stands before it."""
        out = np.zeros((len(self.lo), weights.shape[1]))
        for a, b in [(0, self.wrapped), (self.wrapped, len(self.lo))]:
            for x in range(a, b, BLOCK):
                lo, hi = self.lo[x : min(b, x + BLOCK)], self.hi[x : min(b, x + BLOCK)]
                first, last = int(lo[0]), int(hi.max())
                sums = np.zeros((2, last - first + 1, weights.shape[1]))
                np.cumsum(weights[self.one[first:last]], axis=0, dtype=float, out=sums[0, 1:])
                np.cumsum(np.where(self.joined[first:last, None], weights[self.two[first:last]], 0), axis=0, dtype=float, out=sums[1, 1:])
                lo, hi = lo - first, hi - first
                out[x : x + len(lo)] = sums[0][hi] - sums[0][lo] + sums[1][hi - 1] - sums[1][lo] + bias
        return out


def words(text: bytes) -> set[bytes]:
    return set(WORD.findall(text.lower()))


TEMPLATES = {f: [words(t.encode()) for t in ts] for f, ts in NOTICES.items()}


def likeness(family: str, held: set[bytes]) -> float:
    """Largest share of a template's words that the text has."""
    return max(len(t & held) / len(t) for t in TEMPLATES[family])


def shared_words(family: str, held: set[bytes]) -> set[bytes]:
    """The words of the most alike template that the text has."""
    return max(TEMPLATES[family], key=lambda t: len(t & held) / len(t)) & held


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def windows(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        z = grams.logits(self.weights, self.bias) / self.temperature
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1) if len(p) else np.zeros(0, np.int64)
        return best, p[np.arange(len(p)), best]


def varied(text: str, rnd: random.Random, filler: list[str]) -> str:
    """A notice as it may stand in a paragraph: other case, other years, a lost word, words around it."""
    w = text.split()
    if len(w) > 5 and rnd.random() < 0.3:
        del w[rnd.randrange(len(w))]
    before, after = (rnd.sample(filler, min(len(filler), rnd.randint(0, 8))) if rnd.random() < 0.4 else [] for _ in range(2))
    out = " ".join([*before, *w, *after])
    return rnd.choice([out, out, out.upper(), out.lower(), f"# {out}", f"Copyright (c) {rnd.randint(1990, 2030)} {out}"])


def fit(paragraphs: list[str], copies: int = 40, rounds: int = 120) -> Model:
    """``paragraphs`` come from the corpus; those that hold a whole template are left out of the unknown class."""
    rnd = random.Random(11)
    plain = [p for p in paragraphs if max(likeness(f, words(p.encode())) for f in NOTICES) < 0.6]
    filler = [w for p in plain[:300] for w in p.split()][:3000] or ["the", "of"]
    texts, y = list(plain), [0] * len(plain)
    for t in ORDINARY:
        texts += [varied(t, rnd, filler) for _ in range(copies)]
        y += [0] * copies
    for k, f in enumerate(FAMILIES[1:], 1):
        for t in NOTICES[f]:
            texts += [varied(t, rnd, filler) for _ in range(copies)]
            y += [k] * copies
            # What is left of a notice when its telling words go is unknown.
            common = [w for w in t.split() if not any(w.lower().strip(".,;") in o for o in (t2.lower() for f2, ts in NOTICES.items() if f2 == f for t2 in ts)) or rnd.random() < 0.3]
            if common and max(likeness(g, words(" ".join(common).encode())) for g in NOTICES) < 0.5:
                texts.append(" ".join(common))
                y.append(0)
    order = rnd.sample(range(len(texts)), len(texts))
    texts = [" ".join(texts[k].split()[: WINDOW - 1]) for k in order]
    y = np.array(y)[order]
    rows, cols = [], []
    for n, text in enumerate(texts):
        g = Grams(next(text_chunks([text or " "])))
        c = np.concatenate([g.one, g.two[g.joined]])
        rows.append(np.full(len(c), n))
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    kinds, held = len(FAMILIES), np.arange(len(texts)) % 5 == 0
    gold = np.eye(kinds)[y]
    share = np.where(y == 0, 0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y > 0).sum())) * ~held
    w, b = np.zeros((1 << BITS, kinds)), np.zeros(kinds)
    used, place = np.unique(cols, return_inverse=True)
    v = np.zeros((len(used), kinds))
    seen, seen_b = np.full(v.shape, 1e-8), np.full(kinds, 1e-8)

    def outputs() -> np.ndarray:
        z = np.zeros((len(texts), kinds))
        np.add.at(z, rows, v[place])
        return z + b

    for _ in range(rounds):
        z = outputs()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - gold) * share[:, None]
        g = np.zeros_like(v)
        np.add.at(g, place, d[rows])
        g += 1e-4 / len(used) * v
        seen += g * g
        v -= 0.3 * g / np.sqrt(seen)
        gb = d.sum(0)
        seen_b += gb * gb
        b = b - 0.3 * gb / np.sqrt(seen_b)
    z = outputs()[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(gold[held] * (s - np.log(np.exp(s).sum(1, keepdims=True)))).sum())

    w[used] = v
    return Model(w.astype(np.float32), b.astype(np.float32), min((0.25 * 1.25**k for k in range(16)), key=loss) if held.any() else 1.0)


def corpus_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The first SAMPLE_PARAGRAPHS lines of each of a hash sample of at most SAMPLE_DOCS documents, of at most SAMPLE_BYTES
    bytes in all; a text that does not fit into what is left of these is left out, and the next ones are tried."""
    out, used = [], 0
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.expr(f"id is not null and octet_length(text) <= {SAMPLE_BYTES}"))
    ids = source.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    for r in source.join(F.broadcast(ids), "id", "left_semi").orderBy(F.xxhash64("id"), "id", "text").toLocalIterator():
        size = len(r["text"].encode())
        if used + size <= SAMPLE_BYTES:
            used += size
            out += [p for p in r["text"].split("\n") if p.strip()][:SAMPLE_PARAGRAPHS]
    return out


def scan_licenses(docs: DataFrame, model: Model, least: float = 0.5, same: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line or wrapped paragraph with a notice: id, paragraph (first line's number from 0), family, probability, similarity (largest
    share of a template's words), confirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch, chunk: Chunk) -> pa.RecordBatch | None:
        g = Grams(chunk)
        if not len(g.one):
            return None
        best, p = shared.value.windows(g)
        lines, over = [], []
        raw = g.low.tobytes()
        for k in np.flatnonzero((best > 0) & (p >= least)).tolist():
            lo, hi = int(g.lo[k]), int(g.hi[k])
            held = {raw[a:b] for a, b in zip(g.start[lo:hi].tolist(), g.end[lo:hi].tolist())}
            key = (int(g.doc[lo]), int(g.line[lo]), int(best[k]))
            hit = (likeness(FAMILIES[best[k]], held), lo, hi, key, float(p[k]), shared_words(FAMILIES[best[k]], held))
            if k < g.wrapped:
                lines.append(hit)
            elif hit[0] >= same:
                over.append(hit)
        alone = {key for like, _, _, key, _, _ in lines if like >= same}
        taken: dict[int, list[tuple]] = {}
        # Of windows that overlap the most alike one counts, the last one of equals: it starts where the notice does.
        for hit in sorted(over, key=lambda h: h[:2], reverse=True):
            _, lo, hi, (doc, line, kind), _, _ = hit
            if not any(lo < w[2] and w[1] < hi and w[3][2] == kind for w in taken.get(doc, ())) and not any((doc, x, kind) in alone for x in range(line, int(g.line[hi - 1]) + 1)):
                taken.setdefault(doc, []).append(hit)
        hits: dict[tuple[int, int, int], tuple[float, float]] = {}
        for hit in [*lines, *(w for ws in taken.values() for w in ws)]:
            like, lo, hi, key, prob, told = hit
            # A part of a wrapped notice is no notice of another family.
            if not any(lo < w[2] and w[1] < hi and w[3][2] != key[2] and like < w[0] and told <= w[5] for w in taken.get(key[0], ())):
                hits[key] = max(hits.get(key, (0.0, 0.0)), (like, prob))
        if not hits:
            return None
        doc, line, kind = (np.array(x) for x in zip(*hits))
        like, prob = (np.array(x) for x in zip(*hits.values()))
        return batch(id=rows.column(0).take(pa.array(doc)), paragraph=line.astype(np.int32), family=[FAMILIES[k] for k in kind], probability=prob, similarity=like, confirmed=like >= same)

    kind = docs.schema[id_col].dataType.simpleString()
    return text_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, paragraph int, family string, probability double, similarity double, confirmed boolean").withColumnRenamed("id", id_col)


def licenses(docs: DataFrame) -> DataFrame:
    """Confirmed notices of every document."""
    return scan_licenses(docs, fit(corpus_paragraphs(docs))).where("confirmed").drop("confirmed")
