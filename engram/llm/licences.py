"""Licence families of paragraphs, by a trained classifier that templates confirm.

A multinomial logistic regression over word 1-grams and 2-grams tells licence
families, ``unknown`` (a licence notice of no known family) and ``none`` apart.
It is trained on notices made from ``TEMPLATES`` by rule, on made-up notices
for ``unknown``, and on a bounded sample of corpus paragraphs for ``none``. A
temperature fitted on held-out rows calibrates its probabilities; a family that
stays below one half is reported as ``unknown``. A prediction is confirmed when
the paragraph shares enough of a template's word pairs.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import row_key, units

# the sample of corpus paragraphs that are taken for no licence
SAMPLE_DOCS = 2_000
SAMPLE_PARAGRAPHS = 3_000
SURE = 0.5
CONFIRM = 0.6
NONE, UNKNOWN = "none", "unknown"

# fixed values: usual short notices of public licences
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(tokens: list[str]) -> set[str]:
    return {*tokens, *map(" ".join, zip(tokens, tokens[1:], strict=False))}


def made_notices(seed: int = 0, copies: int = 30) -> list[tuple[str, str]]:
    """(family, text): the templates whole, with a lead or a tail, and with words left out; made-up ones for ``unknown``."""
    rng = random.Random(seed)
    leads = ["", "", "Copyright (c) 2019 The authors.", "This file is part of the project.", "Notice:", "All code here is free."]
    tails = ["", "", "See the file for details.", "All rights reserved.", "Without warranty of any kind."]
    out = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            for i in range(copies):
                body = notice.split()
                if i > copies // 2:
                    body = [w for w in body if rng.random() > 0.1] or body
                out.append((family, " ".join([rng.choice(leads), *body, rng.choice(tails)]).strip()))
    forms = ["Licensed under the {} License.", "Released under the {} Terms, version {}.", "This work is licensed under the {} Public License, version {}.", "All rights reserved by {}. No licence is granted.", "Use of this material is subject to the {} licence agreement.", "Licensed under {} {}.0."]
    for _ in range(4 * copies):
        name = " ".join("".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).title() for _ in range(rng.randint(1, 2)))
        out.append((UNKNOWN, " ".join([rng.choice(leads), rng.choice(forms).format(name, rng.randint(1, 4)), rng.choice(tails)]).strip()))
    return out


@dataclass
class Model:
    classes: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float = 1.0

    def __post_init__(self) -> None:
        none = self.classes.index(NONE)
        self._gain = {g: float((w - w[none]).max()) for g, w in self.weights.items()}
        self._base = float(np.delete(self.bias - self.bias[none], none).max())
        self._pairs = {f: [{p for p in grams(words(t)) if " " in p} for t in notices] for f, notices in TEMPLATES.items()}

    def chances(self, found: set[str]) -> np.ndarray:
        logits = self.bias + sum((self.weights[g] for g in sorted(found & self.weights.keys())), np.zeros(len(self.classes)))
        scaled = np.exp((logits - logits.max()) / self.temperature)
        return scaled / scaled.sum()

    def classify(self, text: str) -> tuple[str, float, float] | None:
        """(family, probability, share of the best template's word pairs); None for no licence."""
        found = grams(words(text))
        gain = self._gain
        # an upper bound on every class against ``none``: most paragraphs end here
        if self._base + sum(max(0.0, gain[g]) for g in found if g in gain) <= 0:
            return None
        chance = self.chances(found)
        best = int(chance.argmax())
        family = self.classes[best]
        if family == NONE:
            return None
        if family != UNKNOWN and chance[best] < SURE:
            family = UNKNOWN
        overlap = max((len(pairs & found) / len(pairs) for pairs in self._pairs.get(family, ()) if pairs), default=0.0)
        return family, float(chance[best]), overlap


def _loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = logits / temperature
    z = z - z.max(axis=1, keepdims=True)
    return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())


def train(background: list[str], seed: int = 0, steps: int = 200, shrink: float = 1e-4) -> Model:
    """Fit on the made notices and ``background`` paragraphs; every fifth row only calibrates."""
    rows = [*made_notices(seed), *((NONE, t) for t in background)]
    classes = sorted({family for family, _ in rows} | {NONE})
    bags = [grams(words(t)) for _, t in rows]
    seen = Counter(g for bag in bags for g in bag)
    names = sorted(g for g, n in seen.items() if n >= 3)
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, bag in enumerate(bags):
        x[i, [place[g] for g in bag if g in place]] = 1
    y = np.array([classes.index(family) for family, _ in rows])
    held = np.arange(len(rows)) % 5 == 4
    fit_x, fit_y = x[~held], y[~held]
    target = np.eye(len(classes), dtype=np.float32)[fit_y]
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    rate = 4.0 / max(1.0, float((fit_x**2).sum(axis=1).mean()))
    lead_w, lead_b = w, b
    for step in range(steps):
        z = fit_x @ lead_w + lead_b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - target) / len(fit_y)
        new_w, new_b = lead_w - rate * (fit_x.T @ p + shrink * lead_w), lead_b - rate * p.sum(axis=0)
        push = step / (step + 3)
        lead_w, lead_b, w, b = new_w + push * (new_w - w), new_b + push * (new_b - b), new_w, new_b
    logits = (x[held] @ w + b).astype(np.float64)
    temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: _loss(logits, y[held], t)) if held.any() else 1.0
    return Model(classes, {g: w[i].astype(np.float64) for g, i in place.items()}, b.astype(np.float64), float(temperature))


def fit(docs: DataFrame, rows: int = SAMPLE_DOCS, paragraphs: int = SAMPLE_PARAGRAPHS) -> Model:
    """Train with at most ``paragraphs`` distinct paragraphs of ``rows`` documents, picked by hashes.

    Sampled paragraphs that hold three quarters of a template's word pairs, or
    speak of licences, are not taken for ``none``.
    """
    picked = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids
    some = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").distinct()
    sample = [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(paragraphs).collect()]
    pairs = [{p for p in grams(words(t)) if " " in p} for notices in TEMPLATES.values() for t in notices]

    def notice(text: str) -> bool:
        found = grams(words(text))
        return any("licen" in w or w == "copyright" for w in found) or any(len(p & found) >= 0.75 * len(p) for p in pairs if p)

    return train([t for t in sample if not notice(t)])


def paragraphs(text: str) -> list[tuple[int, list[str]]]:
    """The stretches between blank lines: number of the first line (blank ones do not count) and the lines."""
    out, n, open_ = [], 0, False
    for line in text.split("\n"):
        if not line.strip():
            open_ = False
            continue
        if open_:
            out[-1][1].append(line)
        else:
            out.append((n, [line]))
        n, open_ = n + 1, True
    return out


def wrapped(model: Model, lines: list[str], sure: dict[int, tuple[str, float]]) -> list[tuple[int, int, tuple, str]]:
    """Confirmed notices in the joined ``lines``: first and last line, what ``classify`` says, text.

    For each template that is there, the span of its size that holds most of
    its word pairs is judged. Of families that claim the same words the one
    nearer to its template is taken; ``sure`` has the families and shares of
    the lines confirmed by themselves, which are not found again.
    """
    joined = "\n".join(lines)
    spans = [m.span() for m in _WORD.finditer(joined)]
    tokens = [joined[a:b].lower() for a, b in spans]
    places: dict[str, list[int]] = {}
    for i, (x, y) in enumerate(zip(tokens, tokens[1:], strict=False)):
        places.setdefault(f"{x} {y}", []).append(i)
    claims, families = [], {family for family, _ in sure.values()}
    for family, notices in model._pairs.items():
        for pairs in notices:
            held = pairs & places.keys()
            if family in families or not pairs or len(held) < CONFIRM * len(pairs):
                continue
            # a template's words are about its pairs; some may be added
            width, count, inside, low, best = len(pairs) + len(pairs) // 4 + 1, Counter(), 0, 0, (0, 0, 0)
            marks = sorted((i, p) for p in held for i in places[p])
            for at, p in marks:
                count[p] += 1
                inside += count[p] == 1
                while at - marks[low][0] > width:
                    count[marks[low][1]] -= 1
                    inside -= count[marks[low][1]] == 0
                    low += 1
                best = max(best, (inside, -marks[low][0], at))
            start, end = spans[-best[1]][0], spans[best[2] + 1][1]
            part = joined[start:end]
            found = model.classify(part)
            if found is None or found[0] == UNKNOWN or found[2] < CONFIRM:
                continue
            first, last = joined.count("\n", 0, start), joined.count("\n", 0, end)
            if found[0] not in families and all(sure[i][1] < found[2] for i in range(first, last + 1) if i in sure):
                claims.append((found[2], end - start, -start, first, last, found, part))
    out, taken = [], []
    for _, size, start, first, last, found, part in sorted(claims, key=lambda x: x[:3], reverse=True):
        if all(-start >= high or -start + size <= low for low, high in taken):
            taken.append((-start, -start + size))
            out.append((first, last, found, part))
    return out


_HITS = "array<struct<paragraph: int, family: string, probability: double, overlap: double, confirmed: boolean, text: string>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, key, n_paragraphs, hits per row: the lines that are licence notices, and the notices over several lines.

    Lines that are not blank are counted and judged each for itself; then the
    lines between two blank ones are joined, and a notice that only the joined
    text confirms takes the place of what its lines gave unconfirmed. A hit
    has the number of its (first) line, the family, its probability, the
    share of the best template's word pairs, and whether that confirms the
    family. A null or empty text has no paragraphs; equal rows give equal
    results; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())])
        for unit in units(batches):
            known: dict[str, tuple | None] = {}
            numbers, out = [], []
            for text in unit.column("text").to_pylist():
                blocks = paragraphs(text or "")
                numbers.append(sum(len(lines) for _, lines in blocks))
                hits = []
                for start, lines in blocks:
                    own = []
                    for i, line in enumerate(lines, start):
                        found = known[line] if line in known else known.setdefault(line, model.classify(line))
                        if found:
                            family, p, overlap = found
                            own.append((i, family, round(p, 6), round(overlap, 6), family != UNKNOWN and overlap >= CONFIRM, line))
                    for first, last, (family, p, overlap), part in wrapped(model, lines, {h[0] - start: (h[1], h[3]) for h in own if h[4]}):
                        own = [h for h in own if h[4] or not start + first <= h[0] <= start + last]
                        own.append((start + first, family, round(p, 6), round(overlap, 6), True, part))
                    hits += sorted(own, key=lambda h: h[0])
                out.append([dict(zip([f.name for f in kind], h, strict=True)) for h in hits])
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), unit.column("key"), pa.array(numbers, pa.int32()), pa.array(out, pa.list_(kind))], ["doc_id", "key", "n_paragraphs", "hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    return rows.mapInArrow(run, f"doc_id long, key long, n_paragraphs int, hits {_HITS}")
