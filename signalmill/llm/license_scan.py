"""Licence notices: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are classified by multinomial logistic regression on hashed words and word pairs: every line, and
every run of lines with words as one, for notices are mostly wrapped; long ones in overlapping pieces. It is trained on the notices below, each in many worn copies (words lost,
replaced or framed by corpus text), against paragraphs of the corpus as the unknown class. Families whose
calibrated probability reaches a threshold are predicted; those are confirmed of one of whose templates the
paragraph holds enough words and word pairs, unless most of these belong to a better match. A notice belongs to the line that it begins on.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a version number is several
words. Null, empty and wordless texts have no paragraph. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.common import SpanHash, blocks, least_hashes, mix, narrow, runs_of, spans, text_bytes
from signalmill.llm.linear import fit, platt

# Notices by family, as their licences or common practice word them.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc-nd-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "cc-by-nc-sa-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc-by-nd-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
}
# Words that decide between families whose notices are much alike. Of each group a notice has one at least;
# it has none of the words that name another family.
_NC, _ND, _SA = ("nc", "noncommercial"), ("nd", "noderivatives", "noderivs"), ("sa", "sharealike")
_GNU = ("affero", "agpl"), ("lesser", "lgpl", "library")
DECIDING = {
    "apache-2.0": ((("apache",), ("2",)), ()),
    "mit": ((("mit", "permission"),), ()),
    "gpl-3.0": ((("general", "gpl"), ("3",)), (*_GNU[0], *_GNU[1])),
    "gpl-2.0": ((("general", "gpl"), ("2",)), (*_GNU[0], *_GNU[1])),
    "agpl-3.0": ((_GNU[0],), _GNU[1]),
    "lgpl": ((_GNU[1],), _GNU[0]),
    "isc": ((("isc", "permission"),), ()),
    "bsd": ((("bsd", "redistribution"),), ()),
    "mpl-2.0": ((("mozilla", "mpl"), ("2",)), ()),
    "cc-by-nc-nd-4.0": ((("by", "attribution"), _NC, _ND, ("4",)), _SA),
    "cc-by-nc-sa-4.0": ((("by", "attribution"), _NC, _SA, ("4",)), _ND),
    "cc-by-nd-4.0": ((("by", "attribution"), _ND, ("4",)), (*_NC, *_SA)),
    "cc-by-nc-4.0": ((("by", "attribution"), _NC, ("4",)), (*_ND, *_SA)),
    "cc-by-sa-4.0": ((("by", "attribution"), _SA, ("4",)), (*_NC, *_ND)),
    "cc-by-4.0": ((("by", "attribution"), ("4",)), (*_NC, *_ND, *_SA)),
    "cc0-1.0": ((("waived",),), ()),
}
#: Words that deny a notice within it or just before it, how far before, and how far behind a notice a deciding word may stand.
DENYING, BEFORE, BEHIND = (b"not", b"never", b"neither", b"nor", b"isn", b"wasn", b"aren"), 2, 2
#: Sentences about licences that name none of the families.
NO_FAMILY = (
    "This work is licensed under terms that the author will send on request.",
    "All rights reserved; see the license of the vendor for the conditions of use.",
    "The software is released under a proprietary license, version 4.",
    "A driving license is needed to rent a car in this country.",
    "This work is licensed under a license that is not open.",
    "The terms of the public license of the city apply to market stalls.",
)
FAMILIES = tuple(NOTICES)

#: Hash buckets; words of a piece, how far pieces overlap, and words around a piece that are compared too.
BUCKETS, PIECE, OVERLAP, AROUND = 1 << 15, 20, 10, 40
#: Worn copies of each notice; corpus paragraphs of the unknown class, at most; least probability and template share.
COPIES, UNKNOWN_ROWS, KNOWN_FROM, SHARE_FROM = 40, 3000, 0.05, 0.8
#: Words that a range of a template's words may grow over, where that gains more of it.
GAP = 2

_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 128:
        _CLASS[_c] = _c + 32 if 65 <= _c <= 90 else _c


def words(text: str) -> list[bytes]:
    return _CLASS[np.frombuffer(text.encode(), np.uint8)].tobytes().replace(b"\0", b" ").split()


class Pieces:
    """Paragraph pieces of a block of texts, as ranges of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low, self.n = _CLASS[data], len(offsets) - 1
        self.start, self.end = spans(self.low > 0, offsets[1:-1])
        self.words = SpanHash(self.low).of(self.start, self.end)
        ends = np.flatnonzero(data == 10)
        line_start = np.sort(np.concatenate([offsets[:-1], ends + 1]))
        first = np.searchsorted(self.start, line_start)
        last = np.append(first[1:], len(self.start))
        text = np.repeat(np.arange(self.n), 1 + np.diff(np.searchsorted(ends, offsets)))
        number = np.arange(len(first)) - np.searchsorted(text, text)
        filled = last > first
        first, last, text, number = first[filled], last[filled], text[filled], number[filled]
        self.lines = first, last, text, number
        self._cut(first, last, text, number)

    def _cut(self, first: np.ndarray, last: np.ndarray, text: np.ndarray, number: np.ndarray) -> None:
        pieces = np.maximum(1, -(-(last - first - OVERLAP) // (PIECE - OVERLAP)))
        at = np.repeat(np.arange(len(first)), pieces)
        step = (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (PIECE - OVERLAP)
        self.first, self.last = first[at] + step, np.minimum(first[at] + step + PIECE, last[at])
        self.text, self.line = text[at], number[at]
        self.line_first, self.line_last = first[at], last[at]

    def across(self) -> Pieces:
        """Pieces over line ends: those of every run of two or more lines with words, as if it were one line."""
        first, last, text, number = self.lines
        out = copy(self)
        new = np.ones(len(first), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(number) != 1)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(first))
        start, end = start[end - start > 1], end[end - start > 1]
        out._cut(first[start], last[end - 1], text[start], number[start])
        return out

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word, and of each word with its follower."""
        mask = np.uint64(BUCKETS - 1)
        return (mix(self.words) & mask).astype(np.int64), (runs_of(self.words, 2) & mask).astype(np.int64)

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """For each piece the mean weight of its words plus that of its pairs."""
        one, two = self.buckets()
        total = np.zeros((len(self.first), weights.shape[1]), np.float32)
        for values, shift, cut in ((one, 0, 0), (two, BUCKETS, 1)):
            n = self.last - self.first - cut
            for c in range(weights.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(weights[shift + values, c])])
                end = np.maximum(self.last - cut, self.first)
                total[:, c] += (sums[end] - sums[self.first]) / np.maximum(n, 1)
        return total

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        one, two = self.buckets()
        out = []
        for a, b in zip(self.first, self.last):
            place, share = [], []
            for values, shift in ((one[a:b], 0), (two[a : b - 1], BUCKETS)):
                p, n = np.unique(values, return_counts=True)
                if len(p):
                    place.append(p + shift)
                    share.append(n / len(values))
            out.append((np.concatenate(place), np.concatenate(share)))
        return out

    def spelt(self, i: int) -> tuple[int, list[bytes]]:
        """A piece's words with those around it in its paragraph, and the first one's place: a template may be longer than a piece."""
        own = slice(max(self.first[i] - AROUND, self.line_first[i]), min(self.last[i] + AROUND, self.line_last[i]))
        return int(own.start), [self.low[a:b].tobytes() for a, b in zip(self.start[own], self.end[own])]

    def line_of(self, word: int) -> tuple[int, int]:
        """Text and line number of a word."""
        first, _, text, number = self.lines
        at = np.searchsorted(first, word, "right") - 1
        return int(text[at]), int(number[at])


def of_texts(texts: list[str | None]) -> Pieces:
    return Pieces(*text_bytes(pa.array(texts, pa.large_string())))


def bag(own: list[bytes]) -> Counter:
    return Counter(own) + Counter(zip(own, own[1:]))


TEMPLATES = {family: [bag(words(n)) for n in notices] for family, notices in NOTICES.items()}


def held(own: list[bytes], template: Counter) -> float:
    """The share of a template's words and word pairs that a paragraph holds."""
    return (bag(own) & template).total() / template.total()


def tightest(own: list[bytes], template: Counter, share_from: float) -> tuple[int, int] | None:
    """The shortest range of words that holds enough of a template, and those beside it that hold more."""
    count, n, a, best = Counter(), 0, 0, None

    def put(key, by: int) -> int:
        before, count[key] = count[key], count[key] + by
        return min(count[key], template[key]) - min(before, template[key])

    for b in range(len(own)):
        n += put(own[b], 1) + (put((own[b - 1], own[b]), 1) if b > a else 0)
        while a <= b and n / template.total() >= share_from:
            if best is None or b + 1 - a < best[1] - best[0]:
                best = a, b + 1
            n += put(own[a], -1) + (put((own[a], own[a + 1]), -1) if a < b else 0)
            a += 1
    if best is None:
        return None
    a, b = best
    share, grown = held(own[a:b], template), True
    while grown:
        grown = False
        for to in [(a - k, b) for k in range(1, GAP + 2)] + [(a, b + k) for k in range(1, GAP + 2)]:
            if to[0] >= 0 and to[1] <= len(own) and held(own[to[0] : to[1]], template) > share:
                (a, b), grown = to, True
                share = held(own[a:b], template)
                break
    return a, b


def decided(own: list[bytes], a: int, b: int, family: str) -> bool:
    """Whether a range of words has what decides for the family, nothing that names another, and is not denied.

    A deciding word may stand just behind the range, as a version number does.
    """
    groups, others = DECIDING[family]
    inside, behind = set(own[a:b]), set(own[a : b + BEHIND])
    if any(w.encode() in inside for w in others) or not all(any(w.encode() in behind for w in group) for group in groups):
        return False
    return not any(w in inside or w in own[max(0, a - BEFORE) : a] for w in DENYING)


def places(own: list[bytes], family: str, share_from: float) -> Iterator[tuple[float, int, int]]:
    """Every range of words that holds enough of a template of the family, with the share; those of a template lie apart."""
    there = set(own)
    if not all(any(w.encode() in there for w in group) for group in DECIDING[family][0]):
        return
    for template in TEMPLATES[family]:
        parts = [(0, len(own))]
        while parts:
            start, end = parts.pop()
            if held(own[start:end], template) < share_from:
                continue
            a, b = tightest(own[start:end], template, share_from)
            if decided(own, start + a, start + b, family):
                yield held(own[start + a : start + b], template), start + a, start + b
            parts += [(start, start + a), (start + b, end)]


@dataclass
class Notice:
    """A range of words that is a notice of a family; ``across`` if it was looked for over line ends."""

    family: int
    across: bool
    share: float
    chance: float
    first: int
    last: int


def merged(found: list[Notice]) -> list[Notice]:
    """One of those that share words and a family: one of a single line if there is any, else the fullest."""
    out: list[Notice] = []
    owner: dict[tuple[int, int], Notice] = {}
    for notice in sorted(found, key=lambda n: (n.across, -n.share, -n.chance, n.family, n.first, n.last)):
        words_of = [(notice.family, w) for w in range(notice.first, notice.last)]
        known = [owner[w] for w in words_of if w in owner]
        for one in known:
            one.share, one.chance = max((one.share, one.chance), (notice.share, notice.chance))
        if not known:
            out.append(notice)
            owner.update(dict.fromkeys(words_of, notice))
    return out


def apart(found: list[Notice]) -> list[Notice]:
    """Without those that have half their words or more in fuller ones of other families, as CC BY has in CC BY-SA."""
    out: list[Notice] = []
    taken: set[int] = set()
    for notice in sorted(found, key=lambda n: (-n.share, n.last - n.first, -n.chance, n.family, n.first)):
        own = set(range(notice.first, notice.last))
        if 2 * len(own & taken) < len(own):
            out.append(notice)
            taken |= own
    return out


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # buckets by families and, last, the unknown class
    bias: np.ndarray
    slope: float
    shift: float

    def of(self, pieces: Pieces) -> np.ndarray:
        """Calibrated probability of each family against the unknown class, for every piece."""
        z = pieces.linear(self.weights) + self.bias
        margin = z[:, :-1] - z[:, -1:]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def worn(notice: str, frame: np.ndarray, rng: np.random.Generator) -> str:
    """A piece of a copy of a notice with some words lost or replaced, often between words of the corpus."""
    own = notice.split()
    for _ in range(int(rng.integers(0, 1 + len(own) // 8))):
        at = int(rng.integers(len(own)))
        own[at] = frame[int(rng.integers(len(frame)))] if rng.random() < 0.5 else ""
    own = [w for w in own if w]
    before, after = (int(rng.integers(0, PIECE)) if rng.random() < 0.6 else 0 for _ in range(2))
    pick = lambda n: frame[rng.integers(len(frame), size=n)].tolist()
    whole = [*pick(before), *own, *pick(after)]
    # A piece has half its words, or half the notice, from the notice at least.
    most = max(0, min(len(whole) - PIECE, before + len(own) - min(len(own), PIECE) // 2 - 1))
    at = int(rng.integers(max(0, min(most, before + min(len(own), PIECE) // 2 - PIECE)), most + 1))
    return " ".join(whole[at : at + PIECE])


def train(unknown: list[str], seed: int = 11) -> Classifier:
    """Fitted on worn notices against ``unknown`` paragraphs; every fourth row is kept for the calibration."""
    rng = np.random.default_rng(seed)
    frame = np.array(sorted({w for p in unknown for w in p.split()}) or ["the", "of", "a"], object)
    paragraphs, code = [], []
    for i, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            paragraphs += [notice, *(worn(notice, frame, rng) for _ in range(COPIES))]
            code += [i] * (COPIES + 1)
    for sentence in NO_FAMILY:
        paragraphs += [sentence, *(worn(sentence, frame, rng) for _ in range(COPIES))]
        code += [len(FAMILIES)] * (COPIES + 1)
    for paragraph in unknown or frame.tolist():
        paragraphs.append(" ".join(paragraph.split()[:PIECE]))
        code.append(len(FAMILIES))
    pieces = of_texts([p.replace("\n", " ") for p in paragraphs])
    single = np.unique(pieces.text, return_index=True)[1]  # the first piece of each
    rows, y = pieces.features(), np.array(code)[pieces.text]
    held = np.arange(len(single)) % 4 == 3
    weights, bias = fit([rows[i] for i in single[~held]], y[single[~held]], 2 * BUCKETS, rounds=80)
    model = Classifier(weights.astype(np.float32), bias, 1.0, 0.0)
    z = pieces.linear(model.weights) + bias
    margin = z[:, :-1].max(axis=1) - z[:, -1]
    known = (y < len(FAMILIES)).astype(int)
    slope, shift = platt(margin[single[held]].astype(float), known[single[held]])
    return Classifier(model.weights, bias, slope, shift)


def unknown_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = UNKNOWN_ROWS) -> list[str]:
    """Pieces of at most PIECE words of a bounded choice of texts (low hashes of their keys) that do not mention licences.

    From every paragraph of the texts chosen a piece at a hashed place is drawn; the ``rows`` pieces of least hash are taken.
    """
    some = least_hashes(narrow(docs, key, text), [key], rows, docs.count())
    lines = some.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("p")).where(
        ~F.lower("p").rlike("licen[sc]|copyright|permi(t|ssion)|spdx")
    )
    split = lines.select(F.filter(F.split("p", "\\s+"), lambda w: F.length(w) > 0).alias("w")).where(F.size("w") > 0)
    places_of = F.greatest(F.lit(1), F.size("w") - PIECE + 1)
    start = (F.pmod(F.xxhash64("w"), places_of) + 1).cast("int")
    drawn = split.select(F.array_join(F.slice("w", start, F.lit(PIECE)), " ").alias("p"))
    # A word may be of any length, but what is learnt is its hash.
    chosen = drawn.where(F.length("p") <= PIECE * 100).distinct().orderBy(F.xxhash64("p"), "p").limit(rows)
    return sorted(r[0] for r in chosen.collect())


def confirmed(pieces: Pieces, model: Classifier, across: bool, known_from: float, share_from: float) -> list[Notice]:
    """Notices in the pieces that the model predicts a family for."""
    chance, out = model.of(pieces), []
    for i in np.flatnonzero((chance >= known_from).any(axis=1)).tolist():
        at, words_of = pieces.spelt(i)
        for k in np.flatnonzero(chance[i] >= known_from).tolist():
            found = float(chance[i, k])
            out += [Notice(k, across, s, found, at + a, at + b) for s, a, b in places(words_of, FAMILIES[k], share_from)]
    return out


def scan(
    docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text",
    known_from: float = KNOWN_FROM, share_from: float = SHARE_FROM,
) -> DataFrame:
    """One row per line that a licence notice begins on and family: key, ``paragraph`` (line number), ``family``, ``probability``, ``template_share``."""
    docs = narrow(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS by families
    schema = T.StructType(
        [docs.schema[key], T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()),
         T.StructField("probability", T.DoubleType()), T.StructField("template_share", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = batch.column(1)
            for start, end in blocks(column.to_pylist()):
                pieces = Pieces(*text_bytes(column.slice(start, end - start)))
                if not len(pieces.first):
                    continue
                found = confirmed(pieces, own, False, known_from, share_from)
                found += confirmed(pieces.across(), own, True, known_from, share_from)
                best: dict[tuple[int, int, str], tuple[float, float]] = {}
                for notice in apart(merged(found)):
                    place = (*pieces.line_of(notice.first), FAMILIES[notice.family])
                    best[place] = max(best.get(place, (0.0, 0.0)), (notice.share, notice.chance))
                if best:
                    found = sorted((*place, chance, share) for place, (share, chance) in best.items())
                    rows, *rest = zip(*found)
                    keys = batch.column(0).slice(start, end - start).take(pa.array(rows))
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(rest, kinds))], names=schema.names)

    return docs.mapInArrow(run, schema)
