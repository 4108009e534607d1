"""Licence paragraphs among prose."""

import random

import pytest

from signalmill.llm import license_scan as L


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    syllables = ["tha", "ing", "ore", "ent", "al", "be", "un", "ver"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(5, 150))) for _ in range(400)]


@pytest.fixture(scope="module")
def model(prose):
    return L.train(prose[:300])


def test_notices_are_found_in_any_place(spark, prose, model):
    rng = random.Random(1)
    texts, want = [], set()
    for i, p in enumerate(prose):
        lines = [p[:400], p[400:] or "end"]
        if i % 4 == 0:
            family = rng.choice(L.FAMILIES)
            notice = rng.choice(L.NOTICES[family])
            at = rng.randint(0, 2)
            lines.insert(at, notice if i % 8 else f"{p} {notice} {p}")
            want.add((i, at, family))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    found = L.scan(docs.repartition(4), model).collect()
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in found}
    # Every notice on a line of its own, and nearly all in the middle of a long one.
    assert {w for w in want if w[0] % 8} <= got and not got - want
    assert len(got & want) / len(want) > 0.95
    assert all(r["probability"] >= L.KNOWN_FROM and r["template_share"] >= L.SHARE_FROM for r in found)


def test_other_talk_of_licences_is_not_a_notice(spark, model):
    texts = ["He lost his fishing license in 2004.", "The MIT press published it.", "A license to print money, version 3."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert L.scan(docs, model).count() == 0


def test_pieces_cover_every_word():
    text = "\n".join([" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 59, 60, 61, 200)])
    pieces = L.of_texts([None, text, "", "a"])
    for line, n in enumerate((0, 1, 59, 60, 61, 200)):
        own = [(a, b) for a, b, t, k in zip(pieces.first, pieces.last, pieces.text, pieces.line) if t == 1 and k == line]
        assert len({w for a, b in own for w in range(a, b)}) == n
        assert all(b - a <= L.PIECE for a, b in own)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "Released under the MIT License."), (5, "Released under the MIT License.\n" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in L.scan(docs, model).collect()), key=repr)
    assert found == sorted([(None, 0, "mit"), (5, 0, "mit"), (5, 1, "mit")], key=repr)
    assert L.scan(docs.limit(0), model).count() == 0
    assert L.unknown_paragraphs(docs.limit(0)) == [] and L.train([]) is not None


WRAPPED = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        'of this software and associated documentation files (the "Software"), to deal',
        "in the Software without restriction, including without limitation the rights",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without",
        "modification, are permitted provided that the following conditions are met:",
    ),
    "gpl-3.0": (
        "it under the terms of the GNU General Public License as published by",
        "the Free Software Foundation, either version 3 of the License, or",
        "(at your option) any later version.",
    ),
}


@pytest.mark.parametrize("mark, end", [("", "\n"), (" * ", "\n"), ("# ", "\r\n")])
def test_wrapped_notices_are_found_on_their_first_line(spark, prose, model, mark, end):
    texts, want = [], set()
    for i, (family, lines) in enumerate(WRAPPED.items()):
        texts.append(end.join(mark + line for line in (prose[i], *lines, prose[i + 9])))
        want.add((i, 1, family))
        texts.append(end.join(mark + line for line in lines))
        want.add((i + 10, 0, family))
    docs = spark.createDataFrame([(i // 2 + i % 2 * 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [(r["doc_id"], r["paragraph"], r["family"]) for r in L.scan(docs, model).collect()]
    assert sorted(found) == sorted(want)


def test_two_families_on_one_line(spark, model):
    texts = [
        "Released under the MIT License. Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.",
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in L.scan(docs, model).collect())
    assert found == [(0, 0, "cc-by-4.0"), (0, 0, "mit"), (1, 0, "cc-by-sa-4.0"), (2, 0, "apache-2.0"), (2, 0, "mit")]


@pytest.mark.parametrize(
    "text, family",
    [
        ("it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
        ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd-4.0"),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
        ("This work is not licensed under a Creative Commons Attribution 4.0 International License.", None),
        ("This work was never licensed under the GNU General Public License, version 3.", None),
    ],
)
def test_the_deciding_words_decide(spark, model, prose, text, family):
    docs = spark.createDataFrame([(1, text), (2, f"{prose[5]}\n{text}\n{prose[6]}")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in L.scan(docs, model).collect())
    assert found == ([(1, 0, family), (2, 1, family)] if family else [])


def brute_families(line):
    """By definition: every range of a line's words against every template, fullest first, sharing no half of its words."""
    own = L.words(line)
    hits = []
    for k, family in enumerate(L.FAMILIES):
        for template in L.TEMPLATES[family]:
            ranges = [
                (L.held(own[a:b], template), a - b, -a, k)
                for a in range(len(own)) for b in range(a + 1, len(own) + 1) if L.held(own[a:b], template) >= L.SHARE_FROM
            ]
            if ranges:
                share, width, start, _ = max(ranges)
                if L.decided(own, -start, -start - width, family):
                    hits.append((share, width, k, {*range(-start, -start - width)}))
    out, taken = set(), set()
    for _, _, k, places in sorted(hits, key=lambda h: (-h[0], -h[1], h[2])):
        if 2 * len(places & taken) < len(places):
            out.add(L.FAMILIES[k])
            taken |= places
    return out


def test_every_template_between_prose_equals_all_ranges(spark, prose, model):
    rng = random.Random(3)
    lines = []
    for family in L.FAMILIES:
        for notice in L.NOTICES[family]:
            own = notice.split()
            if len(own) > 12:
                own[rng.randrange(len(own))] = "zzz"  # one word of a long notice lost
            before, after = (" ".join(rng.choice(prose).split()[: rng.randint(0, 12)]) for _ in range(2))
            lines.append(" ".join([before, *own, after]).strip())
    lines += [p[:200] for p in prose[:40]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {}
    for r in L.scan(docs, model, known_from=0.0).collect():  # what is confirmed, whatever is predicted
        found.setdefault(r["doc_id"], set()).add(r["family"])
    assert {i: found.get(i, set()) for i in range(len(lines))} == {i: brute_families(line) for i, line in enumerate(lines)}


def test_unknown_pieces_come_from_whole_texts(spark):
    texts = ["\n".join(f"line{k} of document{i} " + " ".join(f"w{i}x{k}x{j}" for j in range(60)) for k in range(5)) for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (98, "the license of it")], "doc_id long, text string")
    found = L.unknown_paragraphs(docs, rows=150)
    assert len(found) == 150 and all(len(p.split()) == L.PIECE for p in found)
    assert len({p.split()[0] for p in found}) > 20 and not any("license" in p for p in found)
