import pytest

from rosterlake.llm import licenses
from tests.llm.common import ODD, docs, prose


def brute(text):
    """Every template of which some stretch of one and a half times its length holds 80 percent, the best of those that meet."""
    h, words = licenses.shingles(text or "").tolist(), licenses.folded_words(text or "")
    found = []
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        mine = set(licenses.shingles(template).tolist())
        n, size = len(mine) * 3 // 2, len(licenses.folded_words(template))
        numbers = [w for w in licenses.folded_words(template) if any(48 <= c < 58 for c in w)]
        hits = [i for i in range(len(h)) if h[i] in mine and 100 * len(mine & set(h[i : i + n])) >= 80 * len(mine)]
        for i in hits[:1]:
            last = max(j for j in range(i, min(i + n, len(h))) if h[j] in mine)
            near = words[max(0, i - size // 4) : last + 5 + size // 4]
            if all(x in near for x in numbers):
                found.append((100 * len(mine & set(h[i : i + n])) // len(mine), len(mine), -t, i, last + 5))
    kept = []
    for x in sorted(found, reverse=True):
        if not any(2 * (min(x[4], y[4]) - max(x[3], y[3])) >= min(x[4] - x[3], y[4] - y[3]) for y in kept):
            kept.append(x)
    return {-x[2] for x in kept}


VERSIONS = [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 4.", []),
    ("This work is licensed under the GNU General Public License.", []),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["LGPL-3.0"]),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
    ("# SPDX-License-Identifier: BSD-2-Clause\nSPDX-License-Identifier: GPL-2.0+.", ["BSD-2-Clause", "GPL-2.0+"]),
]


@pytest.mark.parametrize("lead", ["", "some words before it stand here and there "])
def test_versions_and_identifiers(spark, lead):
    rows = [(i, lead + text + " More words follow it.") for i, (text, _) in enumerate(VERSIONS)]
    found = {}
    for r in licenses.license_places(docs(spark, rows)).orderBy("doc_id", "first_word").collect():
        found.setdefault(r.doc_id, []).append(r.license)
    assert [found.get(i, []) for i in range(len(VERSIONS))] == [want for _, want in VERSIONS]


def test_places_equal_brute_force(spark):
    rows = list(ODD)
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        near = " ".join(words[: len(words) * 9 // 10])
        rows += [
            (100 + t, text), (200 + t, prose(t, 50 + t) + " " + text.upper() + "\n" + prose(t + 50, 200)),
            (300 + t, prose(t, 301) + " " + near + " " + prose(t, 7)), (400 + t, prose(t, 40) + " " + " ".join(words[: len(words) // 2])),
            (500 + t, prose(t, 17000) + text + " " + prose(t, 9) + " (" + text + ")"),
        ]
    got = licenses.license_places(docs(spark, rows)).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.template)
        assert r.percent >= 80 and r.license == licenses.TEMPLATES[r.template][0]
    for i, text in rows:
        assert found.get(i, set()) == brute(text), (i, found.get(i))
    assert licenses.TEMPLATES[2][0] == "Apache-2.0" and sum(r.doc_id == 502 and r.template == 2 for r in got) == 2
    assert licenses.license_places(docs(spark, [])).count() == 0


def test_places_span_their_words():
    text = prose(1, 33) + " " + licenses.TEMPLATES[5][1]
    ((t, first, end, share),) = licenses.license_index().find(text)
    assert (t, first, share) == (5, 33, 100)
    assert end == 33 + len(licenses.folded_words(licenses.TEMPLATES[5][1]))
    assert licenses.identifiers("a b c\nSPDX-License-Identifier: MIT x") == [("MIT", 3, 7)]
