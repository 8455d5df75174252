"""License texts found by MinHash over text windows, then checked by containment."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from rosterlake.llm.common import arrow_map, keyed

#: Sentences and paragraphs by which licenses are named or granted, as (license, text).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Words that tell licenses of one wording apart: where a template has them, its place must have them, and no others.
TELLING = frozenset("affero lesser library noncommercial nc sharealike sa noderivatives nd".split())
SHINGLE = 5
CONTAINED_PERCENT = 80
#: One-row bands. A window has two to four times the shingles of its templates, so one that
#: holds 80 percent of a template has a Jaccard similarity to it of 0.8 / 4.2 = 0.19 at
#: least and meets it in one of 64 bands with a probability over 0.999998.
BANDS = 64
_LEAST_WINDOW = 8
#: Shingles looked at in one go; the next go begins a whole window earlier.
_STRETCH = 1 << 14
_M = np.uint64(0x9E3779B97F4A7C15)
#: Letters and digits are kept, lower-cased; other ASCII characters part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def folded_words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def told_by(words: list[bytes]) -> tuple[list[str], set[str]]:
    """The numbers among words, in order, and the words of ``TELLING``."""
    plain = [w.decode("utf-8", "replace") for w in words]
    return [w for w in plain if any("0" <= c <= "9" for c in w)], {w for w in plain if w in TELLING}


def shingles(text: str) -> np.ndarray:
    """64-bit hash of each five-word shingle, in order; fewer words have none."""
    return _hashes(folded_words(text))


def _hashes(words: list[bytes]) -> np.ndarray:
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    out = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        out = _mix(out * _M + w[j : len(w) - SHINGLE + 1 + j])
    return out


class LicenseIndex:
    """Templates by the size of window that is compared with them."""

    def __init__(self, templates=TEMPLATES):
        self.sets = [np.unique(shingles(text)) for _, text in templates]
        short = [text for (_, text), s in zip(templates, self.sets, strict=True) if not len(s)]
        if short:
            raise ValueError(f"templates need five words: {short}")
        self.words = [folded_words(text) for _, text in templates]
        self.told = [told_by(w) for w in self.words]
        self.seeds = _mix(np.arange(1, BANDS + 1).astype(np.uint64) * _M)
        self.by_window: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            window = _LEAST_WINDOW
            while window < 2 * len(s):
                window *= 2
            self.by_window.setdefault(window, []).append(t)
        self.mins = [_mix(s[:, None] ^ self.seeds).min(axis=0) for s in self.sets]
        self.largest = max(self.by_window)

    def _met(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first, end) of the windows that share a band with it."""
        hashed = _mix(h[:, None] ^ self.seeds)
        step = _LEAST_WINDOW // 4
        blocks, width = np.minimum.reduceat(hashed, np.arange(0, len(h), step), axis=0), step
        for window in sorted(self.by_window) if len(h) else ():
            while width < window // 4:
                blocks = np.minimum.reduceat(blocks, np.arange(0, len(blocks), 2), axis=0)
                width *= 2
            # A window is four blocks; the last ones are shorter.
            mins = blocks.copy()
            for shift in (1, 2, 3):
                mins[:-shift] = np.minimum(mins[:-shift], blocks[shift:])
            for t in self.by_window[window]:
                for i in np.flatnonzero((mins == self.mins[t]).any(axis=1)).tolist():
                    yield t, i * width, min(len(h), i * width + window)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, percent of its shingles) of each place, in order.

        Windows that meet a template are checked with a quarter window on both
        sides. Places of one template that overlap are one. Of templates at one place, overlapping by half
        of the shorter, the one with the highest share stays, then the longest.
        """
        words = folded_words(text)
        h, spans = _hashes(words), set()
        for lo in range(0, max(1, len(h)), _STRETCH):
            part = h[lo : lo + _STRETCH + self.largest]
            for t, a, b in self._met(part):
                a, b = max(0, lo + a - (b - a) // 4), min(len(h), lo + b + (b - a) // 4)
                own = np.flatnonzero(np.isin(h[a:b], self.sets[t]))
                held = len(np.unique(h[a:b][own]))
                if 100 * held >= CONTAINED_PERCENT * len(self.sets[t]):
                    spans.add((t, a + int(own[0]), a + int(own[-1]) + SHINGLE, 100 * held // len(self.sets[t])))
        out: list[tuple[int, int, int, int]] = []
        for t, a, b, share in sorted(spans):
            if out and out[-1][0] == t and a < out[-1][2]:
                out[-1] = (t, out[-1][1], max(b, out[-1][2]), max(share, out[-1][3]))
            else:
                out.append((t, a, b, share))
        return self._best([x for x in out if self._told(words, x)])

    def _told(self, words: list[bytes], place: tuple[int, int, int, int]) -> bool:
        """Whether the numbers of the template stand at the place in their order, and of the telling words just those of the template.

        A place of 80 percent may stop short of the first or last words, so as many words are
        looked at on both sides as the template may lack.
        """
        t, a, b, _ = place
        numbers, telling = self.told[t]
        lack = max(0, len(self.words[t]) - (b - a)) + 1
        near = iter(told_by(words[max(0, a - lack) : b + lack])[0])
        return all(n in near for n in numbers) and told_by(words[a:b])[1] <= telling <= told_by(words[max(0, a - lack) : b + lack])[1]

    def _best(self, places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(places, key=lambda x: (-x[3], -len(self.sets[x[0]]), x[0])):
            if not any(2 * (min(x[2], y[2]) - max(x[1], y[1])) >= min(x[2] - x[1], y[2] - y[1]) for y in kept):
                kept.append(x)
        return sorted(kept)


#: A line that names a license by its identifier.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)")


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(license, first word, end word) of each SPDX identifier, words counted as in ``folded_words``."""
    out, at, words = [], 0, 0
    for m in _SPDX.finditer(text):
        words += len(folded_words(text[at : m.start()]))
        n = len(folded_words(m[0]))
        out.append((m[1].rstrip(".-"), words, words + n))
        at, words = m.end(), words + n
    return out


@functools.lru_cache(maxsize=2)
def license_index(templates=TEMPLATES) -> LicenseIndex:
    return LicenseIndex(templates)


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, license, template, first_word, end_word, percent of every place that holds a template.

    Words are letters and digits, ASCII lower-cased. A place holds a template if it
    has 80 percent of its distinct five-word shingles, its numbers and just its ``TELLING`` words;
    of several templates at one place the one with the highest share counts. SPDX identifiers
    are places too, with a null template. Null and empty texts, and
    those of fewer than five words, have no place and so no row; null ids keep their
    rows; repeated rows repeat; an empty table gives no rows. Row-local, no shuffle.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        index, rows = license_index(templates), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            plain = text.as_py()
            rows += [(doc, templates[t][0], t, a, b, share) for t, a, b, share in index.find(plain)]
            rows += [(doc, name, None, a, b, 100) for name, a, b in identifiers(plain)] if "SPDX" in plain else []
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        names = ("doc_id", "license", "template", "first_word", "end_word", "percent")
        yield {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}

    return arrow_map(
        keyed(docs, id_col, text_col), step,
        "doc_id bigint, license string, template int, first_word bigint, end_word bigint, percent int",
    )
