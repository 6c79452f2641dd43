"""License scans (operator 7): winnowed fingerprints, then banded alignment.

Templates are token sequences. An inverted index holds, of every template longer than `SHORT` tokens, the
hashed `K`-token grams that winnowing selects (the smallest of every `WINDOW` neighbours). All grams of a text
are looked up, so a text and such a template that share K + WINDOW - 1 tokens in a row share a fingerprint.
Shorter templates may match without any gram in common; of those the index holds single tokens instead, the
rarest ones, one more than a match may lack, so that no match is without one.

Hits are gathered per template and diagonal. A candidate whose surroundings lack too many of the template's tokens can't
match; the others are confirmed by a local alignment of the whole template against the text within a band
of `BAND` tokens around the diagonal. A match reports its matched coverage (aligned equal tokens over
template tokens) and its span in code points, and counts from `MIN_COVERAGE` on; of overlapping matches the
one with more matched tokens stays.

Defined cases: null and empty texts have no matches, an empty table gives no rows; a text gives one row per
match, in order of place; repeated rows give theirs each; of equally long overlapping matches the fuller,
then the first stays; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

K, WINDOW, BAND, MIN_COVERAGE = 3, 3, 8, 0.75
#: Templates of at most so many tokens are indexed by single tokens.
SHORT = 20
#: Tokens too frequent in ordinary text to look for while a template has others.
FREQUENT = frozenset("a an and any are as at be by can copy for form from in is it may not of on or other software source terms that the this to under use version with without work you".split())

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}

_KEEP = np.zeros(256, bool)
_KEEP[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_KEEP[128:] = True


def _tokens(c: common.Chunk):
    """Token hashes (runs of letters and digits, lower-cased), their spans and limits per text."""
    low = common.LOWER[c.data]
    t = common.Chunk(c.lo, c.hi, np.where(_KEEP[low], low, np.uint8(32)), c.offs)
    s, e, lim = common.words(t)
    return common.span_hashes(t.data, s, e), s, e, lim


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions of the selected grams: the rightmost smallest of every WINDOW neighbours."""
    if len(g) <= WINDOW:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(w)) + WINDOW - 1 - w.argmin(1))


class Index:
    def __init__(self, templates: dict[str, list[str]], min_coverage: float = MIN_COVERAGE):
        self.names, self.seqs, self.counts, self.min_coverage = [], [], [], min_coverage
        grams, single = [], []
        for name, texts in templates.items():
            for text in texts:
                c = next(common.chunks(pa.array([text], pa.large_string())))
                h, s, e, _ = _tokens(c)
                t = len(self.seqs)
                self.names.append(name), self.seqs.append(h), self.counts.append(Counter(h.tolist()))
                if len(h) > SHORT:
                    g = common.ngram_hashes(h, K)
                    grams += [(int(g[p]), t, int(p)) for p in winnow(g)]
                else:
                    low = [c.data[a:b].tobytes().decode().lower() for a, b in zip(s, e)]
                    rare = sorted(range(len(h)), key=lambda p: (low[p] in FREQUENT, -len(low[p]), p))
                    single += [(int(h[p]), t, p) for p in rare[: len(h) - self.least(t) + 1]]
        self.grams, self.single = (self._columns(x) for x in (grams, single))

    def least(self, t: int) -> int:
        """Tokens of template t that a match has."""
        return int(np.ceil(self.min_coverage * len(self.seqs[t])))

    @staticmethod
    def _columns(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        rows.sort()
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the grams and of the tokens of h that the index holds."""
        return np.flatnonzero(np.isin(common.ngram_hashes(h, K), self.grams[0])), np.flatnonzero(np.isin(h, self.single[0]))

    def lookup(self, h: np.ndarray):
        """(text position, template, template position) of everything that the index holds."""
        for (keys, template, place), values, at in zip((self.grams, self.single), (common.ngram_hashes(h, K), h), self.hits(h)):
            lo, hi = np.searchsorted(keys, values[at], "left"), np.searchsorted(keys, values[at], "right")
            for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist()):
                for r in range(x, y):
                    yield p, int(template[r]), int(place[r])

    def may_match(self, h: np.ndarray, t: int, shift: int) -> bool:
        """Whether the band around a diagonal holds enough of the template's tokens."""
        near = Counter(h[max(0, shift - BAND) : shift + len(self.seqs[t]) + BAND].tolist())
        return sum(min(n, near[x]) for x, n in self.counts[t].items()) >= self.least(t)


def align(text: np.ndarray, tmpl: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of a template within the band around text position = shift + template position.

    Equal tokens score 2, others and gaps -1; of equal scores the one that ends nearest to the diagonal of `shift`,
    so that adjacent repeats are each found. Returns (matched tokens, start, end) in the text.
    """
    width = 2 * band + 1
    prev = [(0, 0, 0)] * width  # score, matches, start
    best, off = (0, 0, 0, 0), width
    n = len(text)
    for i, tok in enumerate(tmpl.tolist()):
        cur = []
        for d in range(width):
            j = shift + i + d - band
            if not 0 <= j < n:
                cur.append((0, 0, j + 1))
                continue
            p = prev[d]
            same = int(text[j]) == tok
            start = p[2] if p[0] > 0 else j
            c = (p[0] + (2 if same else -1), p[1] + same, start)
            if d + 1 < width and prev[d + 1][0] - 1 > c[0]:
                c = (prev[d + 1][0] - 1, *prev[d + 1][1:])
            if d and cur[d - 1][0] - 1 > c[0]:
                c = (cur[d - 1][0] - 1, *cur[d - 1][1:])
            if c[0] <= 0:
                c = (0, 0, j + 1)
            cur.append(c)
            if c[0] > best[0] or (c[0] == best[0] > 0 and abs(d - band) < off):
                best, off = (c[0], c[1], c[2], j + 1), abs(d - band)
        prev = cur
    return best[1:]


def scan_tokens(h: np.ndarray, index: Index) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first token, end token) of the matches in one text."""
    spots: dict[int, list[int]] = {}
    for t, shift in sorted({(t, pos - place) for pos, t, place in index.lookup(h)}):
        near = spots.setdefault(t, [])
        if not near or shift - near[-1] > BAND // 2:
            near.append(shift)
    found = []
    for t, shifts in spots.items():
        seq = index.seqs[t]
        for shift in shifts:
            if not index.may_match(h, t, shift):
                continue
            n, a, b = align(h, seq, shift)
            if n >= index.least(t):
                found.append((n, t, a, b, n / len(seq)))
    found.sort(key=lambda x: (-x[0], -x[4], x[2], x[1]))
    out: list[tuple[str, float, int, int]] = []
    for _, t, a, b, cov in found:
        if all(b <= x[2] or a >= x[3] for x in out):
            out.append((index.names[t], cov, a, b))
    return sorted(out, key=lambda x: x[2])


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start, stop): one row per match, span in code points of the text."""
    templates = templates or TEMPLATES

    def run(batches):
        index = Index(templates, min_coverage)
        for b in batches:
            for c in common.chunks(b.column(1)):
                h, s, e, lim = _tokens(c)
                hits = np.searchsorted(lim, np.concatenate(index.hits(h)), "right") - 1
                rows = []
                lead = common.cumulative((c.data & 0xC0) != 0x80) if len(hits) else None
                for i in np.unique(hits).tolist():
                    a, z = lim[i], lim[i + 1]
                    for name, cov, x, y in scan_tokens(h[a:z], index):
                        o = lead[c.offs[i]]
                        rows.append((i, name, cov, int(lead[s[a + x]] - o), int(lead[e[a + y - 1]] - o)))
                if rows:
                    r, *cols = zip(*rows)
                    key = b.column(0).slice(c.lo, len(c)).cast(pa.int64()).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([key, *map(pa.array, cols)], ["doc_id", "license", "coverage", "start", "stop"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, license string, coverage double, start bigint, stop bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
