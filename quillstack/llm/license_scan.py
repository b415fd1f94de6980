"""License texts in documents, by patience alignment.

A template is a list of words.  A find is a stretch of a document, from a word of the template on and
``spread`` times as long as the template at most, that aligned with the template covers enough of it:
words that are unique in both are anchors, the longest increasing subsequence of anchors stays,
and the gaps between its anchors are aligned the same way; a gap without anchors matches what
it has in common at its front and its end.  Coverage is the share of the template's words matched.
Marks of comments and lines (``//``, ``*``, ``#``, ``dnl``, ``rem``) are no words.
Besides, the words that tell a licence from its neighbours (its name and version) must be among
the matched ones, those of one phrase next to each other: "GNU Lesser General Public License"
isn't the GNU General Public License.

Stretches are aligned only where as many of the template's words as the coverage asks for lie
within one, each word counted as often as the template has it; others cannot reach it, so the test
loses no find.  A find inside one of a longer template
(the two-clause BSD licence in the three-clause one) is dropped.

Edge cases: null and empty texts, and texts of other words, have no match; a license may occur
several times in a document and each time is counted; overlapping finds of one template count
once, with the best coverage; repeated rows give equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import slices

COVERAGE, SPREAD = 0.8, 2.0
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: Public notices, as their publishers word them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": _BSD[0] + _BSD[2],
    "BSD-3-Clause": _BSD[0] + _BSD[1] + _BSD[2],
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Phrases without which a text is under another licence; the text of MIT doesn't name it.
NAMES = {
    "MIT notice": ("mit license",),
    "Apache-2.0 notice": ("apache license", "2.0"),
    "GPL-3.0 notice": ("gnu general public license", "3"),
    "CC-BY-NC-4.0 notice": ("cc by-nc 4.0",),
    "CC-BY-SA-4.0 notice": ("cc by-sa 4.0",),
    "CC-BY-ND-4.0 notice": ("cc by-nd 4.0",),
    "LGPL-3.0 notice": ("gnu lesser general public license", "3"),
    "AGPL-3.0 notice": ("gnu affero general public license", "3"),
    "CC-BY-4.0 notice": ("creative commons attribution 4.0",),
    "BSD notice": ("bsd-style",),
    "MPL-2.0": ("mozilla public license", "2.0"),
    "Apache-2.0": ("apache license", "2.0"),
    "BSD-3-Clause": ("neither the name of",),
    "EPL-2.0": ("eclipse public license 2.0",),
    "LGPL-2.1": ("gnu lesser general public license", "2.1"),
    "AGPL-3.0": ("gnu affero general public license", "3"),
    "GPL-3.0": ("gnu general public license", "3"),
}
#: Other spellings of words in NAMES.
SAME = {"3.0": "3", "v3": "3", "v3.0": "3", "2": "2.0", "v2": "2.0", "v2.0": "2.0", "4": "4.0", "v4": "4.0", "v4.0": "4.0", "bsd": "bsd-style", "licence": "license"}
_EDGES = ".,;:!?()[]{}<>\"'*#$%&|/-=~"
_COMMENT = ("", "dnl", "rem")


def template_words(text: str) -> list[str]:
    return [SAME.get(w, w) for w in (x.strip(_EDGES) for x in text.lower().split()) if w not in _COMMENT]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first number, with rising second numbers."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Matched positions (in text, in template), rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        of_text, of_template = Counter(text[a:b]), Counter(template[c:d])
        places = {template[j]: j for j in range(c, d) if of_template[template[j]] == 1}
        anchors = _rising([(i, places[text[i]]) for i in range(a, b) if of_text[text[i]] == 1 and text[i] in places])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            work.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, spread: float = SPREAD):
        self.coverage, self.spread = coverage, spread
        self.templates = {k: template_words(t) for k, t in templates.items()}
        self.number = {w: i for i, w in enumerate(sorted({w for t in self.templates.values() for w in t}))}
        self.coded = {k: [self.number[w] for w in t] for k, t in self.templates.items()}
        self.names = {k: [found for name in NAMES.get(k, ()) if (found := self._places(t, name.split()))] for k, t in self.templates.items()}

    @staticmethod
    def _places(template: list[str], phrase: list[str]) -> list[range]:
        """Where a template holds a phrase."""
        return [range(i, i + len(phrase)) for i in range(len(template)) if template[i : i + len(phrase)] == phrase]

    def _named(self, name: str, match: list[tuple[int, int]]) -> bool:
        """Each phrase of a licence's name is matched in one piece."""
        at = {j: i for i, j in match}
        return all(any(all(j in at and at[j] - at[r[0]] == j - r[0] for j in r) for r in places if r[0] in at) for places in self.names[name])

    def scan(self, texts: pa.Array) -> list[tuple[int, str, int, int, float]]:
        """(text, template, first word, last word + 1, coverage) of each find."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _EDGES).to_pylist()
        which = coded.indices.to_numpy(zero_copy_only=False)
        real = np.array([w not in _COMMENT for w in plain], bool)[which] if len(plain) else np.zeros(0, bool)
        place = np.flatnonzero(real)
        code = np.array([self.number.get(SAME.get(w, w), -1) for w in plain], np.int64)[which[place]] if len(plain) else np.zeros(0, np.int64)
        words, bounds = bounds, np.concatenate(([0], np.cumsum(real)))[bounds]
        hits = np.flatnonzero(code >= 0)
        out = []
        for name, template in self.coded.items():
            times = np.bincount(template, minlength=len(self.number) + 1)
            at = hits[times[code[hits]] > 0]
            need, size = max(1, int(np.ceil(self.coverage * len(template) - 1e-9))), self._stretch(template)
            if len(at) < need:
                continue
            # how many of the template's words a stretch from each place can match: a word counts as often as
            # the template has it, so an occurrence counts from behind the one so many before it
            order = np.lexsort((at, code[at]))
            p, word = at[order], code[at][order]
            rank = np.arange(len(p)) - np.searchsorted(word, word)
            before = np.where(rank >= times[word], p[np.maximum(np.arange(len(p)) - times[word], 0)], -1)
            own = np.searchsorted(bounds, p, side="right") - 1
            low = np.maximum(np.maximum(before + 1, p - size + 1), bounds[own])
            change = np.bincount(low, minlength=len(code) + 1) - np.bincount(p + 1, minlength=len(code) + 1)
            starts = at[np.cumsum(change)[at] >= need]
            doc = np.searchsorted(bounds, starts, side="right") - 1
            for k in np.unique(doc).tolist():
                out += self._within(code, starts[doc == k].tolist(), int(bounds[k + 1]), k, name, template)
        finds = [(k, name, int(place[a] - words[k]), int(place[b - 1] - words[k]) + 1, share) for k, name, a, b, share in self._outermost(out)]
        return finds

    def _stretch(self, template: list[int]) -> int:
        return max(len(template), int(self.spread * len(template)))

    def _outermost(self, finds: list[tuple[int, str, int, int, float]]) -> list[tuple[int, str, int, int, float]]:
        """Finds that don't lie inside one with more matched words."""
        of_doc: dict[int, list] = {}
        for f in finds:
            of_doc.setdefault(f[0], []).append((f, f[4] * len(self.coded[f[1]])))
        inside = lambda f, g: g[2] <= f[2] and f[3] <= g[3]
        return [f for own in of_doc.values() for f, n in own if not any(m > n and inside(f, g) for g, m in own)]

    def _within(self, code: np.ndarray, starts: list[int], stop: int, k: int, name: str, template: list[int]) -> list[tuple[int, str, int, int, float]]:
        """Finds of one text: a stretch from each start, the best first, none overlapping."""
        size = len(template)
        tried, found = set(), []
        for start in starts:
            match = patience(code[start : min(start + self._stretch(template), stop)].tolist(), template)
            if len(match) >= self.coverage * size - 1e-9 and self._named(name, match):
                a, b = start + match[0][0], start + match[-1][0] + 1
                if (a, b) not in tried:
                    tried.add((a, b))
                    found.append((len(match) / size, b - a, a, b))
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        taken: list[tuple[int, int]] = []
        out = []
        for share, _, a, b in found:
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                out.append((k, name, a, b, share))
        return out


def license_finds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """One row per find: doc_id, license, first_word, last_word (exclusive), coverage."""
    return _scanned(docs, id_col, text_col, templates, coverage, spread).select("doc_id", F.explode("finds").alias("f")).select("doc_id", "f.*")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """One row per document: doc_id, n_finds, licenses (sorted names), coverage (the best, 0 without a find)."""
    finds = F.col("finds")
    names = F.array_sort(F.array_distinct(F.transform(finds, lambda x: x["license"])))
    best = F.coalesce(F.array_max(F.transform(finds, lambda x: x["coverage"])), F.lit(0.0))
    return _scanned(docs, id_col, text_col, templates, coverage, spread).select("doc_id", F.size(finds).cast("long").alias("n_finds"), F.array_join(names, "; ").alias("licenses"), best.alias("coverage"))


def _scanned(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str] | None, coverage: float, spread: float) -> DataFrame:
    scanner = Scanner(templates or TEMPLATES, coverage, spread)
    find = pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k, name, first, last, share in sorted(scanner.scan(part.column("text"))):
                    rows[k].append({"license": name, "first_word": first, "last_word": last, "coverage": share})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(find))], ["doc_id", "finds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, finds array<struct<license:string,first_word:long,last_word:long,coverage:double>>")
