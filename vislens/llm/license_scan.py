"""Licence texts in documents by patience alignment.

Words that are unique both to the template and to a window of the document are
anchors; the longest increasing subsequence of their places is kept, and the gaps
between are aligned in the same way. A gap without unique common words is aligned
by the longest common subsequence, found with the same routine. Coverage is the
share of the template's words that are aligned.

A document is tokenised once. A template is tried only if the words it shares
with the whole document could reach the coverage, and only in windows around its
rarest words there: a match may lack few words, so it must hold one of as many
rarest words as cannot all be lacking. Both tests are exact.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of public licences.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-warranty": _AS_IS + (
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
    ) + _BSD_WARRANTY,
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
}

WORD = re.compile(r"\w+")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by (first, -second), that increases in both."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str], shift: tuple[int, int] = (0, 0)) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal words, increasing in both."""
    if not a or not b:
        return []
    # equal ends need no anchors
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    i0, j0 = shift
    out = [(i0 + k, j0 + k) for k in range(head)]
    end = [(i0 + n - k, j0 + m - k) for k in range(tail, 0, -1)]
    a, b, i0, j0 = a[head : n - tail], b[head : m - tail], i0 + head, j0 + head
    count_a, count_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if count_b[w] == 1}
    anchors = increasing([(i, place[w]) for i, w in enumerate(a) if count_a[w] == 1 and w in place])
    if not anchors:
        where: dict[str, list[int]] = {}
        for j, w in enumerate(b):
            where.setdefault(w, []).append(j)
        rest = increasing([(i, j) for i, w in enumerate(a) for j in reversed(where.get(w, ()))])
        return out + [(i + i0, j + j0) for i, j in rest] + end
    i, j = 0, 0
    for p, q in [*anchors, (len(a), len(b))]:
        out += patience(a[i:p], b[j:q], (i0 + i, j0 + j))
        if p < len(a):
            out.append((i0 + p, j0 + q))
        i, j = p + 1, q + 1
    return out + end


def closest(own: list[str], words: list[str], pairs: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The alignment itself, or one of as many words that spans less: of copies in a row it should take one, not parts of two."""
    if not pairs:
        return pairs
    size = len(own) + len(own) // 4 + 1
    first, last = pairs[0][1], pairs[-1][1]
    for a, b in ((first, min(high, first + size)), (max(low, last + 1 - size), last + 1)):
        if pairs[-1][1] - pairs[0][1] >= len(own):
            other = patience(own, words[a:b], (0, a))
            if len(other) >= len(pairs) and other[-1][1] - other[0][1] < pairs[-1][1] - pairs[0][1]:
                pairs = other
    return pairs


class Scanner:
    """Templates ready for scanning."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {}
        for name, text in templates.items():
            words = [w.lower() for w in WORD.findall(text)]
            if words:
                need = -(-round(coverage * len(words) * 10**6) // 10**6)
                self.templates[name] = (words, Counter(words), int(need))

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(template, words of it, words aligned, start, end) of every match, spans of one template not overlapping."""
        words = [w.lower() for w in WORD.findall(text)]
        known = set(words)
        found = []
        places = spans = None
        for name, (own, counts, need) in self.templates.items():
            if sum(n for w, n in counts.items() if w in known) < need:
                continue
            if places is None:
                places = {}
                for j, w in enumerate(words):
                    places.setdefault(w, []).append(j)
            seeds: list[int] = []
            lacking = 0
            for w in sorted(counts, key=lambda w: (len(places.get(w, ())), w)):
                if lacking > len(own) - need:
                    break
                lacking += counts[w]
                seeds += places.get(w, ())
            for first, last, n in self._matches(own, need, words, sorted(set(seeds))):
                if spans is None:
                    spans = [m.span() for m in WORD.finditer(text)]
                found.append((name, len(own), n, spans[first][0], spans[last][1]))
        return sorted(found, key=lambda x: (x[3], x[4], x[0]))

    @staticmethod
    def _matches(own: list[str], need: int, words: list[str], seeds: list[int]) -> list[tuple[int, int, int]]:
        """(first word, last word, words aligned) of matches that do not overlap.

        Windows reach half a template beyond its length to both sides of a seed, but
        not into a match that is taken already; they are tried again until none is
        left, so that copies which follow one another are all found.
        """
        reach = len(own) + len(own) // 2 + 2
        taken: list[tuple[int, int, int]] = []
        tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
        while True:
            better = []
            for p in seeds:
                k = bisect_left(taken, (p + 1,))
                low, high = max(0, p - reach), min(len(words), p + reach + 1)
                if k:
                    low = max(low, taken[k - 1][1] + 1)
                if k < len(taken):
                    high = min(high, taken[k][0])
                if low > p or high - low < need:
                    continue
                if (low, high) not in tried:
                    tried[low, high] = closest(own, words, patience(own, words[low:high], (0, low)), low, high)
                pairs = tried[low, high]
                if len(pairs) >= need:
                    better.append((-len(pairs), pairs[-1][1] - pairs[0][1], pairs[0][1], pairs[-1][1], len(pairs)))
            if not better:
                return taken
            for _, _, first, last, n in sorted(set(better)):
                k = bisect_left(taken, (first,))
                if not (k and taken[k - 1][1] >= first) and not (k < len(taken) and taken[k][0] <= last):
                    taken.insert(k, (first, last, n))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8) -> DataFrame:
    """(id_col, license, n_words, n_aligned, coverage, start, end): one row per licence text found, with its code point offsets.

    A match aligns at least `coverage` of the template's words within a window of
    three template lengths; of overlapping matches of one template the best stays,
    then the shortest, then the first. Different templates may overlap. Words are
    runs of word characters in lower case; a template without words matches
    nothing. Null and empty texts have no matches; rows that repeat an id are
    scanned apart. Other columns are not read. An empty table gives no rows.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be in (0, 1]")
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "license", "n_words", "n_aligned", "coverage", "start", "end"]

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                for hit in scanner.scan(text.as_py() or ""):
                    at.append(i)
                    found.append((*hit[:3], hit[2] / hit[1], *hit[3:]))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            columns = list(zip(*found)) or [[]] * len(kinds)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    schema = f"`{id_col}` {kind}, license string, n_words int, n_aligned int, coverage double, start int, end int"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
