"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are cut into words (letters and digits, case folded for A-Z) and shingles of five words. A template
of s shingles is looked up by windows of 2**k <= s shingles: all of its own windows are in the table, and a text's
windows of that size start every quarter of a window, so an exact copy meets a window of Jaccard 0.77 or more. With
``BANDS`` bands of ``ROWS`` rows such a pair shares a band with probability 1 - (1 - 0.77**2)**8 > 0.999; several windows
try. A retrieved template is a match where the words around the window hold at least ``CONTAINED`` of its shingles,
compared word by word, and where the words that tell its license from sisters stand (or do not). Of matches
that overlap the one with most shingles stays, then with the highest containment, then the shortest: a place has one name. Long licenses (GPL, LGPL, AGPL, Apache, MPL) are known by their notices, not by their texts.

Defined cases: null text is empty; texts and templates of fewer than five words are one shingle of all their words;
null and repeated doc_ids are scanned like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, texts_of

WORDS = 5
CONTAINED = 0.8
BANDS, ROWS = 8, 2
TABLE_BITS = 22
#: Words beside a match in which its telling words may end: the shingles of an edited end are not among those found.
EDGE = 2

_FREE = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_SHORT = "Licensed under the GNU {0}, version {1}."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
#: Common notices and short texts by SPDX identifier; an opening that two licenses share stands under both.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": ["Released under the MIT License.", _MIT[0], " ".join(_MIT)],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [_SHORT.format("General Public License", 3), _FREE.format(":", "General Public License", ",", 3)],
    "GPL-2.0": [_SHORT.format("General Public License", 2), _FREE.format(";", "General Public License", ";", 2), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "LGPL-3.0": [_SHORT.format("Lesser General Public License", 3), _FREE.format(":", "Lesser General Public License", ",", 3)],
    "LGPL-2.1": [_SHORT.format("Lesser General Public License", "2.1"), _FREE.format(";", "Lesser General Public License", ";", "2.1").replace("program", "library")],
    "AGPL-3.0": [_SHORT.format("Affero General Public License", 3), _FREE.format(":", "Affero General Public License", ",", 3)],
    "BSD-2-Clause": [" ".join([_BSD_OPENING, _BSD_SOURCE, _BSD_BINARY, _BSD_AS_IS])],
    "BSD-3-Clause": [" ".join([_BSD_OPENING, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_AS_IS])],
    "BSD-2-Clause OR BSD-3-Clause": [_BSD_OPENING],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Words that must stand together in a match (one of each list of alternatives), or must not: what tells a license from its sisters.
REQUIRED = {
    "Apache-2.0": [["apache license"], ["version 2 0"]],
    "CC-BY-NC-4.0": [["by nc 4 0", "noncommercial 4 0"]],
    "CC-BY-4.0": [["by 4 0", "attribution 4 0"]],
    "CC-BY-SA-4.0": [["by sa 4 0", "sharealike 4 0"]],
    "GPL-3.0": [["gnu general public license"], ["version 3"]],
    "GPL-2.0": [["gnu general public license"], ["version 2"]],
    "LGPL-3.0": [["lesser general public license"], ["version 3"]],
    "LGPL-2.1": [["lesser general public license"], ["version 2 1"]],
    "AGPL-3.0": [["affero general public license"], ["version 3"]],
    "BSD-3-Clause": [["endorse or promote products"]],
    "MPL-2.0": [["mozilla public license"], ["v 2 0", "mpl 2 0"]],
}
FORBIDDEN = {"BSD-2-Clause": ["endorse or promote products"], "GPL-2.0": ["version 2 1"]}

_KEEP = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_ODD = np.random.default_rng(8).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) <= n:
            up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)


def words_of(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(folded UTF-8, starts, ends) of the words."""
    line = text.lower().translate(_KEEP)
    letter = np.frombuffer(line, np.uint8) != 32
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    return line, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_hashes(line: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    _Powers.to(len(line))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(line)])])
    word = (total[end] - total[start]) * _Powers.down[start]
    word = (word ^ (word >> np.uint64(29))) * _ODD[60]
    n = max(1, len(word) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(word))):
        out = (out ^ word[i : i + n]) * _ODD[61]
        out ^= out >> np.uint64(31)
    return out


def window_bands(shingles: np.ndarray, scales: set[int], stride: bool) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(scale, window starts, a key array per band) over windows of 2**scale shingles."""
    least = [((shingles * _ODD[p]) >> np.uint64(32)).astype(np.uint32) for p in range(BANDS * ROWS)]
    for scale in range(max(scales, default=-1) + 1):
        size = 1 << scale
        if size > len(shingles):
            return
        if scale:
            half = size // 2
            least = [np.minimum(v[:-half], v[half:]) for v in least]
        if scale in scales:
            step = max(1, size // 4) if stride else 1
            keys = []
            for b in range(BANDS):
                key = np.full(len(least[0][::step]), 40 + scale * BANDS + b, np.uint32)
                for v in least[b * ROWS : (b + 1) * ROWS]:
                    key = (key ^ v[::step]) * np.uint32(0x9E3779B1)
                    key ^= key >> np.uint32(15)
                keys.append(key)
            yield scale, np.arange(0, len(least[0]), step), keys


class Templates:
    """The band table of all templates' windows; its size depends on the templates alone."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.shingles = [], []
        self.scales: set[int] = set()
        table: dict[tuple[int, int, int], set[int]] = {}
        self.hit = np.zeros(1 << TABLE_BITS, bool)
        for name, texts in templates.items():
            for text in texts:
                line, start, end = words_of(text.encode())
                t = len(self.names)
                self.names.append(name)
                self.shingles.append(exact_shingles(line, start, end, 0, len(start)))
                hashes = shingle_hashes(line, start, end)
                scale = len(hashes).bit_length() - 1
                self.scales.add(scale)
                for k, _, keys in window_bands(hashes, {scale}, False):
                    for b, key in enumerate(keys):
                        self.hit[key >> np.uint32(32 - TABLE_BITS)] = True
                        for v in key.tolist():
                            table.setdefault((k, b, v), set()).add(t)
        self.table = table

    def candidates(self, hashes: np.ndarray) -> dict[int, list[int]]:
        """template -> window starts at which a band agrees."""
        out: dict[int, list[int]] = {}
        for scale, start, keys in window_bands(hashes, self.scales, True):
            for b, key in enumerate(keys):
                at = np.flatnonzero(self.hit[key >> np.uint32(32 - TABLE_BITS)])
                for i, v in zip(start[at].tolist(), key[at].tolist()):
                    for t in self.table.get((scale, b, v), ()):
                        out.setdefault(t, []).append(i)
        return out


def exact_shingles(line: bytes, start: np.ndarray, end: np.ndarray, low: int, high: int) -> list[tuple[bytes, ...]]:
    """Shingles of the words low to high (end exclusive)."""
    words = [line[a:b] for a, b in zip(start[low:high].tolist(), end[low:high].tolist())]
    if len(words) <= WORDS:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


Match = tuple[str, int, int, float]  # license, start, end (bytes of the UTF-8 text, end exclusive), containment


def told(name: str, words: bytes) -> bool:
    """Whether a match's words, with ``EDGE`` more at either end, are those of this license and not of a sister."""
    stands = lambda phrase: b" " + phrase.encode() + b" " in words
    return all(any(map(stands, some)) for some in REQUIRED.get(name, [])) and not any(map(stands, FORBIDDEN.get(name, [])))


def densest(held: list[tuple[int, tuple]], width: int) -> dict[tuple, int]:
    """Shingle -> place, of the stretch of ``width`` places at most with most different shingles, the shortest of these: next to a sister's notice a copy is whole only in its own place."""
    count: dict[tuple, int] = {}
    best, at, low = (0, 0), (0, 0), 0
    for high, (j, s) in enumerate(held):
        count[s] = count.get(s, 0) + 1
        while held[low][0] <= j - width or count[held[low][1]] > 1:
            old = held[low][1]
            count[old] -= 1
            if not count[old]:
                del count[old]
            low += 1
        if (found := (len(count), held[low][0] - j)) > best or not best[0]:
            best, at = found, (low, high + 1)
    return {s: j for j, s in held[at[0] : at[1]]}


def one_a_place(found: list[tuple[float, int, str, int, int]]) -> list[Match]:
    """Of (containment, shingles, license, start, end) those that stay, in the order of the text."""
    best: list[tuple[float, int, str, int, int]] = []
    for m in sorted(set(found), key=lambda m: (-m[1], -m[0], m[4] - m[3], m[2], m[3])):
        if all(m[4] <= k[3] or k[4] <= m[3] for k in best):
            best.append(m)
    return sorted(((m[2], m[3], m[4], m[0]) for m in best), key=lambda m: (m[1], m[2], m[0]))


def matches(texts: list[str], templates: Templates) -> list[list[Match]]:
    """Per text its verified places. Texts are looked up end to end; verification keeps to each text's own words."""
    lines = [t.encode("utf-8", "surrogatepass") for t in texts]
    line, start, end = words_of(b" ".join(lines))
    base = np.cumsum([0, *(len(x) + 1 for x in lines)])
    first = np.searchsorted(start, base)  # each text's first word
    places = {t: np.array(sorted(set(p))) for t, p in templates.candidates(shingle_hashes(line, start, end)).items()}
    for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WORDS)):  # texts of one short shingle
        w = slice(first[d], first[d + 1])
        for t in templates.candidates(shingle_hashes(line, start[w], end[w])):
            places[t] = np.union1d(places.get(t, np.zeros(0, np.int64)), first[d])
    out: list[list[tuple[float, int, str, int, int]]] = [[] for _ in texts]
    for t, at in places.items():
        wanted = set(templates.shingles[t])
        size, upto = len(templates.shingles[t]), -1
        for i, d in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist()):
            if i < upto:  # inside the last whole copy
                continue
            low, high = max(int(first[d]), i - size), min(int(first[d + 1]), i + 2 * size + WORDS)
            held = [(j, s) for j, s in enumerate(exact_shingles(line, start, end, low, high), low) if s in wanted]
            found = densest(held, size + size // 4 + 2 * WORDS)
            if len(found) < CONTAINED * len(wanted):
                # apart, as by a passage put in: of each wanted shingle the occurrence nearest to the window
                found = {}
                for j, s in held:
                    if s not in found or abs(j - i) < abs(found[s] - i):
                        found[s] = j
            share = len(found) / len(wanted)
            if share >= CONTAINED:
                a, b = min(found.values()), min(max(found.values()) + WORDS, high)
                spoken = lambda p, q: b" " + b" ".join([line[x:y] for x, y in zip(start[p:q].tolist(), end[p:q].tolist())]) + b" "
                if told(templates.names[t], spoken(max(int(first[d]), a - EDGE), min(int(first[d + 1]), b + EDGE))):
                    out[d].append((share, len(found), templates.names[t], int(start[a] - base[d]), int(end[b - 1] - base[d])))
                    upto = b if share == 1 and b - a == size + WORDS - 1 else upto
    return [one_a_place(m) for m in out]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, matches) per document."""
    given = templates or TEMPLATES
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(given)
        for batch, texts in texts_of(batches, 1 << 20):
            rows = [[{"license": n, "start": s, "end": e, "containment": c} for n, s, e, c in found] for found in matches(texts, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "matches"])

    schema = "doc_id long, matches array<struct<license:string,start:long,end:long,containment:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
