"""Licence scans: parts of a text against licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .scratch import bounded

THRESHOLD = 0.8
#: Of licences whose templates are like each other one is reported only if no other is better by more than this.
MARGIN = 0.02

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = " ".join(
    [
        "This program is free software: you can redistribute it",
        "and/or modify it under the terms of the GNU",
        "General Public License as published by the Free Software",
        "Foundation, either version 3 of the License, or (at",
        "your option) any later version. This program is distributed",
        "in the hope that it will be useful, but",
        "WITHOUT ANY WARRANTY; without even the implied warranty of",
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the",
        "GNU General Public License for more details.",
    ]
)
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_AGPL = _GPL.replace("GNU General", "GNU Affero General")
_GPL2 = _GPL.replace("either version 3 of", "either version 2 of").replace("free software: you", "free software; you")
_LGPL = _GPL2.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
_LGPL3 = _LGPL.replace("version 2.1 of", "version 3 of")
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Identifiers of licences as source files name them; those of one word are too short to tell from the label before them.
_SPDX = "BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()

#: (licence, text of the template): whole grants, headers, and one-line notices and identifiers that name a licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", _BSD3 + _BSD_END),
    ("BSD", "Licensed under the BSD License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
    ("GPL-2.0", _GPL2),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", _LGPL),
    ("LGPL-3.0", _LGPL3),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", _AGPL),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", _EPL),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *[(k.replace("-only", "").replace("-or-later", ""), f"SPDX-License-Identifier: {k}") for k in _SPDX],
)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        names, texts = zip(*templates)
        raw, off = T.buffers(T.lower(pa.array(texts)))
        h, _, _, word = T.words(raw, off)
        sets = [np.unique(_bigrams(h[a:b], np.zeros(b - a, np.int64))[0]) for a, b in zip(word, word[1:])]
        # a run of words has at most (2 - t) / t as many bigrams as the template, and t / (2 - t) |B| or more in common with it
        self.longest = np.floor((2 - threshold) / threshold * (np.diff(word) - 1) + 1e-9).astype(np.int64)
        self.need = np.ceil([threshold / (2 - threshold) * len(s) - 1e-9 for s in sets]).astype(np.int64)
        self.names, self.t = names, threshold
        self.sizes = np.array([len(s) for s in sets])
        self.known = np.unique(np.concatenate(sets))
        self.has = np.stack([np.isin(self.known, s) for s in sets])  # templates by bigrams
        # Dice of t or more needs t / 2 (|A| + |B|) common bigrams and |A| of t / (2 - t) |B| or more
        self.least = max(1, math.ceil(threshold / 2 * (self.sizes.min() + threshold / (2 - threshold) * self.sizes.min()) - 1e-9))

        self.by_size = np.argsort(self.sizes, kind="stable")
        both = self.has.astype(np.int64) @ self.has.T.astype(np.int64)
        alike = 2 * both >= threshold * (self.sizes[:, None] + self.sizes) - 1e-12
        self.rivals = {(names[i], names[j]) for i, j in np.argwhere(alike).tolist() if names[i] != names[j]}

    def reported(self, rows: dict[tuple[int, str], float]) -> list[tuple[int, str, float]]:
        """(text, licence, coefficient) of those that no rival in the same text is better than by more than MARGIN; rivals have templates that are like each other."""
        texts: dict[int, list[tuple[str, float]]] = {}
        for (at, name), dice in sorted(rows.items()):
            texts.setdefault(at, []).append((name, dice))
        beaten = lambda x, all_: any(y[1] > x[1] + MARGIN and (x[0], y[0]) in self.rivals for y in all_)
        return [(at, *x) for at, found in texts.items() for x in found if not beaten(x, found)]

    def near(self, size: int) -> np.ndarray:
        """The templates whose sizes allow the threshold: 2 min(|A|, |B|) / (|A| + |B|) must reach it. No other is compared."""
        least, most = self.t / (2 - self.t) * size, (2 - self.t) / self.t * size
        a, z = np.searchsorted(self.sizes[self.by_size], [least - 1e-9, most + 1e-9])
        return self.by_size[a:z]


def _bigrams(h: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of words that stand in one unit, and the unit of each."""
    if len(h) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = unit[1:] == unit[:-1]
    return T.mix(h[:-1] + h[1:] * T._STEP)[keep], unit[:-1][keep]


def _units(part: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each word its line, its paragraph (between lines without any character but blanks), its text."""
    new = np.flatnonzero(part == 10)
    blank = np.isin(part, (9, 13, 32))
    solid = np.append(0, np.cumsum(~blank))
    empty = new[1:][solid[new[1:]] == solid[new[:-1] + 1]] if len(new) > 1 else new[:0]
    line = np.searchsorted(new, first) + doc * 1
    return [line, np.searchsorted(empty, first) + doc * 1, doc]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice): for each text the licences that a part of it is like, with the best coefficient.

    The parts are the lines of the text, its paragraphs, the text itself, and for each template every run of
    words of at most (2 - threshold) / threshold times its length; all in lower case without signs.
    The coefficient is that of the sets of word bigrams: 2 |A & B| / (|A| + |B|). A template is compared
    only if the sizes allow the threshold. Null or empty texts have no licence; null ids stay null;
    repeated rows are reported each; an empty table gives no rows. Of templates of one licence the best
    counts. Of several licences that a text is like each has its row, ties included, but of those that have templates like
    each other (they differ by a few words) only the best, and what is within MARGIN of it. Other columns are not read.
    Texts are read whole.
    """
    docs = bounded(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Templates(templates, threshold)
        for b in batches:
            raw, off = T.buffers(T.lower(b.column(1)))
            rows: dict[tuple[int, str], float] = {}
            for i, j in T.chunks(off):
                part = raw[off[i] : off[j]]
                h, first, _, word = T.words(part, off[i : j + 1] - off[i])
                doc = np.repeat(np.arange(i, j), np.diff(word))
                for unit in _units(part, doc, first):
                    for at, name, dice in _matches(ready, h, unit):
                        key = (int(doc[at]), name)
                        rows[key] = max(dice, rows.get(key, 0.0))
                _runs(ready, h, doc, rows)
            out = ready.reported(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())], names=["doc_id", "license", "dice"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(go, f"doc_id {kind}, license string, dice double")


def _matches(ready: Templates, h: np.ndarray, unit: np.ndarray) -> Iterator[tuple[int, str, float]]:
    """(a word of the unit, licence, coefficient); units are numbered in order."""
    gram, of = _bigrams(h, unit)
    if not len(gram):
        return
    at = np.minimum(np.searchsorted(ready.known, gram), len(ready.known) - 1)
    hit = ready.known[at] == gram
    if not hit.any():
        return
    units, counts = np.unique(of[hit], return_counts=True)
    for u in units[counts >= ready.least].tolist():
        a, z = np.searchsorted(of, [u, u + 1])
        size = len(np.unique(gram[a:z]))
        own = np.unique(at[a:z][hit[a:z]])
        near = ready.near(size)
        common = ready.has[near[:, None], own].sum(1)
        dice = 2 * common / (size + ready.sizes[near])
        for k in np.flatnonzero(dice >= ready.t - 1e-12).tolist():
            yield int(np.searchsorted(unit, u)), ready.names[near[k]], float(dice[k])


def _runs(ready: Templates, h: np.ndarray, doc: np.ndarray, rows: dict[tuple[int, str], float]) -> None:
    """Raises the coefficients in rows, by text and licence, to those of the best runs of words of each text."""
    gram, of = _bigrams(h, doc)
    if not len(gram):
        return
    at = np.minimum(np.searchsorted(ready.known, gram), len(ready.known) - 1)
    hit = np.flatnonzero(ready.known[at] == gram)
    if not len(hit):
        return
    for k, name in enumerate(ready.names):
        # the best run begins with a bigram of the template
        start = hit[ready.has[k, at[hit]]]
        end = np.minimum(start + ready.longest[k], np.searchsorted(of, of[start], "right"))
        count = np.searchsorted(start, end) - np.arange(len(start))
        able = np.flatnonzero(count >= ready.need[k])
        count = np.minimum(count[able], ready.sizes[k])
        most = 2 * count / (count + ready.sizes[k])
        for j in np.argsort(-most, kind="stable").tolist():
            a, z = int(start[able[j]]), int(end[able[j]])
            key = (int(of[a]), name)
            if most[j] <= rows.get(key, 0.0):
                continue
            new = np.zeros(z - a, bool)
            new[np.unique(gram[a:z], return_index=True)[1]] = True
            mine = (ready.known[at[a:z]] == gram[a:z]) & ready.has[k, at[a:z]]
            dice = float((2 * np.cumsum(new & mine) / (np.cumsum(new) + ready.sizes[k])).max())
            if dice >= ready.t - 1e-12:
                rows[key] = max(dice, rows.get(key, 0.0))


def sql(threshold: float = THRESHOLD, templates: tuple = TEMPLATES) -> str:
    """scan() over documents in DuckDB's SQL, rounded to 6 places, but for runs of words that are no line, paragraph or text."""
    rows = ", ".join("({}, '{}', '{}')".format(k, n, x.replace("'", "''")) for k, (n, x) in enumerate(templates))
    words = r"regexp_extract_all(lower({}), '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH m(k, license, text) AS (VALUES {rows}), mw AS (SELECT k, license, {words.format("text")} AS w FROM m), mg AS (SELECT k, license, {grams} AS g FROM mw),
me AS (SELECT k, license, len(g) AS n, unnest(g) AS x FROM mg),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) AS t FROM d),
uw AS (SELECT row_number() OVER () AS q, r, doc_id, {words.format("t")} AS w FROM u), ug AS (SELECT q, r, doc_id, {grams} AS g FROM uw WHERE len(w) > 1),
ue AS (SELECT q, r, doc_id, len(g) AS n, unnest(g) AS x FROM ug),
c AS (SELECT ue.q, r, ue.doc_id, k, license, 2 * count(*) / (any_value(ue.n) + any_value(me.n)) AS dice FROM ue JOIN me USING (x) GROUP BY ALL),
b AS (SELECT r, doc_id, license, max(dice) AS dice FROM c WHERE dice >= {threshold} - 1e-12 GROUP BY r, doc_id, license),
v AS (SELECT DISTINCT i, j FROM (SELECT a.license AS i, b.license AS j FROM me a JOIN me b USING (x) GROUP BY a.k, b.k, 1, 2 HAVING 2 * count(*) / (any_value(a.n) + any_value(b.n)) >= {threshold} - 1e-12) WHERE i <> j)
SELECT doc_id, license, round(dice, 6) AS dice FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS o JOIN v ON v.j = o.license WHERE o.r = b.r AND v.i = b.license AND o.dice > b.dice + {MARGIN})
"""
