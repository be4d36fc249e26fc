"""License scans: MinHash over overlapping windows retrieves templates, shingle containment verifies them.

Templates of like size, n to at most 1.5 n word shingles, are sought in windows that start every s = max(1,
n // 4) shingles and hold the largest of them and s more, so every run of a template's length lies in a
window. A window that holds `percent` % of a template's shingles has a Jaccard similarity of at least J with
it, and the number of bands (of one value each, so a window without a common shingle never collides) makes
the chance of missing it `miss` at most: (1 - J) ** bands <= miss. The signatures of all windows are
computed: least values of blocks of s shingles, and of as many blocks as a window has.

Licenses share sentences. A match is dropped where another license's match has more common shingles and
stands on half of its places or more, so an AGPL notice, which holds most of a GPL notice, is no GPL notice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.common import CACHES, map_texts, raw
from tidepool.llm.neardup import WordHashes, mixed
from tidepool.llm.phrases import words

# License texts and notices in common use.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
TEMPLATES = {
    "0BSD": [f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"],
    "AGPL-3.0": [_GNU_NOTICE.format("Affero General Public License", 3, "Affero General Public License")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [_BSD_HEAD, f"{_BSD_HEAD} {_BSD_CLAUSES} {_BSD_DISCLAIMER}"],
    "BSD-3-Clause": [f"{_BSD_HEAD} {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_DISCLAIMER}"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "GPL-2.0": [_GNU_NOTICE.format("General Public License", 2, "General Public License")],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _GNU_NOTICE.format("General Public License", 3, "General Public License"),
    ],
    "ISC": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"],
    "LGPL-2.1": [_GNU_NOTICE.format("Lesser General Public License", "2.1", "Lesser General Public License")],
    "LGPL-3.0": [_GNU_NOTICE.format("Lesser General Public License", 3, "Lesser General Public License")],
    "MIT": [
        "Released under the MIT License.",
        _MIT_GRANT,
        f'{_MIT_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}

_HASH = WordHashes()
CACHES[__name__] = _HASH.clear


def shingle_runs(word_list: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    if len(word_list) < k:
        return np.zeros(0, np.uint64)
    h = np.array([_HASH[w] for w in word_list], np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


@dataclass(frozen=True)
class Group:
    """Templates of like size, and the windows that they are sought in: `blocks` blocks of `step` shingles."""

    step: int
    blocks: int
    bands: int
    names: list[str]
    sets: list[np.ndarray]
    sketch: np.ndarray  # bands x templates

    @property
    def size(self) -> int:
        return self.step * self.blocks


#: How much longer than its smallest template a group's largest may be.
SPREAD = 1.5


class Scanner:
    def __init__(self, templates: dict[str, list[str]], k: int = 5, percent: int = 80, miss: float = 1e-7):
        self.k, self.percent = k, percent
        self.sized: list[tuple[int, str, str, np.ndarray]] = []
        for name in sorted(templates):
            for text in templates[name]:
                s = np.unique(shingle_runs(words(text.encode()), k))
                if not len(s):
                    raise ValueError(f"a template of {name} has fewer than {k} words")
                self.sized.append((len(s), name, text, s))
        self.sized.sort(key=lambda x: x[:3])
        cuts = [0]
        for i, x in enumerate(self.sized):
            if x[0] > SPREAD * self.sized[cuts[-1]][0]:
                cuts.append(i)
        groups = [self.sized[i:j] for i, j in zip(cuts, [*cuts[1:], len(self.sized)])]
        shapes = []
        for own in groups:
            step = max(1, own[0][0] // 4)
            blocks = -(-(own[-1][0] + step) // step)
            shapes.append((step, blocks, max(self._bands(n, step * blocks, miss) for n, *_ in own)))
        seeds = np.random.default_rng(20).integers(1, 1 << 63, max(b for _, _, b in shapes), dtype=np.uint64)
        self.factors = seeds * np.uint64(2) + np.uint64(1)
        self.groups = [Group(step, blocks, bands, [x[1] for x in own], [x[3] for x in own], np.stack([[self._hash(x[3], f).min() for x in own] for f in self.factors[:bands]])) for own, (step, blocks, bands) in zip(groups, shapes)]

    def _bands(self, n: int, size: int, miss: float) -> int:
        common = -(-self.percent * n // 100)
        return math.ceil(math.log(miss) / math.log(1 - common / (n + size - common)))

    @staticmethod
    def _hash(x: np.ndarray, factor: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return x * factor

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, float]]]:
        """For each text (license, first word of the window, containment) of every window that matches,
        in order."""
        runs = [shingle_runs(words(t), self.k) for t in texts]
        lens = np.array([len(r) for r in runs], np.int64)
        if not lens.sum():
            return [[] for _ in texts]
        x, first = np.concatenate(runs), np.cumsum(lens) - lens
        windows = []
        for g in self.groups:
            n = -(-lens // g.step)
            owner = np.repeat(np.arange(len(lens)), n)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * g.step
            windows.append((owner, start, first[owner] + start, np.zeros((len(owner), len(g.names)), bool)))
        for b, f in enumerate(self.factors):
            h = self._hash(x, f)
            for g, (owner, _, place, collides) in zip(self.groups, windows):
                if b < g.bands:
                    least = np.minimum.reduceat(h, place)
                    whole = least.copy()
                    for j in range(1, min(g.blocks, len(least))):
                        np.minimum(whole[:-j], least[j:], out=whole[:-j], where=owner[:-j] == owner[j:])
                    for t, target in enumerate(g.sketch[b]):
                        collides[:, t] |= whole == target
        out: list[list[tuple]] = [[] for _ in texts]
        for g, (owner, start, _, collides) in zip(self.groups, windows):
            for w, t in np.argwhere(collides):
                d, i = int(owner[w]), int(start[w])
                part = runs[d][i : i + g.size]
                at = np.flatnonzero(np.isin(part, g.sets[t]))
                common = len(np.unique(part[at]))
                if 100 * common >= self.percent * len(g.sets[t]):
                    out[d].append((g.names[t], i, common / len(g.sets[t]), common, tuple((i + at).tolist())))
        return [self._best(x) for x in out]

    @staticmethod
    def _best(found: list[tuple]) -> list[tuple[str, int, float]]:
        """Without the matches that another license's match with more common shingles stands on."""
        spans = {(name, common, at) for name, _, _, common, at in found}
        beaten = {a for a in spans if any(b[0] != a[0] and b[1] > a[1] and 2 * len({*a[2]} & {*b[2]}) >= len(a[2]) for b in spans)}
        return sorted({(name, i, share) for name, i, share, common, at in found if (name, common, at) not in beaten})


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """For each row: id_col, licenses (names of the templates found, sorted, without repeats), best
    (greatest containment found, 0 for none) and matches: (license, word, containment) of every window.

    Words are lower-cased runs of digits, letters and what lies beyond ASCII. Null, empty and short texts
    (fewer than k words) match nothing; rows are scanned one by one, so repeated rows and an empty table
    need nothing; other columns are ignored. The templates are a list in the program, not a table.
    A license that is found with as many common shingles as another in the same place stands beside it.
    """
    scanner = Scanner(templates or TEMPLATES, k, percent)
    kind = pa.list_(pa.struct([("license", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))

    def kernel(part: pa.RecordBatch) -> dict:
        got = scanner.scan(raw(part, "text"))
        return {
            "licenses": pa.array([sorted({m[0] for m in x}) for x in got], pa.list_(pa.string())),
            "best": pa.array([max((m[2] for m in x), default=0.0) for x in got], pa.float64()),
            "matches": pa.array([[{"license": a, "word": b, "containment": c} for a, b, c in x] for x in got], kind),
        }

    return map_texts(docs, id_col, text_col, "licenses array<string>, best double, matches array<struct<license:string,word:bigint,containment:double>>", kernel)


def oracle() -> str:
    """DuckDB SQL for (doc_id, n_licenses, licenses, best) of `documents`."""
    scanner = Scanner(TEMPLATES)
    shape = {(name, text): (g.step, g.size) for g, own in _grouped(scanner) for _, name, text, _ in own}
    rows = ", ".join("('{}', {}, '{}', {}, {})".format(name, i, text.replace("'", "''"), *shape[name, text]) for i, (name, text) in enumerate((n, t) for n in sorted(TEMPLATES) for t in TEMPLATES[n]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "SELECT id, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT id, w, unnest(range(greatest(len(w) - 4, 0))) AS p FROM {})"
    return f"""
WITH templates(name, id, text, step, size) AS (VALUES {rows}),
tw AS (SELECT id, {split} AS w FROM templates),
ts AS (SELECT DISTINCT id, s FROM ({runs.format("tw")})),
tn AS (SELECT name, t.id, step, size, count(*) AS n FROM ts JOIN templates t USING (id) GROUP BY name, t.id, step, size),
dw AS (SELECT doc_id AS id, {split} AS w FROM documents WHERE text IS NOT NULL),
ds AS ({runs.format("dw")}),
hits AS (SELECT ds.id AS doc_id, tn.id, name, n, step, size, p, s FROM ds JOIN ts USING (s) JOIN tn ON ts.id = tn.id),
wins AS (SELECT doc_id, id, name, n, s, size, unnest(range(greatest(0, -((size - 1 - p) // step)), p // step + 1)) * step AS start, p FROM hits),
found AS MATERIALIZED (SELECT doc_id, name, count(DISTINCT s) AS common, count(DISTINCT s) / n AS part, list(DISTINCT p) AS at FROM wins WHERE p >= start AND p < start + size
  GROUP BY doc_id, id, name, n, start HAVING 100 * count(DISTINCT s) >= 80 * n),
kept AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.name <> a.name AND b.common > a.common AND 2 * len(list_intersect(a.at, b.at)) >= len(a.at)))
SELECT d.doc_id, count(DISTINCT name) AS n_licenses, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, round(coalesce(max(part), 0), 6) AS best
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


def _grouped(scanner: Scanner):
    """Each group with its templates."""
    at = 0
    for g in scanner.groups:
        yield g, scanner.sized[at : at + len(g.names)]
        at += len(g.names)
