"""License scans: winnowed template fingerprints, an inverted index, and banded alignment.

Template texts are cut into words; of the hashes of their word grams, winnowing keeps the least of each
window, and an inverted index maps a kept hash to its templates and places. All grams of a document are
looked up, so every passage that shares ``GRAM + WINDOW - 1`` words with a template is found. Hits on one
diagonal make a candidate, which is aligned with the template inside a band. What matches at least
``COVERAGE`` of the template's words and has the template's deciding phrases (the license's name and version, in
braces below), word for word and unbroken, is reported with its span in the document. So a notice of another version
or variant is no finding, however much of its wording is shared.

Defined results: a null or empty text, or one with fewer words than a gram, has no findings; a template that
occurs several times is reported for each; of overlapping findings the one of more matched words stays, then of
higher coverage, then the first; repeated rows have findings of their own; an empty table gives no rows; other columns
are not read. The index is broadcast: its size is that of the templates, at most ``TEMPLATE_WORDS`` words, which is
checked.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame

GRAM, WINDOW, BAND, COVERAGE, TEMPLATE_WORDS = 3, 2, 8, 0.8, 1_000_000
#: Candidates aligned at once.
CANDIDATES = 4096

WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
BSD_LIST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
NEITHER = "{Neither the name of} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GNU = "This {kind} is free software: you can redistribute it and/or modify it under the terms of the {{{name}}} as published by the Free Software Foundation, either {{version {version}}} of the License, or (at your option) any later version."
OLD_GNU = "This {kind} is free software; you can redistribute it and/or modify it under the terms of the {{{name}}} as published by the Free Software Foundation; either {{version {version}}} of the License, or (at your option) any later version."
GNU_WARRANTY = " This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."


def gnu(text: str, kind: str, name: str, version: str) -> str:
    return (text + GNU_WARRANTY).format(kind=kind, name=name, version=version)


# Notices of common licenses, as their publishers word them; deciding phrases stand in braces.
TEMPLATES = {
    "MIT-notice": "Released under the {MIT License}.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "{Permission is hereby granted, free of charge}, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the {Apache License, Version 2.0}.",
    "Apache-2.0": "Licensed under the {Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-notice": "This work is licensed under the {GNU General Public License, version 2}.",
    "GPL-3.0-notice": "This work is licensed under the {GNU General Public License, version 3}.",
    "LGPL-2.1-notice": "This work is licensed under the {GNU Lesser General Public License, version 2.1}.",
    "LGPL-3.0-notice": "This work is licensed under the {GNU Lesser General Public License, version 3}.",
    "AGPL-3.0-notice": "This work is licensed under the {GNU Affero General Public License, version 3}.",
    "GPL-2.0": gnu(OLD_GNU, "program", "GNU General Public License", "2"),
    "GPL-3.0": gnu(GNU, "program", "GNU General Public License", "3"),
    "GPL-3.0-grant": GNU.format(kind="program", name="GNU General Public License", version="3"),
    "LGPL-2.1": gnu(OLD_GNU, "library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": gnu(GNU, "program", "GNU Lesser General Public License", "3"),
    "AGPL-3.0": gnu(GNU, "program", "GNU Affero General Public License", "3"),
    "BSD-2-Clause": f"{BSD_LIST} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_LIST} 3. {NEITHER} {BSD_DISCLAIMER}",
    "BSD-2-Clause-list": BSD_LIST,
    "BSD-3-Clause-list": f"{BSD_LIST} 3. {NEITHER}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0} which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-notice": "Distributed under the {Boost Software License, Version 1.0}.",
    "CC0-1.0-notice": "Licensed under {CC0 1.0}.",
} | {
    f"CC-{kind}-{version}-notice": f"Licensed under {{CC {kind} {version}}}."
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    for version in ("2.0", "2.5", "3.0", "4.0")
}

PHRASE = re.compile(r"\{([^{}]*)\}")


def plain(template: str) -> str:
    """A template's text without the marks of its deciding phrases."""
    return PHRASE.sub(r"\1", template)


EDGES = re.compile(r"^\W+|\W+$")


def norm(word: str) -> str:
    return EDGES.sub("", word.lower())


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """Hashes of all grams of word numbers."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h + ids[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


class Index:
    """Templates as word numbers, and an inverted index of their winnowed grams."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {"": 0}
        numbers = lambda text: np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in map(norm, text.split()) if w], np.int32)
        self.words = [numbers(plain(templates[name])) for name in self.names]
        self.deciding = [[numbers(p) for p in PHRASE.findall(templates[name])] for name in self.names]
        if sum(map(len, self.words)) > TEMPLATE_WORDS:
            raise ValueError("too many template words to broadcast")
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.words):
            h = gram_hashes(ids)
            picked = {int(np.argmin(h[i : i + WINDOW])) + i for i in range(max(1, len(h) - WINDOW + 1))} if len(h) else set()
            for i in picked:
                postings.setdefault(int(h[i]), []).append((t, i))
        self.postings = postings
        self.keys = np.array(sorted(postings), np.uint64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, first word in the document if aligned from its beginning), one for hits on near diagonals."""
        h = gram_hashes(ids)
        if not len(h) or not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        found = sorted({(t, int(i) - place) for i in np.flatnonzero(self.keys[at] == h) for t, place in self.postings[int(h[i])]})
        out: list[tuple[int, int]] = []
        for t, d in found:
            if not out or out[-1][0] != t or d - out[-1][1] > BAND // 2:
                out.append((t, d))
        return out

    def align(self, t: int, ids: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Most matched words of template ``t`` within the band around each diagonal; the first and last matched word."""
        a = self.words[t]
        width = 2 * BAND + 1
        # state at offset o of row i: document word i + diagonal + o - BAND was the last considered
        shape = (len(diagonals), width)
        best, first, last = np.zeros(shape, np.int64), np.full(shape, -1), np.full(shape, -1)
        none = np.full((len(diagonals), 1), -1)
        for i in range(len(a)):
            place = i + diagonals[:, None] + np.arange(width) - BAND
            ok = (place >= 0) & (place < len(ids))
            hit = ok & (ids[np.clip(place, 0, len(ids) - 1)] == a[i])
            # a match continues the same offset; skipping a template word comes from the next offset
            match, f, z = best + hit, np.where(hit & (first < 0), place, first), np.where(hit, place, last)
            skip, fs, zs = (np.concatenate([x[:, 1:], none], 1) for x in (best, first, last))
            take = skip > match
            best, first, last = np.where(take, skip, match), np.where(take, fs, f), np.where(take, zs, z)
            # skipping document words comes from the best offset before
            top = np.maximum.accumulate(best, 1)
            source = np.maximum.accumulate(np.where(best == top, np.arange(width), 0), 1)
            best, first, last = top, np.take_along_axis(first, source, 1), np.take_along_axis(last, source, 1)
        o = best.argmax(1)[:, None]
        return tuple(np.take_along_axis(x, o, 1)[:, 0] for x in (best, first, last))

    def decided(self, t: int, ids: np.ndarray) -> bool:
        """Whether a stretch of a document has all deciding phrases of a template."""
        return all((np.lib.stride_tricks.sliding_window_view(ids, len(p)) == p).all(1).any() if len(ids) >= len(p) else False for p in self.deciding[t])

    def findings(self, ids: np.ndarray, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(matched words, template, first, last) of the candidates that are findings, without overlaps, in order."""
        of: dict[int, list[int]] = {}
        for t, d in candidates:
            of.setdefault(t, []).append(d)
        found = []
        for t, diagonals in of.items():
            for k in range(0, len(diagonals), CANDIDATES):
                for m, f, z in zip(*(x.tolist() for x in self.align(t, ids, np.array(diagonals[k : k + CANDIDATES]))), strict=True):
                    if m >= COVERAGE * len(self.words[t]) and self.decided(t, ids[f : z + 1]):
                        found.append((m, t, f, z))
        found.sort(key=lambda x: (-x[0], len(self.words[x[1]]), x[2], x[1]))
        taken: list[tuple] = []  # disjoint, by first word
        for m, t, f, z in found:
            at = bisect_left(taken, (f,))
            if (at == len(taken) or taken[at][0] > z) and (at == 0 or taken[at - 1][1] < f):
                insort(taken, (f, z, t, m))
        return [(m, t, f, z) for f, z, t, m in taken]

    def scan(self, text: str, cache: dict[str, int]) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end in characters) of each finding."""
        raw = text.split()
        for w in {w for w in raw if w not in cache}:
            n = norm(w)
            cache[w] = self.vocabulary.get(n, -1) if n else -2
        ids = np.fromiter(map(cache.__getitem__, raw), np.int64, len(raw))
        kept = np.flatnonzero(ids != -2)  # chunks without a letter or digit are no words
        ids = ids[kept]
        if (ids >= 0).sum() < GRAM:
            return []
        taken = self.findings(ids, self.candidates(ids))
        if not taken:
            return []
        places = [m.span() for m in re.finditer(r"\S+", text)]
        return [(self.names[t], m / len(self.words[t]), m, places[kept[a]][0], places[kept[b]][1]) for m, t, a, b in taken]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license_id, coverage, matched_words, span_start, span_end: a row for each finding in ``docs(doc_id, text)``."""
    import pyarrow as pa

    index = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches):
        cache: dict[str, int] = {}
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for f in index.value.scan(text or "", cache):
                    ids.append(i)
                    out.append(f)
                if len(cache) > 1 << 18:
                    cache.clear()
            cols = [*zip(*out, strict=True)] if out else [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field("doc_id").type), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                ["doc_id", "license_id", "coverage", "matched_words", "span_start", "span_end"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license_id string, coverage double, matched_words long, span_start long, span_end long")


def op6_license_scan(spark, sf_dir):
    from codeloom.llm.common import table

    return scan(table(spark, sf_dir, "documents"))
