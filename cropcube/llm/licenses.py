"""License scans: winnowed fingerprints pick candidates, a banded alignment reports coverage and spans.

Templates (and any number of variants of each) become words; every K consecutive words have a fingerprint, and of each WINDOW
neighbouring fingerprints the least is kept (winnowing), so any run of K + WINDOW - 1 equal words shares a kept one. The inverted index
maps a kept fingerprint to (template, place). A template of fewer words than that keeps all its fingerprints, of as many words as it
has if those are fewer than K.

A text's fingerprints are looked up as they stream by (all of them, so that no winnowing of the text can miss a template's kept
one). Hits of one template on near diagonals are a candidate stretch; a banded global alignment of the template against
the words around it gives the matched words. Coverage is matched / template words; matches from ``least`` on are reported with their
byte span, best first where they overlap. What is left of a stretch beside reported spans is aligned again until nothing reaches
``least``, so of a notice that is repeated every copy is reported.

The index is built from the templates, the stated query set: their number of words is checked against MOST_WORDS, and more are
scanned in blocks; they are a list or a table (columns license, text). Map-only. Nulls and blank texts match nothing, texts of any
length are scanned whole, null and blank templates are skipped; rows are judged one by one, repeated rows alike, and an empty table gives
no rows. Of matches that tie, the one with more words wins, then the better covered template, the narrower, the earlier one and the
first name. Columns of the names used are replaced.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropcube.llm import kernels as K
from cropcube.session import ship

GRAM = 3
WINDOW = 4
BAND = 16
LEAST = 0.8
MOST_WORDS = 500_000

# License templates and notices, as they are commonly written.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without'
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        ' Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR'
        " PURPOSE AND NONINFRINGEMENT.",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of"
        " the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "bsd-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the"
        " above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "mpl-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "gpl-2.0-notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of"
        " the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl-2.1-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either"
        " version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        ' appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
        " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is"
        " granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin"
        " of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation"
        " would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not"
        " be removed or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form"
        " or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use,"
        " reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ),
    (
        "bsd-disclaimer",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY'
        " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
        " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY"
        " OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF"
        " SUCH DAMAGE.",
    ),
    (
        "bsd-3-endorsement",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced without permission."),
)


def words_of(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters, and their byte spans."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = K.word_bounds(raw, np.array([0, len(raw)]), K.ALNUM)
    data = raw.tobytes().lower()
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return [data[a:b] for a, b in spans], spans


def grams_of(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) < k:
        return hashes[:0]
    out, _ = K.shingles(hashes, np.array([0, len(hashes)]), k)
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of every ``window`` neighbours (the last of equal ones)."""
    if len(grams) <= window:
        return np.arange(len(grams)) if len(grams) < window else np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))])
    rows = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows[:, ::-1], axis=1))


@dataclass
class Index:
    """Kept fingerprints, sorted, with the template and place of each; by the words of a fingerprint."""

    names: list[str]
    words: list[list[bytes]]
    keys: dict[int, np.ndarray]
    where: dict[int, np.ndarray]

    @classmethod
    def of(cls, templates: list[tuple[str, str]], gram: int = GRAM, window: int = WINDOW) -> Index:
        names, words = [], []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for name, text in templates:
            w, _ = words_of(text)
            if not w:
                continue
            t = len(names)
            names.append(name)
            words.append(w)
            k = min(gram, len(w))
            g = grams_of(hashed(w), k)
            for p in (winnowed(g, window) if len(w) >= gram + window - 1 else np.arange(len(g))).tolist():
                found.setdefault(k, []).append((int(g[p]), t, p))
        keys, where = {}, {}
        for k, rows in found.items():
            rows.sort()
            keys[k] = np.array([r[0] for r in rows], np.uint64)
            where[k] = np.array([r[1:] for r in rows], np.int64)
        return cls(names, words, keys, where)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, template, place in it) of every kept fingerprint in the texts whose words these are."""
        at, template, place = [], [], []
        count = np.diff(first)
        for k, keys in self.keys.items():
            g, begin = K.shingles(hashes, first, k)
            if not len(g):
                continue
            lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            sel = np.flatnonzero(hi > lo)
            if not len(sel):
                continue
            doc = np.searchsorted(begin, sel, "right") - 1
            ok = count[doc] >= k  # a shorter text's one fingerprint is of fewer words
            sel, doc = sel[ok], doc[ok]
            n = (hi - lo)[sel]
            row = np.repeat(lo[sel], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at.append(np.repeat(first[doc] + sel - begin[doc], n))
            template.append(self.where[k][row, 0])
            place.append(self.where[k][row, 1])
        if not at:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(at), np.concatenate(template), np.concatenate(place)


def hashed(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    return K.span_hashes(raw, ends - size, ends)


def aligned(template: list[bytes], text: list[bytes], diagonal: int, band: int, low: int = 0, high: int | None = None) -> tuple[int, int, int]:
    """Most equal words of a global alignment of the template within ``band`` of a diagonal: (matched, first, last + 1 word matched).

    The template's word i stands against text words i + diagonal - band to i + diagonal + band, those from ``low`` to before ``high``.
    Skips are free on either side; of equally many matches the one with the narrowest span in the text wins, then the first.
    """
    width = 2 * band + 1
    high = len(text) if high is None else high
    # best[c] = (matched, first matched text word; the latest of equally many) up to text word i + diagonal - band + c
    best: list[tuple[int, int]] = [(0, -1)] * (width + 1)
    # (matched, less the span, less the first word)
    found, last = (0, 0, 1), -1
    for i, w in enumerate(template):
        row: list[tuple[int, int]] = []
        base = i + diagonal - band
        left = (0, -1)
        for c in range(width):
            j = base + c
            cell = max(best[c + 1], left)
            if low <= j < high and text[j] == w:
                m, f = best[c]
                hit = (m + 1, j if m == 0 else f)
                if (hit[0], hit[1] - j, -hit[1]) > found:
                    found, last = (hit[0], hit[1] - j, -hit[1]), j
                cell = max(cell, hit)
            row.append(cell)
            left = cell
        best = [*row, (0, -1)]
    return found[0], -found[2], last + 1


def stretches(index: Index, at: np.ndarray, template: np.ndarray, place: np.ndarray, words: list[bytes], band: int, least: float) -> list[tuple[str, int, int, int, int]]:
    """(template, matched, its words, first, end word) of one text: the matches of all candidate stretches, without overlaps.

    The best match is reported first; what it leaves of the words around a diagonal is aligned again, where it is long enough.
    """
    heap: list[tuple] = []

    def push(t: int, diagonal: int, low: int, high: int) -> None:
        size = len(index.words[t])
        low, high = max(low, diagonal - band), min(high, diagonal + size + band)
        if high - low >= least * size:
            m, f, e = aligned(index.words[t], words, diagonal, band, low, high)
            if m and m >= least * size:
                heappush(heap, (-m, -m / size, e - f, f, index.names[t], t, diagonal, low, high))

    order = np.lexsort((at, at - place, template))
    t, d, a = template[order], (at - place)[order], at[order]
    i, step = 0, max(1, band // 2)  # every hit is within half a step of an aligned diagonal
    todo: set[tuple[int, int]] = set()
    while i < len(t):
        j = i + 1
        while j < len(t) and t[j] == t[i] and d[j] - d[j - 1] <= band // 2:
            j += 1
        size = len(index.words[t[i]])
        # hits on near diagonals, but far apart in the text, are several stretches
        group = np.argsort(a[i:j], kind="stable") + i
        cut = [0, *(np.flatnonzero(np.diff(a[group]) > size + band) + 1).tolist(), len(group)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            part = group[x:y]
            todo |= {(int(t[i]), int(v) * step) for v in np.unique((d[part] + step // 2) // step)}
        i = j
    for k, v in sorted(todo):
        push(k, v, 0, len(words))
    # by first word
    out: list[tuple[str, int, int, int, int]] = []
    starts: list[int] = []
    while heap:
        m, _, width, f, name, k, v, low, high = heappop(heap)
        n = bisect(starts, f)
        if (n == 0 or out[n - 1][4] <= f) and (n == len(out) or starts[n] >= f + width):
            out.insert(n, (name, -m, len(index.words[k]), f, f + width))
            starts.insert(n, f)
        n = max(0, bisect(starts, low) - 1)
        while n < len(out) and starts[n] < high:
            if out[n][4] > low:
                push(k, v, low, starts[n])
                low = out[n][4]
            n += 1
        push(k, v, low, high)
    return out


MATCH = "array<struct<license: string, matched: long, words: long, coverage: double, start: long, end: long>>"


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, text_col: str = "text", least: float = LEAST, band: int = BAND, gram: int = GRAM, window: int = WINDOW, keep: list[str] | None = None
) -> DataFrame:
    """``docs``' columns ``keep`` (all if None) and ``licenses``: what is found, by place; a column of this name is replaced."""
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "licenses"]
    if isinstance(templates, DataFrame):
        templates = [(r.license, r.text) for r in templates.where("license IS NOT NULL").select("license", "text").orderBy("license", "text").toLocalIterator()]
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, text in templates:
        n = len(words_of(text)[0])
        if blocks[-1] and size + n > MOST_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((name, text))
        size += n
    df = docs.select(*dict.fromkeys([*keep, text_col]))
    kind = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    for b, block in enumerate(blocks):
        index = Index.of(block, gram, window)
        cols = keep if b == len(blocks) - 1 else df.columns[: len(dict.fromkeys([*keep, text_col]))]

        def run(batches, index=index, cols=cols, more=b > 0):
            for batch in batches:
                raw, offsets = K.texts_of(batch.column(batch.schema.get_field_index(text_col)))
                out = batch.column(batch.schema.get_field_index("licenses")).to_pylist() if more else [[] for _ in range(batch.num_rows)]
                for i, j in K.groups(offsets):
                    base = offsets[i : j + 1] - offsets[i]
                    part = raw[offsets[i] : offsets[j]]
                    starts, ends, first = K.word_bounds(part, base, K.ALNUM)
                    if not len(starts):
                        continue
                    at, template, place = index.hits(K.span_hashes(part, starts, ends), first)
                    doc = np.searchsorted(first, at, "right") - 1
                    for d in np.unique(doc).tolist():
                        sel = doc == d
                        a, e = int(first[d]), int(first[d + 1])
                        words = [part[x:y].tobytes().lower() for x, y in zip(starts[a:e].tolist(), ends[a:e].tolist(), strict=True)]
                        for name, m, n, f, z in stretches(index, at[sel] - a, template[sel], place[sel], words, band, least):
                            out[i + d].append(
                                {"license": name, "matched": m, "words": n, "coverage": m / n, "start": int(starts[a + f] - base[d]), "end": int(ends[a + z - 1] - base[d])}
                            )
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in cols] + [pa.array(out, kind)], [*cols, "licenses"])

        schema = T.StructType([docs.schema[c] for c in cols] + T.StructType.fromDDL(f"licenses {MATCH}").fields)
        df = df.mapInArrow(run, schema)
    return df.select(*keep, F.col("licenses"))
