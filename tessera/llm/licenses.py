"""License scans by patience alignment of texts with license templates (operator 9)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import text_chunks, word_hashes, word_spans

# Short public notices and the usual header texts of licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-sa/4.0/"
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
}
COVERAGE = 0.8
#: A match may be spread over at most so many times the words of its template.
SPREAD = 2.0
#: License words are runs of ASCII letters and digits and of bytes above 127.
_IN_RUN = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _numbers(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in text_chunks(pa.array(texts)):
        starts, ends, bounds = word_spans(data, offsets, _IN_RUN)
        hashed = word_hashes(data, starts, ends)
        out += [hashed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _unique_at(words: list[int], low: int, high: int) -> dict[int, int]:
    at: dict[int, int] = {}
    for i in range(low, high):
        at[words[i]] = -1 if words[i] in at else i
    return {w: i for w, i in at.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending in the first) that ascends in the second too, by patience piles."""
    tops, ends, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1], ends[pile : pile + 1] = [y], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(a: list[int], alow: int, ahigh: int, b: list[int], blow: int, bhigh: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a gap in which no word is unique in both, by the usual table."""
    rows = np.zeros((ahigh - alow + 1, bhigh - blow + 1), np.int32)
    right = np.array(b[blow:bhigh])
    for i in range(ahigh - alow - 1, -1, -1):
        hit = np.where(right == a[alow + i], rows[i + 1, 1:] + 1, rows[i + 1, :-1])
        rows[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < ahigh - alow and j < bhigh - blow:
        if a[alow + i] == b[blow + j]:
            out.append((alow + i, blow + j))
            i, j = i + 1, j + 1
        elif rows[i + 1, j] >= rows[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of template a and text b: words unique to both, in their longest rising run, are anchors; the
    gaps between them are aligned in the same way, after equal words at their ends; a gap without anchors by its longest common subsequence."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        alow, ahigh, blow, bhigh = open_.pop()
        while alow < ahigh and blow < bhigh and a[alow] == b[blow]:
            out.append((alow, blow))
            alow, blow = alow + 1, blow + 1
        while alow < ahigh and blow < bhigh and a[ahigh - 1] == b[bhigh - 1]:
            ahigh, bhigh = ahigh - 1, bhigh - 1
            out.append((ahigh, bhigh))
        if alow == ahigh or blow == bhigh:
            continue
        in_a, in_b = _unique_at(a, alow, ahigh), _unique_at(b, blow, bhigh)
        anchors = _rising(sorted((i, in_b[w]) for w, i in in_a.items() if w in in_b))
        if not anchors:
            out += _common(a, alow, ahigh, b, blow, bhigh)
            continue
        out += anchors
        for (a0, b0), (a1, b1) in zip([(alow - 1, blow - 1), *anchors], [*anchors, (ahigh, bhigh)], strict=True):
            if a1 - a0 > 1 and b1 - b0 > 1:
                open_.append((a0 + 1, a1, b0 + 1, b1))
    return sorted(out)


def _windows(words: list[int], places: list[int], template: list[int], most: float) -> Iterator[tuple[int, int, int]]:
    """(low, high, bound) of the windows of words at places fewer than `most` apart that no other window holds, in order; bound: how
    many words of the template, each as often as it occurs there, the window holds."""
    wanted = np.bincount(template).tolist()
    count, bound, high = [0] * len(wanted), 0, 0
    for low in range(len(words)):
        grown = False
        while high < len(words) and places[high] - places[low] < most:
            count[words[high]] += 1
            bound += count[words[high]] <= wanted[words[high]]
            high, grown = high + 1, True
        if grown:
            yield low, high, bound
        bound -= count[words[low]] <= wanted[words[low]]
        count[words[low]] -= 1


def _longest(at: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of words and a template, by rows of bits; at: the template's places of each word as bits."""
    every = (1 << length) - 1
    row = every
    for w in words:
        hit = row & at[w]
        row = (row + hit | row - hit) & every
    return length - row.bit_count()


def _aligned(template: list[int], words: list[int], places: list[int], needed: int) -> tuple[int, int, int]:
    """(aligned words, first place, last place) of the first window of SPREAD template lengths in which most words align, or zeros below needed.

    Each window is aligned on its own, so words outside draw nothing from it. Windows that hold too few template words, or whose longest
    common subsequence is no longer than the best so far, are passed over, which is exact.
    """
    at: dict[int, int] = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    best, met = (0, 0, 0), set()
    for low, high, bound in _windows(words, places, template, SPREAD * len(template)):
        least = max(needed, best[0] + 1)
        if bound < least:
            continue
        inside = words[low:high]
        if (mark := hash(tuple(inside))) in met:  # the same words as in an earlier window
            continue
        met.add(mark)
        longest = _longest(at, len(template), inside)
        if longest < least:
            continue
        # The shortest text that ends first and aligns as much.
        end = bisect_left(range(len(inside)), longest, key=lambda h: _longest(at, len(template), inside[:h]))
        start = bisect_right(range(end), -longest, key=lambda x: -_longest(at, len(template), inside[x:end])) - 1
        low, inside = low + start, inside[start:end]
        pairs = patience(template, inside)
        if len(pairs) < longest:
            pairs = _common(template, 0, len(template), inside, 0, len(inside))
        best = (longest, places[low + pairs[0][1]], places[low + pairs[-1][1]])
        if longest == len(template):
            break
    return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, licenses for each row of docs (doc_id, text).

    license: the template with the highest coverage (the longer, then the first by name, on ties) if that is at least
    coverage, else null with coverage 0; first_word and last_word bound it, counted from 0 in runs of letters and digits;
    licenses: all names that reach coverage, in order, comma-joined. Coverage: the part of the template's words that align within
    a window of SPREAD template lengths, each window aligned on its own (patience, or the longest common subsequence where that is longer). A template whose words occur too seldom in a text to reach coverage isn't aligned; this bound
    is exact. Words that no template holds are left out before alignment, as they can't align. Whole texts are scanned;
    null and empty texts hold no license; equal and null ids are rows like others; an empty table gives an empty result.
    """
    templates = dict(sorted((templates or TEMPLATES).items()))
    numbers = dict(zip(templates, _numbers(list(templates.values())), strict=True))
    vocabulary = np.unique(np.concatenate(list(numbers.values())))
    wanted = {name: np.searchsorted(vocabulary, n).tolist() for name, n in numbers.items()}
    counts = np.array([np.bincount(w, minlength=len(vocabulary)) for w in wanted.values()])
    needed = np.array([int(np.ceil(coverage * len(w) - 1e-9)) for w in wanted.values()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                starts, ends, bounds = word_spans(data, offsets, _IN_RUN)
                hashed = word_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
                held = np.flatnonzero(vocabulary[at] == hashed)
                cuts = np.searchsorted(held, bounds)
                present = np.zeros((high - low, len(vocabulary)), bool)
                present[np.repeat(np.arange(high - low), np.diff(cuts)), at[held]] = True
                possible = present @ counts.T >= needed
                rows = [_best(wanted, needed, possible[i], at[held[cuts[i] : cuts[i + 1]]].tolist(), (held[cuts[i] : cuts[i + 1]] - bounds[i]).tolist()) for i in range(high - low)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names=["doc_id", "license", "coverage", "first_word", "last_word", "licenses"])

    schema = "doc_id long, license string, coverage double, first_word long, last_word long, licenses string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def _best(wanted: dict[str, list[int]], needed: np.ndarray, possible: np.ndarray, words: list[int], places: list[int]) -> tuple:
    found = []
    for at, (name, template) in enumerate(wanted.items()):
        if not possible[at]:
            continue
        inside = set(template)
        kept = [i for i, w in enumerate(words) if w in inside]
        aligned, first, last = _aligned(template, [words[i] for i in kept], [places[i] for i in kept], int(needed[at]))
        if aligned >= needed[at]:
            found.append((aligned / len(template), len(template), name, first, last))
    if not found:
        return None, 0.0, None, None, ""
    best = min(found, key=lambda x: (-x[0], -x[1], x[2]))
    return best[2], best[0], best[3], best[4], ",".join(sorted(x[2] for x in found))
