"""Licence scans: Dice coefficient over word bigrams, templates pruned by size bounds.

Method. Texts and templates are normalised to lower-case ASCII words. The sets of word
bigrams of a segment and a template are compared by Dice, 2 |A and B| / (|A| + |B|).
For a threshold t only sizes with t / (2 - t) <= |A| / |B| <= (2 - t) / t can reach it,
and at least t |B| / (2 - t) bigrams must be common; other templates are not compared.
Segments are the lines of a text, its paragraphs (lines up to one without a word), the
whole text, and windows: as many words as a template has, from each place where its first
two words stand. So a notice is found inside a longer line. A segment counts for its best
template only, of equal ones the first; a window is compared with its own template.

Scale. One narrow pass without a shuffle. Bigrams are looked up in the few thousand of
all templates; sets are only built for segments that pass the bounds.

Defined results. Null and empty texts match nothing. Rows are independent, so ties,
repeated rows and missing ids need no rule. Other columns are ignored.

Coverage. The templates are the usual notices and the short full texts; the full texts of
the GNU licences, Apache, MPL, EPL and Creative Commons are known by their notices only. A
licence without a template that reads much like one gets that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varscope.llm.blocks import U, Words, blocks, find_words, mix, span_hash, text_bytes
from varscope.llm.tasks import text_rows

THRESHOLD = 0.8

# Customary notices of public licences, and the full texts of short ones.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ZERO_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_WARRANTY = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
    "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
    "distribution."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
_EPL = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/"
)
_CC0 = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
    "this software to the public domain worldwide. This software is distributed without any warranty."
)
# (name, the words of its name, version, further word before it)
_GNU = (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)
_CC = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_NAMED = (("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"))


def _templates():
    for name, words in _NAMED:
        yield name, f"Released under the {words}."
        yield name, f"Licensed under the {words}."
    yield "MIT", _MIT_GRANT
    yield "MIT", _MIT_WARRANTY
    yield "MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"
    yield "Apache-2.0", "Licensed under the Apache License, Version 2.0."
    yield "Apache-2.0", _APACHE_NOTICE
    yield "Apache-2.0", f"{_APACHE_NOTICE} {_APACHE_WARRANTY}"
    yield "BSD", _BSD_GRANT
    yield "BSD-2-Clause", f"{_BSD_GRANT} {_BSD_CONDITIONS} {_BSD_WARRANTY}"
    yield "BSD-3-Clause", f"{_BSD_GRANT} {_BSD_CONDITIONS} {_BSD_THIRD} {_BSD_WARRANTY}"
    yield "BSD", _BSD_WARRANTY
    yield "ISC", _ISC_GRANT
    yield "ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"
    yield "0BSD", _ZERO_GRANT
    yield "0BSD", f"{_ZERO_GRANT} {_ISC_WARRANTY}"
    yield "Unlicense", _UNLICENSE
    yield "Zlib", _ZLIB
    yield "MPL-2.0", _MPL
    yield "EPL-2.0", _EPL
    yield "CC0-1.0", _CC0
    yield "CC0-1.0", "Licensed under CC0 1.0 Universal."
    for name, words, version in _GNU:
        yield name, f"This work is licensed under the {words}, version {version}."
        yield name, f"Licensed under the {words}, version {version}."
        yield name, (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {words} as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
            "later version."
        )
        yield name, (
            f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {words} version {version} "
            "for more details."
        )
    for short, words in _CC:
        for version in ("4.0", "3.0"):
            name = f"CC-{short}-{version}"
            region = "International" if version == "4.0" else "Unported"
            yield name, f"Licensed under CC {short} {version}."
            yield name, f"This work is licensed under CC {short} {version}."
            yield name, f"This work is licensed under a Creative Commons {words} {version} {region} License."


TEMPLATES = tuple(_templates())

FOUND = "doc_id long, licence string, n_segments long, best_dice double"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_NO_WORD = np.ones(256, bool)
_NO_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B))] = False


def normal_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return find_words(_LOWER[data], offsets, _NO_WORD)


def bigrams(words: Words) -> np.ndarray:
    """Hash of each word with the next one."""
    if len(words) < 2:
        return np.zeros(0, U)
    h = span_hash(words.data, words.start, words.end)
    return mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])


class Templates:
    """Bigrams of all templates, and which template has which."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        data, offsets = text_bytes(pa.array([text for _, text in templates]))
        words = normal_words(data, offsets)
        grams = bigrams(words)
        inside = words.doc[:-1] == words.doc[1:]
        self.grams, number = np.unique(grams[inside], return_inverse=True)
        self.has = np.zeros((len(self.grams), len(templates)), np.int64)
        self.has[number, words.doc[:-1][inside]] = 1
        self.sizes = self.has.sum(0)
        self.lengths = words.counts()
        starts = words.first[:-1][self.lengths > 1]
        self.first, which = np.unique(grams[starts], return_inverse=True)
        self.begun_by = [np.flatnonzero(self.lengths > 1)[which == k] for k in range(len(self.first))]
        ratio = threshold / (2 - threshold)
        self.common = np.ceil(ratio * self.sizes - 1e-9)
        self.least, self.most = ratio * self.sizes - 1e-9, self.sizes / ratio + 1e-9
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.grams >> U(48)).astype(np.int64)] = True

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of bigrams that a template has, their numbers)."""
        at = np.flatnonzero(self.hint[(grams >> U(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit = self.grams[place] == grams[at]
        return at[hit], place[hit]

    def compare(self, grams: np.ndarray, at: np.ndarray, number: np.ndarray, segment: np.ndarray) -> Iterator[tuple]:
        """(a word of the segment, template, Dice) of all pairs that reach the threshold.

        ``segment`` gives each word's segment, in rising order.
        """
        whole = segment[at] == segment[at + 1]
        at, number = at[whole], number[whole]
        if not len(at):
            return
        key = np.unique(segment[at] * len(self.grams) + number)
        owner, number = np.divmod(key, len(self.grams))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        common = np.add.reduceat(self.has[number], first)
        for row in np.flatnonzero((common >= self.common).any(1)):
            lo, hi = np.searchsorted(segment, [owner[first[row]], owner[first[row]] + 1])
            size = len(np.unique(grams[lo : hi - 1]))
            able = np.flatnonzero((common[row] >= self.common) & (self.least <= size) & (size <= self.most))
            if len(able):
                dice = 2 * common[row, able] / (size + self.sizes[able])
                best = int(dice.argmax())
                if dice[best] >= self.threshold - 1e-12:
                    yield lo, able[best], dice[best]

    def windows(self, grams: np.ndarray, at: np.ndarray, number: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        """The same for windows of a template's length, where its first two words stand."""
        place = np.minimum(np.searchsorted(self.first, grams[at]), len(self.first) - 1)
        for k in np.flatnonzero(self.first[place] == grams[at]):
            begin, best = int(at[k]), (0.0, 0)
            for template in self.begun_by[place[k]]:
                end = begin + int(self.lengths[template])  # the word after the window
                if end > len(doc) or doc[end - 1] != doc[begin]:
                    continue
                inside = number[k : np.searchsorted(at, end - 1)]
                common = int(self.has[np.unique(inside), template].sum())
                if common >= self.common[template]:
                    dice = 2 * common / (len(np.unique(grams[begin : end - 1])) + self.sizes[template])
                    if dice >= self.threshold - 1e-12 and dice > best[0]:
                        best = (dice, template)
            if best[0]:
                yield begin, best[1], best[0]


def scan_block(block: pa.RecordBatch, templates: Templates) -> pa.RecordBatch:
    data, offsets = text_bytes(block.column("text"))
    words = normal_words(data, offsets)
    found: dict[tuple[int, str], list[float]] = {}
    if len(words) > 1:
        grams = bigrams(words)
        at, number = templates.lookup(grams)
        feeds = np.flatnonzero(data == 0x0A)
        line = np.searchsorted(feeds, words.start - 8) + words.doc
        # a line without words ends a paragraph
        paragraph = np.cumsum(np.concatenate([[True], (line[1:] - line[:-1] > 1) | (words.doc[1:] != words.doc[:-1])]))
        for segment in (line, paragraph, words.doc):
            for word, template, dice in templates.compare(grams, at, number, segment.astype(np.int64)):
                found.setdefault((int(words.doc[word]), templates.names[template]), []).append(float(dice))
        for word, template, dice in templates.windows(grams, at, number, words.doc):
            found.setdefault((int(words.doc[word]), templates.names[template]), []).append(float(dice))
    keys = sorted(found)
    return pa.RecordBatch.from_arrays(
        [
            block.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())),
            pa.array([name for _, name in keys], pa.string()),
            pa.array([len(found[k]) for k in keys], pa.int64()),
            pa.array([max(found[k]) for k in keys], pa.float64()),
        ],
        ["doc_id", "licence", "n_segments", "best_dice"],
    )


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, licence, n_segments, best_dice``: one row per document and licence found.

    ``n_segments`` counts the segments of which a template of that licence is the best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Templates(templates, threshold)
        for block in blocks(batches, "text"):
            yield scan_block(block, compiled)

    return text_rows(docs, doc_id, text).mapInArrow(run, FOUND)

