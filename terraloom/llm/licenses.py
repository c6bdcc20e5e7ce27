"""Licence notices in texts, by the Dice coefficient of word bigrams.

Texts and templates are normalised alike: lower case, words of letters, digits and
dots, British spelling made American.  Bigrams that occur in a template are looked
up in a hash table, and all spans from one of a template's bigrams to another are
compared with the template: 2 * shared / (bigrams of the span + bigrams of the
template).  A span is followed as long as its size allows MIN_DICE, and only where its
outer bigrams occur in it once, as it is no better than a shorter one otherwise.

The templates are a fixed list, so their table is of fixed size on each executor.
Null and empty texts hold no licence; each of equal notices in a text is reported,
with the best template for its span (the first in order of name, if two are as good).
Repeated rows are each scanned; an empty table gives an empty result; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.shingles import slices, windows

MIN_DICE = 0.8
FILTER_BITS = 20
MATCHES = "doc_id long, license string, dice double, first_word long, n_words long"

#: Short notices and whole texts of common licences, by their public names.
#: Of the licences that run over pages it is their standard notices that texts carry.
_PARTIES = 'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def _gnu(name: str, version: str, later: bool) -> str:
    """The standard notice of a GNU licence."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/."


TEMPLATES = {
    "0bsd": [f"{_ISC}. {_ISC_END}"],
    "agpl-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("Affero General Public License", "3", False)],
    "agpl-3.0-or-later": [_gnu("Affero General Public License", "3", True)],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", _APACHE],
    "bsd": ["Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD],
    "bsd-2-clause": [f"{_BSD} THIS SOFTWARE IS PROVIDED BY {_PARTIES}"],
    "bsd-3-clause": [f"{_BSD} {_BSD_NAMES}", f"{_BSD} {_BSD_NAMES} THIS SOFTWARE IS PROVIDED BY {_PARTIES}"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", _gnu("General Public License", "2", False)],
    "gpl-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", _gnu("General Public License", "2", True)],
    "gpl-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", _gnu("General Public License", "3", False)],
    "gpl-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", _gnu("General Public License", "3", True)],
    "isc": [f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"],
    "lgpl-2.1-or-later": [_gnu("Lesser General Public License", "2.1", True)],
    "lgpl-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("Lesser General Public License", "3", False)],
    "lgpl-3.0-or-later": [_gnu("Lesser General Public License", "3", True)],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_MIT_END}"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        + _MIT_END,
    ],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."],
}

_APART = re.compile(r"[^\w.]+|_|\.(?!\w)|(?<!\w)\.")


def normal_words(raw: str) -> str:
    """A white-space word's normal form; marks inside it are taken out."""
    word = _APART.sub("", raw).lower()
    return word.replace("licence", "license")


def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bigrams from each normal word on, and each text's word offsets."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    flat, bounds = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    coded = flat.dictionary_encode()
    words = [normal_words(w) for w in coded.dictionary.to_pylist()]
    digest = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    at = coded.indices.to_numpy(zero_copy_only=False)
    full = np.fromiter(map(bool, words), bool, len(words))[at]
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds].astype(np.int64)
    return windows(digest[at[full]], 2), bounds


def _neighbours(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bigram was last (-1: nowhere) and is next (the length: nowhere)."""
    order = np.argsort(grams, kind="stable")
    equal = grams[order[1:]] == grams[order[:-1]]
    before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
    before[order[1:][equal]] = order[:-1][equal]
    after[order[:-1][equal]] = order[1:][equal]
    return before, after


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        named = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        self.names = [n for n, _ in named]
        grams, at = _bigrams(pa.array([t for _, t in named], pa.string()))
        self.sets = [frozenset(grams[a : b - 1].tolist()) for a, b in zip(at, at[1:])]
        self.having: dict[int, list[int]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            for g in s:
                self.having[g].append(k)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[np.array(list(self.having), np.uint64) >> np.uint64(64 - FILTER_BITS)] = True

    def spans(self, before: np.ndarray, after: np.ndarray, hits: np.ndarray, k: int, end: int, least: float) -> Iterator[tuple[float, int, int, int]]:
        """(dice, k, first, last) of the spans that reach ``least``.  hits: where the
        template's bigrams are; before, after: where each bigram was last, is next."""
        own = len(self.sets[k])
        at_least, at_most = own * least / (2 - least) - 1e-9, own * (2 - least) / least + 1e-9
        hit = np.zeros(end - hits[0], bool)
        hit[hits - hits[0]] = True
        for lo in hits.tolist():
            stop, size = min(int(after[lo]), end), 2 * own
            while True:  # until so many bigrams rule out what is longer
                hi = min(lo + size, stop)
                new = before[lo:hi] < lo
                distinct = np.cumsum(new)
                if hi == stop or distinct[-1] > at_most:
                    break
                size *= 2
            n = int(np.searchsorted(distinct, at_most, "right"))
            shared_new = new[:n] & hit[lo - hits[0] : lo - hits[0] + n]
            shared = np.cumsum(shared_new)
            if not n or shared[-1] < at_least:
                continue
            dice = 2 * shared / (distinct[:n] + own)
            for j in np.flatnonzero(shared_new & (dice >= least)).tolist():
                yield float(dice[j]), k, lo, lo + j

    def scan(self, column: pa.Array, least: float) -> Iterator[tuple[int, str, float, int, int]]:
        """(row, licence, dice, first word, words) of each notice."""
        grams, at = _bigrams(column)
        if not len(grams):
            return
        near = np.flatnonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)])
        row = np.searchsorted(at, near, "right") - 1
        near, row = near[near + 1 < at[row + 1]], row[near + 1 < at[row + 1]]
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, r, g in zip(near.tolist(), row.tolist(), grams[near].tolist()):
            for k in self.having.get(g, ()):
                hits[r, k].append(p)
        found: dict[int, list[tuple[float, int, int, int]]] = defaultdict(list)
        links: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (r, k), ps in hits.items():
            if len(ps) < (need := len(self.sets[k]) * least / (2 - least) - 1e-9) or len(set(grams[ps].tolist())) < need:
                continue
            lo, end = int(at[r]), int(at[r + 1]) - 1
            if r not in links:
                links[r] = _neighbours(grams[lo:end])
            before, after = links[r]
            local = np.array(ps, np.int64) - lo
            found[r] += [(d, k, a + lo, b + lo) for d, k, a, b in self.spans(before, after, local, k, end - lo, least)]
        for r in sorted(found):
            taken: list[tuple[int, int]] = []
            for d, k, lo, hi in sorted(found[r], key=lambda x: (-x[0], x[2] - x[3], self.names[x[1]], x[2])):
                if all(hi < a or lo > b for a, b in taken):
                    taken.append((lo, hi))
                    yield r, self.names[k], d, lo - int(at[r]), hi + 2 - lo


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = MIN_DICE) -> DataFrame:
    """MATCHES: one row for each licence notice of each document."""
    known = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                rows = [(ids[r].as_py(), *rest) for r, *rest in known.value.scan(part.column("text"), least)]
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MATCHES)
