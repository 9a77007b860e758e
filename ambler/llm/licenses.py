"""Licence scans by Dice coefficient over word bigrams.

A text is normalised to lower-case words of letters and digits. Templates are licence
notices, headers and whole texts. A template is a candidate for a document only if size
bounds allow the threshold: a passage of n bigrams and a template of m can't reach a
coefficient d unless n and m are within a factor d / (2 - d), and enough different bigrams
of the document must be the template's. A passage of n bigrams, c of them the template's,
reaches d where 2 c - d n >= d m, so for each end the best beginning is a sliding minimum:
the search is linear in the places of the template's bigrams. In the coefficient each
bigram counts as often as it occurs in both; where a text repeats bigrams more often than
the template within a passage's reach, overlaps are counted from each beginning that may do,
so that no passage is lost. Of passages that overlap the one that shares
most bigrams with its template stays, so a whole text isn't hidden by a notice inside it.
"""

from __future__ import annotations

import pathlib
import re
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 0.8
TABLE_ENTRIES = 200_000
_FILTER = (1 << 20) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_find = re.compile(r"[^\W_]+").findall

#: Whole licence texts, a file each, named by the licence.
FOLDER = pathlib.Path(__file__).resolve().parent / "licence_texts"

_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_ENDORSEMENT = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

# Public licence notices and short texts.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", _PERMISSION, _PERMISSION + _AS_IS],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", _BSD + _NO_ENDORSEMENT + " " + _WARRANTY],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD + " " + _WARRANTY],
    "ISC": ["Released under the ISC License.", _ISC],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}
GNU = (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"))


def gnu_header(name: str, version: str) -> str:
    """The notice that is put before a program's files."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


def templates(folder: str | pathlib.Path | None = FOLDER) -> list[tuple[str, str]]:
    """(licence, text) of all templates; families that differ by number or kind come from a
    rule, whole texts from the files of ``folder``, which the driver reads."""
    found = [(k, t) for k, texts in NOTICES.items() for t in texts]
    for version in (2, 3):
        for short, name in GNU:
            found += [(f"{short}-{version}.0", f"This work is licensed under the {name}, version {version}."), (f"{short}-{version}.0", gnu_header(name, str(version)))]
    for version in ("3.0", "4.0"):
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
            found.append((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."))
    if folder is not None:
        found += [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(pathlib.Path(folder).glob("*.txt"))]
    return found


class _Words(dict):
    """Chunk between spaces to the packed hashes of its words."""

    def __missing__(self, chunk: bytes) -> bytes:
        found = self[chunk] = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in _find(chunk.decode("utf-8", "replace").lower())], np.uint64).tobytes()
        return found


_words = common.cache(__name__, _Words())


def bigrams(text: bytes) -> np.ndarray:
    if len(_words) > TABLE_ENTRIES:
        _words.clear()
    h = np.frombuffer(b"".join(map(_words.__getitem__, text.split())), np.uint64)
    return common.mix(h[:-1] * _A + h[1:] * _B)


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """Of two rows of bigrams, each counted as often as it occurs."""
    if not len(a) + len(b):
        return 0.0
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2 * int(np.minimum(n[i], m[j]).sum()) / (len(a) + len(b))


def best_passages(places: np.ndarray, m: int, least: float) -> list[tuple[int, int]]:
    """(first, last) numbers of the hits that bound a passage, best first: for each last hit
    the first one for which 2 c - least n is largest, where it is at least least m. A
    passage has m hits at most, as more can't all be the template's, and
    m (2 - least) / least places at most."""
    longest = m * (2 - least) / least
    window: deque[tuple[float, int]] = deque()
    found = []
    for j, p in enumerate(places.tolist()):
        key = 2 * j - least * p
        while window and window[-1][0] >= key:
            window.pop()
        window.append((key, j))
        while j - window[0][1] >= m or p - places[window[0][1]] + 1 > longest:
            window.popleft()
        value = 2 * (j + 1) - least * (p + 1) - window[0][0]
        if value >= least * m - 1e-9:
            found.append((-value, window[0][1], j))
    return [(i, j) for _, i, j in sorted(found)]


def counted_passages(places: np.ndarray, earlier: np.ndarray, m: int, least: float) -> list[tuple[int, int]]:
    """The same where hits repeat, so that some don't count: for each first hit the last one
    for which 2 c - least n is largest. A hit counts in the passages that begin after
    ``earlier``, the hit since which its bigram has occurred as often as in the template."""
    number = np.arange(len(places))
    ends = np.searchsorted(places, places + m * (2 - least) / least - 1 + 1e-9, "right")
    # if all hits counted and no passage were too long
    most = np.maximum.accumulate((2 * number - least * places)[::-1])[::-1] - (2 * number - least * places) + 2 - least
    found = []
    for i in np.flatnonzero(most >= least * m - 1e-9).tolist():
        own = slice(i, int(ends[i]))
        value = 2 * np.cumsum(earlier[own] < i) - least * (places[own] - places[i] + 1)
        j = int(value.argmax())
        if value[j] >= least * m - 1e-9:
            found.append((-float(value[j]), i, i + j))
    return [(i, j) for _, i, j in sorted(found)]


class Scanner:
    def __init__(self, texts: list[tuple[str, str]], least: float = LEAST):
        self.names, self.least = [n for n, _ in texts], least
        self.rows = [bigrams(t.encode()) for _, t in texts]
        self.all = np.unique(np.concatenate(self.rows)) if texts else np.zeros(0, np.uint64)
        self.times = np.array([np.bincount(np.searchsorted(self.all, r), minlength=len(self.all)) for r in self.rows], np.int32).reshape(len(texts), len(self.all))
        self.size = np.array([len(r) for r in self.rows], np.int64)
        # with n >= c, 2 c / (n + m) >= least needs c >= least m / (2 - least)
        self.need = np.maximum(1, np.ceil(least * self.size / (2 - least) - 1e-9)).astype(np.int64)
        self.seen = np.zeros(_FILTER + 1, bool)
        self.seen[(self.all & np.uint64(_FILTER)).astype(np.int64)] = True

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, words) of the licences in a text, by place."""
        grams = bigrams(text)
        at = np.flatnonzero(self.seen[(grams & np.uint64(_FILTER)).astype(np.int64)])
        if not len(at):
            return []
        which = np.minimum(np.searchsorted(self.all, grams[at]), len(self.all) - 1)
        true = self.all[which] == grams[at]
        at, which = at[true], which[true]
        if not len(at):
            return []
        ratio = self.least / (2 - self.least)
        used, n = np.unique(which, return_counts=True)
        enough = np.minimum(self.times[:, used], n).sum(1) >= self.need
        found = []
        for k in np.flatnonzero(enough & (self.size > 0) & (len(grams) >= ratio * self.size - 1e-9)).tolist():
            own = self.times[k, which] > 0
            found += [(d, k, s, n) for d, s, n in self._passages(k, grams, at[own], which[own])]
        shared = lambda r: round(r[0] * (r[3] + self.size[r[1]]) / 2)
        found.sort(key=lambda r: (-shared(r), -r[0], r[1], r[2]))
        kept = []
        for d, k, s, n in found:
            if all(s + n <= s2 or s2 + n2 <= s for _, _, s2, n2 in kept):
                kept.append((d, k, s, n))
        return [(self.names[k], d, s, n + 1) for d, k, s, n in sorted(kept, key=lambda r: r[2])]

    def _passages(self, k: int, grams: np.ndarray, hits: np.ndarray, which: np.ndarray):
        """(coefficient, first bigram, bigrams) of a template's passages, none over another."""
        order = np.argsort(which, kind="stable")
        before = np.arange(len(hits)) - self.times[k, which[order]]
        same = (before >= 0) & (which[order[before]] == which[order])
        earlier = np.full(len(hits), -1)
        earlier[order[same]] = order[before[same]]
        longest = self.size[k] * (2 - self.least) / self.least + 1e-9
        # a hit that some passage may hold beside as many of its bigram as the template has
        over = (earlier >= 0) & (hits - hits[earlier] < longest)
        free, found = np.ones(len(hits), bool), []
        while True:
            more = False
            # hits between passages already found are searched apart from each other
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for x, y in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
                if y - x < self.need[k]:
                    continue
                size, repeats = int(self.size[k]), (earlier[x:y][over[x:y]] >= x).any()
                # the first is fast, the second also finds a passage of exactly the greatest length
                passages = [] if repeats else best_passages(hits[x:y], size, self.least)
                passages = passages or counted_passages(hits[x:y], earlier[x:y] - x, size, self.least)
                for i, j in passages:
                    if not (free[x + i] and free[x + j] and free[x + i : x + j + 1].all()):
                        continue
                    first, last = int(hits[x + i]), int(hits[x + j])
                    d = dice(grams[first : last + 1], self.rows[k])
                    if d >= self.least:
                        found.append((d, first, last - first + 1))
                        free[x + i : x + j + 1] = False
                        more = True
            if not more:
                return found


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row for each licence passage of a document: doc_id, license_id, dice,
    first_word, n_words.

    Documents without a licence, null and empty texts have no row; a row with a null
    doc_id keeps its null id; repeated rows give repeated results. Of templates that
    share equally much with a passage that of the highest coefficient, then the first, is named.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    scanner = spark.sparkContext.broadcast(Scanner(templates() if texts is None else texts, least))  # as large as the given templates

    def run(batches):
        common.only(__name__)
        for b in batches:
            rows = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), common.byte_texts(b.column(1)), strict=True) for m in scanner.value.scan(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "license_id", "dice", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license_id string, dice double, first_word long, n_words long")
