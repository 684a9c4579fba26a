"""License scans: Dice coefficient over word bigrams against normalised templates.

A text is normalised (letters lowered; all but letters, digits and dots between digits
dropped) and cut into units: the whole text, each of its lines, and windows of words, since
notices sit inside longer texts, over several lines or within one. For a unit with ``u`` distinct bigrams and a template with ``t``,
Dice is ``2 common / (u + t)``. Two bounds prune templates, both without loss:

* size: Dice can reach ``d`` only when ``t d / (2 - d) <= u <= t (2 - d) / d``; templates
  are kept in order of size and a unit meets only that range;
* missing bigrams: a match holds at least ``t d / (2 - d)`` of the template's bigrams, so
  it holds one of any larger set than it may miss. Words touching such a set are the
  template's keys; a text without a key of any template ends there, and windows are
  sought only for templates with a key, and with enough of their bigrams, in the text.

Windows: for each template and each word it may begin at, the window of best Dice (the
shortest if several) is found exactly, by the order in which distinct bigrams first occur
from there; a best window begins and ends with bigrams of the template. Of all windows
that reach the threshold, the best stay (smaller names, then earlier windows first) that
share no word with a better one. A window is listed only where it says more than the
units around it: not if a line that shares a word with it, or the whole text as the same
template, matches as well or better.

Templates are a parameter, at most ``MOST_TEMPLATES``, and travel with the closure.
Nothing is shuffled: a document's matches depend on its text alone.

Defined cases: null and empty texts and units of under two words match nothing; equal
scores go to the smaller template name; each row gives one row; extra columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.llm.common import read

THRESHOLD = 0.8
MOST_TEMPLATES = 5_000
DROPPED = re.compile(r"[^\w.]+|_|(?<![0-9])\.|\.(?![0-9])")

# Public licence notices by SPDX name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "BSL-1.0-notice": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to "
        "<https://unlicense.org>"
    ),
}

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS "
    "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
#: The headers of the GNU licences differ in name and version.
_GNU = TEMPLATES["GPL-3.0"]
TEMPLATES |= {
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(_THIRD),
    "GPL-2.0": _GNU.replace("is free software:", "is free software;").replace("version 3", "version 2"),
    "AGPL-3.0": _GNU.replace("General", "Affero General"),
    "LGPL-3.0": _GNU.replace("General", "Lesser General"),
    "LGPL-2.1": (
        _GNU.replace("This program", "This library").replace("is free software:", "is free software;")
        .replace("General", "Lesser General").replace("version 3", "version 2.1")
    ),
}


def normalised_words(text: str) -> list[str]:
    return DROPPED.sub(" ", text.lower()).split()


def bigrams(words: list[str]) -> set:
    return set(zip(words, words[1:]))


class Templates:
    """Templates in order of size, with their size ranges and key words."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD):
        if len(texts) > MOST_TEMPLATES:
            raise ValueError(f"at most {MOST_TEMPLATES} templates")
        self.threshold = threshold
        self.least = threshold / (2 - threshold)
        self.rows = sorted((len(g), name, g) for name, text in texts.items() if (g := bigrams(normalised_words(text))))
        self.sizes = [size for size, _, _ in self.rows]
        self.by_key: dict[str, list[int]] = {}
        for number, (_, _, grams) in enumerate(self.rows):
            for key in self._keys(grams):
                self.by_key.setdefault(key, []).append(number)
        self.keys = tuple(sorted(self.by_key))

    def _keys(self, grams: set) -> list[str]:
        """Longest words first, until they touch more bigrams than a match may miss."""
        may_miss = len(grams) - self.least * len(grams)
        touched, keys = set(), []
        for word in sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w)):
            if len(touched) > may_miss:
                break
            keys.append(word)
            touched |= {g for g in grams if word in g}
        return keys

    def best(self, unit: str):
        """(dice, template) of the best template of one unit, or None."""
        grams = bigrams(normalised_words(unit))
        if not grams:
            return None
        low = bisect_left(self.sizes, len(grams) * self.least - 1e-9)
        high = bisect_right(self.sizes, len(grams) / self.least + 1e-9)
        found = []
        for size, name, template in self.rows[low:high]:
            dice = 2 * len(grams & template) / (len(grams) + size)
            if dice >= self.threshold:
                found.append((-dice, name))
        return min(found) if found else None

    def windows(self, words: list[str]) -> list[tuple]:
        """(-dice, template, first word, end) of the best windows of ``words`` without common words."""
        text = list(zip(words, words[1:]))
        known = set(text)
        numbers = {n for key in self.by_key.keys() & set(words) for n in self.by_key[key]}
        found = []
        for number in numbers:
            size, name, template = self.rows[number]
            if len(template & known) < size * self.least - 1e-9:
                continue
            most = int(size / self.least + 1e-9)
            # Distinct bigrams in order of their first place from ``at`` on, the last one first.
            ahead: dict = {}
            for at in range(len(text) - 1, -1, -1):
                ahead.pop(text[at], None)
                ahead[text[at]] = at
                if text[at] not in template:
                    continue
                common, best, end = 0, 0.0, 0
                for n, gram in enumerate(islice(reversed(ahead), most), 1):
                    if gram in template:
                        common += 1
                        if (dice := 2 * common / (n + size)) > best:
                            best, end = dice, ahead[gram] + 2
                if best >= self.threshold:
                    found.append((-best, name, at, end))
        kept, begins = [], []
        for window in sorted(found):
            place = bisect_left(begins, window[2:])
            if (place == 0 or begins[place - 1][1] <= window[2]) and (place == len(begins) or window[3] <= begins[place][0]):
                begins.insert(place, window[2:])
                kept.append(window)
        return kept

    def scan(self, text: str) -> list[tuple]:
        """(unit, template, dice): unit 0 is the whole text, then its lines from 1; -n is a window from the n-th word."""
        lowered = text.lower()
        if not any(key in lowered for key in self.keys):
            return []
        lines = text.split("\n")
        units = [(0, text)] + (list(enumerate(lines, 1)) if len(lines) > 1 else [])
        out = []
        for number, unit in units:
            lowered = unit.lower()
            if any(key in lowered for key in self.keys) and (best := self.best(unit)):
                out.append((number, best[1], -best[0]))
        windows = self.windows(normalised_words(text))
        if windows:
            ends = list(accumulate(len(normalised_words(line)) for line in lines))
            spans = [(ends[u - 1] - len(normalised_words(lines[u - 1])), ends[u - 1], d) for u, _, d in out if u]
            whole = {name: d for u, name, d in out if not u}
            for worse, name, begin, end in sorted(windows, key=lambda w: w[2]):
                known = whole.get(name, 0.0) >= -worse or any(a < end and begin < b and d >= -worse for a, b, d in spans)
                if not known:
                    out.append((-1 - begin, name, -worse))
        return out


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, license and dice of the best match, matches (unit, license, dice)."""
    templates = Templates(TEMPLATES if texts is None else texts, threshold)
    match = pa.list_(pa.struct([("unit", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))
    schema = "doc_id long, n_matches long, license string, dice double, matches array<struct<unit:long,license:string,dice:double>>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [templates.scan(t or "") for t in part.column(1).to_pylist()]
                best = [min(((-d, name) for _, name, d in f), default=(None, None)) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(list(map(len, found)), pa.int64()),
                        pa.array([name for _, name in best], pa.string()),
                        pa.array([None if d is None else -d for d, _ in best], pa.float64()),
                        pa.array([[dict(zip(("unit", "license", "dice"), m)) for m in f] for f in found], match),
                    ],
                    ["doc_id", "n_matches", "license", "dice", "matches"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    named = F.transform("matches", lambda m: F.concat(m["unit"].cast("string"), F.lit(":"), m["license"]))
    return found.select("doc_id", "n_matches", "license", F.round("dice", 9).alias("dice"), F.array_join(named, ",").alias("matches"))
