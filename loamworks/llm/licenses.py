"""Operator 8: licence scans by the Dice coefficient over word bigrams.

A stretch of text is normalised to lower-case words and compared to licence templates: twice the number of shared distinct bigrams
over the sum of both numbers. With sizes a and b the coefficient is at most 2 min(a, b) / (a + b), so a template of size b needs
least * b / (2 - least) shared bigrams: templates of which the whole text has fewer are pruned, and stretches beyond the sizes that
leave a chance are never compared.

For the templates that remain, a window of the template's number of words slides over the words of the whole text, with counts kept
for entering and leaving bigrams; so a notice is found within longer lines, wrapped over lines and beside other text. Lines,
paragraphs between empty lines and the whole text are compared as well, for notices that were shortened or extended.

A match is a stretch and its best template (ties: first by name); of spans that overlap the one with the higher coefficient
stays, of equal ones the longer, then the first.

Templates are the common short licences in full and the notices by which the longer ones are applied; ``read_templates`` reads
more, such as full texts of the GPL, from a folder of text files.

Defined cases: null and empty texts have no match; texts of fewer than two words have none; repeated rows give repeated results;
columns named like an output are replaced, all others stay; an empty table gives an empty table; texts of any length are scanned
whole.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, without

LEAST = 0.8
WORD = re.compile(r"[A-Za-z0-9]+")
# Licences as published, and the notices by which the licences' own texts say they should be applied.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_AS_IS),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{BSD_CONDITIONS} {BSD_AS_IS}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{BSD_CONDITIONS} {BSD_THIRD} {BSD_AS_IS}"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_AS_IS}"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def read_templates(folder: str) -> tuple[tuple[str, str], ...]:
    """Name and text of each file of a folder, to be added to TEMPLATES."""
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            out.append((name, f.read()))
    return tuple(out)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def bigrams(text: str) -> set[tuple[str, str]]:
    words = words_of(text)
    return set(zip(words, words[1:]))


class Index:
    """Templates by their bigrams."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.names, self.least = [n for n, _ in templates], least
        self.words = [len(words_of(t)) for _, t in templates]
        self.grams = [bigrams(t) for _, t in templates]
        self.sizes = [len(g) for g in self.grams]
        self.of: dict[tuple[str, str], list[int]] = {}
        for i, g in enumerate(self.grams):
            for x in g:
                self.of.setdefault(x, []).append(i)
        self.bound = least / (2 - least)

    def possible(self, grams: set[tuple[str, str]]) -> list[int]:
        """Templates of which a text with these bigrams has enough for some stretch of it."""
        shared: Counter = Counter()
        for x in grams:
            if x in self.of:
                shared.update(self.of[x])
        return [i for i, k in shared.items() if k >= self.bound * self.sizes[i]]

    def dice(self, grams: set[tuple[str, str]], template: int) -> float:
        n = len(grams)
        if 2 * min(n, self.sizes[template]) < self.least * (n + self.sizes[template]):
            return 0.0
        return 2 * len(grams & self.grams[template]) / (n + self.sizes[template])

    def best(self, text: str) -> tuple[float, str] | None:
        """The coefficient of a whole text with its best template."""
        grams = bigrams(text)
        found = [(d, self.names[i]) for i in self.possible(grams) if (d := self.dice(grams, i)) >= self.least]
        return min(found, key=lambda f: (-f[0], f[1])) if found else None

    def windows(self, grams: list[tuple[str, str]], template: int) -> Iterator[tuple[int, float]]:
        """First bigram and coefficient of windows of the template's size that reach the least one."""
        width, known, size = min(self.words[template] - 1, len(grams)), self.grams[template], self.sizes[template]
        counts: Counter = Counter()
        distinct = shared = 0
        for at, x in enumerate(grams):
            counts[x] += 1
            if counts[x] == 1:
                distinct += 1
                shared += x in known
            if at >= width:
                y = grams[at - width]
                counts[y] -= 1
                if not counts[y]:
                    distinct -= 1
                    shared -= y in known
            if at >= width - 1 and 2 * shared >= self.least * (distinct + size):
                yield at - width + 1, 2 * shared / (distinct + size)

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Start, end, licence and coefficient of matches."""
        text = text or ""
        places = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        grams = list(zip(words, words[1:]))
        templates = sorted(self.possible(set(grams)))
        if not templates:
            return []
        matches: dict[tuple[int, int], tuple[float, str]] = {}

        def add(a: int, b: int, dice: float, name: str) -> None:
            old = matches.get((a, b))
            if dice >= self.least and (old is None or (-dice, name) < (-old[0], old[1])):
                matches[a, b] = (dice, name)

        starts = [a for a, _ in places]
        for a, b in units(text):
            i, j = bisect_left(starts, a), bisect_left(starts, b)
            if j - i > 1:
                here = set(grams[i : j - 1])
                for t in templates:
                    add(a, b, self.dice(here, t), self.names[t])
        for t in templates:
            for at, dice in self.windows(grams, t):
                # a window ends with shared bigrams
                last = at + min(self.words[t] - 1, len(grams)) - 1
                while grams[at] not in self.grams[t]:
                    at += 1
                while grams[last] not in self.grams[t]:
                    last -= 1
                add(places[at][0], places[last + 1][1], dice, self.names[t])
        kept: list[tuple[int, int, str, float]] = []
        ends: list[int] = []
        for (a, b), (dice, name) in sorted(matches.items(), key=lambda m: (-m[1][0], m[0][0] - m[0][1], m[0])):
            at = bisect_left(ends, a + 1)  # the first kept span that ends after this one starts
            if at == len(kept) or b <= kept[at][0]:
                kept.insert(at, (a, b, name, dice))
                ends.insert(at, b)
        return kept


def units(text: str) -> set[tuple[int, int]]:
    """Places of lines, of paragraphs between empty lines and of the whole text."""
    out, at = [(0, len(text))], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    start = 0
    for m in re.finditer(r"\n[ \t]*\n", text):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(text)))
    return {u for u in out if u[1] > u[0]}


MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))


def find_licenses(df: DataFrame, text: str = "text", out: str = "licenses", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """The table with an array of matches: start, end (code points, exclusive), license, dice."""
    rest = without(df, out)
    at = rest.columns.index(text)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, least)
        for batch in batches:
            found = [[dict(zip(("start", "end", "license", "dice"), m)) for m in index.scan(x.as_py())] for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, MATCHES)]))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.element_at(F.array_sort(F.transform("licenses", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("n")))), 1)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.when(F.size("licenses") > 0, top["n"]).alias("license"),
        F.when(F.size("licenses") > 0, F.round(-top["d"], 6)).alias("dice"),
        F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
    )
