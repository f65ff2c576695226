"""Licence scan: word windows of normalised text against licence templates, by the Dice coefficient of their sets of word
bigrams. Size bounds prune the templates that a text or a window can't match.

A window may begin and end anywhere, whatever the line breaks, so that a notice inside a longer line, a wrapped text
and a full licence are found alike.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

#: A match has this Dice coefficient or more.
THRESHOLD = 0.8

# Texts and notices of public licences, by SPDX names.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE_SHORT = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_APACHE_TERMS = """TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and
conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the
copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the
acting entity and all other entities that control, are controlled by, or are under common control with that entity."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as
published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_GNU_OLD = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""
_GNU_LIBRARY = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version."""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software"""
TEMPLATES = (
    ("MIT", f"{_MIT} {_MIT_END}"),
    ("MIT", _MIT),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-2-Clause", _BSD_2),
    ("ISC", _ISC),
    ("Apache-2.0", f"{_APACHE_SHORT} {_APACHE_END}"),
    ("Apache-2.0", _APACHE_SHORT),
    ("Apache-2.0", _APACHE_TERMS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-or-later", f"{_GNU.format('', 3)} {_GNU_END.format('')}"),
    ("GPL-3.0-or-later", _GNU.format("", 3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", f"{_GNU_OLD} {_GNU_END.format('')}"),
    ("GPL-2.0-or-later", _GNU_OLD),
    ("LGPL-2.1-or-later", _GNU_LIBRARY),
    ("LGPL-3.0-or-later", _GNU.format("Lesser ", 3)),
    ("AGPL-3.0-or-later", _GNU.format("Affero ", 3)),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> list[str]:
    """Lower-case words of letters and digits; other signs separate them."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass
class Templates:
    names: list[str]
    grams: list[set]
    threshold: float
    low: list[float] = field(init=False)  #: least bigrams of a window that matches, and least common ones
    high: list[float] = field(init=False)
    owners: dict[tuple[str, str], list[int]] = field(init=False)
    anchors: list[str] = field(init=False)  #: a text without any of these words matches nothing

    def __post_init__(self):
        # dice >= t needs t / (2 - t) <= |window| / |template| <= (2 - t) / t, and as many common bigrams as the former says
        t = self.threshold
        self.low = [len(g) * t / (2 - t) - 1e-9 for g in self.grams]
        self.high = [len(g) * (2 - t) / t + 1e-9 for g in self.grams]
        self.owners = defaultdict(list)
        for n, g in enumerate(self.grams):
            for x in g:
                self.owners[x].append(n)
        self.owners = dict(self.owners)
        found: set[str] = set()
        for g, low in zip(self.grams, self.low, strict=True):
            left = {x for x in g if found.isdisjoint(x)}
            while left and len(left) >= low:
                words = {w for x in left for w in x}
                often = {w: sum(w in x for x in self.owners) for w in words}
                best = max(sorted(words), key=lambda w: (len(w) >= 6, sum(w in x for x in left), -often[w]))  # noqa: B023
                found.add(best)
                left = {x for x in left if best not in x}
        self.anchors = sorted(w for w in found if not any(o != w and o in w for o in found))


def compile_templates(templates=TEMPLATES, threshold: float = THRESHOLD) -> Templates:
    return Templates([n for n, _ in templates], [bigrams(normalise(t)) for _, t in templates], threshold)


def _windows(pairs: list[tuple[str, str]], hits: list[int], grams: set, low: float, high: float, threshold: float) -> Iterator[tuple[float, int, int]]:
    """(dice, first pair, last pair): for each place that a matching window can start at, the best one that does, the
    shortest of these. hits: the places of the template's pairs, where windows start and end, as other pairs at the ends
    only lower the coefficient. A window ends before its first pair comes again: the one that starts there is no
    worse. So what is looked at between two places of one pair adds up to the length of the text, however it repeats."""
    place = {i: k for k, i in enumerate(hits)}
    for k, i in enumerate(hits):
        ahead, common = {pairs[i]}, 1
        best = None
        if len(hits) - k < low:
            return
        for j in range(i, len(pairs)):
            x = pairs[j]
            if j > i:
                if x == pairs[i]:
                    break
                if x not in ahead:
                    ahead.add(x)
                    if len(ahead) > high:
                        break
                    common += j in place
            if j in place and common >= low and (score := 2 * common / (len(ahead) + len(grams))) >= threshold and (best is None or score > best[0]):
                best = (score, i, j)
        if best:
            yield best


def passages(text: str | None, t: Templates) -> list[tuple[int, int, str, float]]:
    """(first line, last line, licence, dice) of all word windows that match a template, in order of their places.

    Windows that share a word give way to the best (then that of the larger template, the shortest, the first), so that
    a notice counts for the licence whose words it has, not for others of its family."""
    if not text:
        return []
    lowered = text.lower()
    if not any(map(lowered.__contains__, t.anchors)):
        return []
    lines = [_WORD.findall(line) for line in lowered.split("\n")]
    words = [w for line in lines for w in line]
    pairs = list(zip(words, words[1:], strict=False))
    hits: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(pairs):
        if x in t.owners:
            for n in t.owners[x]:
                hits[n].append(i)
    found = []
    for n, own in hits.items():
        if len({pairs[i] for i in own}) >= t.low[n]:
            found += [(score, n, i, j) for score, i, j in _windows(pairs, own, t.grams[n], t.low[n], t.high[n], t.threshold)]
    if not found:
        return []
    at = [k for k, line in enumerate(lines) for _ in line]
    had, out = bytearray(len(words)), []
    for score, n, i, j in sorted(found, key=lambda x: (-x[0], -len(t.grams[x[1]]), x[3] - x[2], x[2], x[1])):
        if not any(had[i : j + 2]):
            had[i : j + 2] = b"\x01" * (j + 2 - i)
            out.append((i, j, t.names[n], score))
    return [(at[i], at[j + 1], name, score) for i, j, name, score in sorted(out)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, matches) per row of docs: matches is an array of (first_line, last_line, licence, dice) in order
    of their places, empty for null and blank texts. Words are compared without case and signs; a template needs two
    words. Every repetition of a notice is a match, and the time grows with the length of a text, not its square. Null
    ids and repeated rows stay. Other columns of docs aren't looked at. An empty table gives an empty result."""
    require(docs, id_col, text_col)
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold is from 0.5 to 1")
    compiled = compile_templates(templates, threshold)
    if not all(compiled.grams):
        raise ValueError("a template has two words or more")
    names = ("first_line", "last_line", "licence", "dice")
    udf = F.pandas_udf(
        lambda texts: pd.Series([[dict(zip(names, x, strict=True)) for x in passages(t, compiled)] for t in texts]),
        "array<struct<first_line: int, last_line: int, licence: string, dice: double>>",
    )
    return docs.select(F.col(id_col).alias("id"), udf(text_col).alias("matches"))


def licence_counts(found: DataFrame) -> DataFrame:
    """(licence, documents, passages) over the rows of scan()."""
    rows = found.select("id", F.explode("matches").alias("m"))
    return rows.groupBy(F.col("m.licence").alias("licence")).agg(F.countDistinct("id").alias("documents"), F.count("*").alias("passages"))
