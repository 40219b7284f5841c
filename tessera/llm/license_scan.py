"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Candidates are each line, each paragraph (lines up to a blank one), the whole text, and every window of as many consecutive
words as the template has, wherever it begins, so that a licence of several paragraphs or a notice inside a long line is found.
Normalised words are lower-case runs of a-z and 0-9.
The Dice coefficient of two sets of bigrams can't reach t unless the smaller set has at least t / (2 - t) times the size of
the larger: candidates outside these bounds are pruned before any bigrams are compared, and a template of which the whole text holds
a smaller share than that is pruned before any candidate is cut.

Defined results: a null or empty text matches nothing; of equal lines, paragraphs and texts one counts; a template of one document is reported once,
with its best coefficient, the number of its distinct lines, paragraphs and texts at or above the threshold, and that of its windows; ties don't matter, as
no candidate is named; repeated rows are reported each; a null key is handed through; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import prepare, texts_of

#: Wordings of public licences and of the notices that name them.
TEMPLATES: dict[str, str] = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "notice:MIT": "Released under the MIT License.",
    "notice:MIT-2": "Licensed under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:CC-BY-4.0": "Licensed under CC BY 4.0.",
    "notice:CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "notice:BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
}
WORD = re.compile(r"[a-z0-9]+")
BLANK = re.compile(r"\n[ \t\r\f\v]*\n")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.sets = {n: bigrams(t) for n, t in templates.items()}
        self.length = {n: len(WORD.findall(t.lower())) - 1 for n, t in templates.items()}
        self.of: dict[tuple[str, str], list[str]] = {}
        for n, found in self.sets.items():
            for x in found:
                self.of.setdefault(x, []).append(n)

    def bounds(self, n: int) -> tuple[float, float]:
        """Sizes that a set may have to reach the threshold with one of n bigrams."""
        ratio = self.least / (2 - self.least)
        return n * ratio - 1e-9, n / ratio + 1e-9

    def dice(self, found: frozenset[tuple[str, str]], template: frozenset[tuple[str, str]]) -> float:
        lo, hi = self.bounds(len(template))
        return 2 * len(found & template) / (len(found) + len(template)) if lo <= len(found) <= hi else 0.0

    def windows(self, pairs: list[tuple[str, str]], name: str) -> tuple[float, int]:
        """The best coefficient of windows of the template's length, and how many reach the threshold: distinct pairs are counted as the window slides."""
        template, size = self.sets[name], self.length[name]
        inside: dict[tuple[str, str], int] = {}
        shared, best, times = 0, 0.0, 0
        for i, x in enumerate(pairs):
            n = inside.get(x, 0)
            inside[x] = n + 1
            shared += not n and x in template
            if i >= size:
                y = pairs[i - size]
                inside[y] -= 1
                if not inside[y]:
                    del inside[y]
                    shared -= y in template
            if i >= size - 1:
                dice = 2 * shared / (len(inside) + len(template))
                best, times = max(best, dice), times + (dice >= self.least)
        return best, times

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        words = WORD.findall(text.lower())
        pairs = list(zip(words, words[1:], strict=False))
        held: dict[str, int] = {}
        for x in self.of.keys() & set(pairs):
            for n in self.of[x]:
                held[n] = held.get(n, 0) + 1
        names = [n for n, c in held.items() if c >= self.bounds(len(self.sets[n]))[0]]
        if not names:
            return []
        parts = [bigrams(p) for p in {*text.split("\n"), *BLANK.split(text), text}]
        out = []
        for n in names:
            template = self.sets[n]
            near = [d for d in (self.dice(p, template) for p in parts) if d >= self.least]
            best, times = self.windows(pairs, n)
            if near or times:
                out.append((n, max([*near, best]), len(near), times))
        return sorted(out)


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *found) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for found in scanner.scan(t)]
            ids, names, dice, n, w = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(dice, pa.float64()), pa.array(n, pa.int64()), pa.array(w, pa.int64())],
                names=["doc_id", "license", "dice", "n_candidates", "n_windows"],
            )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, dice, n_candidates, n_windows) of every template that a part of the text comes near to."""
    prepare(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, least)
    return texts_of(docs, key, text).mapInArrow(_scan(scanner), "doc_id long, license string, dice double, n_candidates long, n_windows long")


def brute(text: str, templates: dict[str, str], least: float = 0.8) -> list[tuple[str, float, int, int]]:
    """What scan() says of a text, from all candidates; for tests."""
    words, out = WORD.findall(text.lower()), []
    for name, body in templates.items():
        t, w = bigrams(body), len(WORD.findall(body.lower()))
        dice = lambda x: 2 * len(x & t) / max(1, len(x) + len(t))  # noqa: E731, B023
        near = [dice(bigrams(p)) for p in {*text.split("\n"), *BLANK.split(text), text}]
        slid = [dice(bigrams(" ".join(words[i : i + w]))) for i in range(len(words) - w + 1)]
        if max(near + slid) >= least:
            out.append((name, max(near + slid), sum(d >= least for d in near), sum(d >= least for d in slid)))
    return sorted(out)
