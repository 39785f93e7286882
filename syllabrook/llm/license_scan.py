"""License scan by conditional compression.

Every window of ``WINDOW`` words of a text, each ``STRIDE`` words on, is compressed on its own and with all
templates together as a zstandard raw dictionary. Where that saves ``LEAST_SAVED`` bytes, the window is a
candidate block: it is compressed with each template alone, the templates are ranked by what they save, and in
that order their wording is compared until one holds: the template's words are aligned with those around the
block, and the differences (words changed, left out or put in) must be few and must not touch the words that
tell licenses apart, such as names and versions. What is left of the block beside a find is looked at again.

The threshold lies between what notices save at least and what almost no other text does (README). Templates that
save nearly as much as the best one are tried from the longest on, since a longer notice may hold a shorter one.

Cases: a null or empty text has no candidates. Long texts are whole: every window is looked at, however many
there are. The same notice twice is found twice. Finds never overlap; ties go to the longer template, then to
the earlier one of the list. Repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import give_back, small_batches

#: What several licenses share (fixed values).
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, what: str = "program") -> str:
    """The notice that the GNU licenses ask for."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


#: Notices and whole texts by license (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("BSD-3-Clause", _CONDITIONS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", " ".join((_CONDITIONS, _SOURCE, _BINARY, _DISCLAIMER))),
    ("BSD-3-Clause", " ".join((_CONDITIONS, _SOURCE, _BINARY, _NO_NAMES, _DISCLAIMER))),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
             "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
             "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", "library")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
]
#: Words that tell licenses apart: names and versions, and in short notices what they consist of.
TELLING = re.compile(r"\d|^(mit|apache|gnu|mozilla|mpl|lesser|affero|library|cc|cc0|by|by-nc|by-sa)$")
TELLING_SHORT, SHORT = re.compile(TELLING.pattern + "|^(all|reserved|redistribution)$"), 40
#: Words of a window and from one to the next, the least bytes saved, the share of the best saving that counts as
#: equal to it, the share of words that may differ, and the level, which looks for short matches too.
WINDOW, STRIDE, LEAST_SAVED, EQUAL, MOST_CHANGED, LEVEL = 28, 12, 4, 0.8, 0.2, 12


@dataclass(frozen=True)
class Find:
    license: str
    start: int
    end: int
    differences: int


@dataclass
class Template:
    license: str
    words: list[str]
    telling: list[int]
    compressor: object


#: A word, and what is left out at its ends.
WORD, EDGES = re.compile(r"[^\x20\x09-\x0D]+"), ".,;:()\"'<>"


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


def _with_dictionary(raw: bytes) -> object:
    import zstandard

    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)


@cache
def _templates() -> list[Template]:
    """From the longest to the shortest."""
    out = []
    for name, text in TEMPLATES:
        words = [plain(w) for w in text.split()]
        telling = TELLING_SHORT if len(words) < SHORT else TELLING
        out.append(Template(name, words, [k for k, w in enumerate(words) if telling.search(w)], _with_dictionary(text.lower().encode())))
    return sorted(out, key=lambda t: -len(t.words))


@cache
def _compressors() -> tuple:
    """Without a dictionary, and with all templates."""
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), _with_dictionary(" ".join(t for _, t in TEMPLATES).lower().encode())


#: Windows that are compressed in one call.
TOGETHER = 256
#: What it costs to lose a word that tells licenses apart: more than any text has words.
LOST = 1 << 24


def align(template: list[str], block: list[str], telling: tuple[int, ...] = ()) -> tuple[int, int, int]:
    """Fewest differences of the template to any run of the block's words that keeps its telling words: differences, run."""
    number = {w: k for k, w in enumerate(template)}
    b = np.array([number.get(w, -1) for w in block], dtype=np.int32)
    place = np.arange(len(block) + 1, dtype=np.int32)
    table = np.zeros((len(template) + 1, len(block) + 1), dtype=np.int32)
    cost = np.ones(len(template), dtype=np.int32)
    cost[list(telling)] = LOST // max(1, len(template))
    for i, w in enumerate(template):
        row = table[i + 1]
        row[0] = table[i, 0] + cost[i]
        np.minimum(table[i, :-1] + np.where(b != number[w], cost[i], 0), table[i, 1:] + cost[i], out=row[1:])
        row[:] = np.minimum.accumulate(row - place) + place  # words that are put in
    end = int(np.argmin(table[-1]))
    i, j = len(template), end
    while i and j:
        here = table[i, j]
        if here == table[i - 1, j - 1] + (0 if b[j - 1] == number[template[i - 1]] else cost[i - 1]):
            i, j = i - 1, j - 1
        elif here == table[i - 1, j] + cost[i - 1]:
            i -= 1
        else:
            j -= 1
    return int(table[-1, end]), j, end


def possible(template: Template, there: set[str]) -> bool:
    """Whether few enough words of the template are missing; each missing one is a difference in any alignment."""
    words, missing, most = template.words, 0, MOST_CHANGED * len(template.words)
    if any(words[k] not in there for k in template.telling):
        return False
    for w in words:
        if w not in there:
            missing += 1
            if missing > most:
                return False
    return True


def confirm(template: Template, block: list[str]) -> tuple[int, int, int] | None:
    """Differences and run, if the wording is the template's."""
    if not possible(template, set(block)):
        return None
    differences, start, end = align(template.words, block, tuple(template.telling))
    return (differences, start, end) if end > start and differences <= MOST_CHANGED * len(template.words) else None


class Scan:
    """One text: where its words are, and which of them a find has taken."""

    def __init__(self, text: str) -> None:
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blank = (letters == 32) | ((letters >= 9) & (letters <= 13))
        edge = np.diff(np.concatenate(([1], blank, [1])).astype(np.int8))
        self.text, self.start, self.end = text, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.taken = np.zeros(len(self.start) + 1, dtype=bool)
        self.blocks, self.finds = 0, []

    def words(self, a: int, b: int) -> list[str]:
        return [w.strip(EDGES) for w in WORD.findall(self.text[self.start[a] : self.end[b - 1]].lower())] if b > a else []

    def run(self) -> "Scan":
        n = len(self.start)
        own, joint = _compressors()
        starts = range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)
        for k in range(0, len(starts), TOGETHER):
            windows = [(a, min(a + WINDOW, n)) for a in starts[k : k + TOGETHER]]
            raws = [self.raw(a, b) for a, b in windows]
            for (a, b), x, y in zip(windows, own.multi_compress_to_buffer(raws), joint.multi_compress_to_buffer(raws), strict=True):
                if len(x) - len(y) >= LEAST_SAVED:  # what is taken only takes from it
                    self.look(a, b)
        return self

    def raw(self, a: int, b: int) -> bytes:
        return self.text[self.start[a] : self.end[b - 1]].lower().replace("\n", " ").encode("utf-8", "replace")

    def saves(self, a: int, b: int) -> int:
        """The bytes that all templates together save of words a to b."""
        own, joint = _compressors()
        raw = self.raw(a, b)
        return len(own.compress(raw)) - len(joint.compress(raw))

    def look(self, a: int, b: int) -> None:
        """Finds in a window, until nothing that is left of it is worth a comparison."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            free = np.flatnonzero(~self.taken[a:b])
            if len(free) != b - a:  # what others have taken cuts the window
                cut = np.flatnonzero(np.diff(free) > 1) + 1
                todo += [(a + int(x[0]), a + int(x[-1]) + 1) for x in np.split(free, cut) if len(x)]
            elif b > a and (found := self.best(a, b)):
                self.finds.append(found[0])
                self.taken[found[1] : found[2]] = True
                todo.append((a, b))

    def best(self, a: int, b: int) -> tuple[Find, int, int] | None:
        """The first of the ranked templates whose wording holds at or around words a to b.

        A window may only touch a notice, so what it found is ranked anew with the words around the find, as long as that
        gives a longer one.
        """
        if self.saves(a, b) < LEAST_SAVED:
            return None
        self.blocks += 1
        found = self.first(a, b)
        while found and (wider := self.first(*self.around(found[1], found[2], WINDOW))) and wider[2] - wider[1] > found[2] - found[1]:
            found = wider
        return found

    def first(self, a: int, b: int) -> tuple[Find, int, int] | None:
        near = set(self.words(*self.around(a, b, len(_templates()[0].words))))
        for t in self.ranked(a, b, [t for t in _templates() if possible(t, near)]):
            left, right = self.around(a, b, len(t.words))
            place = None
            while found := confirm(t, self.words(left, right)):
                d, i, j = found[0], left + found[1], left + found[2]
                if place == (d, i, j):
                    return Find(t.license, int(self.start[i]), int(self.end[j - 1]), d), i, j
                place = d, i, j  # once more where nothing of it can lie outside
                left, right = self.around(i, j, len(t.words))
        return None

    def ranked(self, a: int, b: int, some: list[Template]) -> list[Template]:
        """Those of some templates that save enough of words a to b alone, by what they save.

        What the best of all templates saves only matters for the order of several.
        """
        if not some:
            return []
        raw = self.raw(a, b)
        alone = len(_compressors()[0].compress(raw))
        saved = lambda t: alone - len(t.compressor.compress(raw))
        found = [(n, t) for t in some if (n := saved(t)) >= LEAST_SAVED]
        if len(found) > 1:
            tried = {id(t) for t in some}
            top = max([n for n, _ in found] + [saved(t) for t in _templates() if id(t) not in tried])
            found.sort(key=lambda x: -min(x[0], EQUAL * top))
        return [t for _, t in found]

    def around(self, a: int, b: int, reach: int) -> tuple[int, int]:
        """The words a to b with as many on either side as no find has taken, ``reach`` at most."""
        before = np.flatnonzero(self.taken[max(0, a - reach) : a])
        after = np.flatnonzero(self.taken[b : b + reach])
        left = max(0, a - reach) + (int(before[-1]) + 1 if len(before) else 0)
        return left, min(len(self.start), b + (int(after[0]) if len(after) else reach))


def scan(text: str | None) -> tuple[int, list[Find]]:
    """The number of candidate blocks of a text, and the notices found, by place."""
    if not text:
        return 0, []
    s = Scan(text).run()
    return s.blocks, sorted(s.finds, key=lambda f: f.start)


def licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_blocks and finds (an array of license, start, end, differences)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [scan(t) for t in s]
            yield pd.DataFrame({"n_blocks": [n for n, _ in rows], "finds": [[vars(f) for f in found] for _, found in rows]})
        give_back()

    kind = "n_blocks long, finds array<struct<license string, start int, end int, differences int>>"
    out = docs.drop("n_blocks", "finds").withColumn("__s", F.pandas_udf(run, kind)(F.col(text)))
    return out.select(*[f"`{c}`" for c in out.columns if c != "__s"], "__s.n_blocks", "__s.finds")
