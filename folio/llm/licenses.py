"""Licence scan: Dice coefficient over the distinct word bigrams of normalised texts and licence templates.

The units compared are every line of a text, the sentences of lines that have several, and every sequence of paragraphs
(lines between lines without words) whose number of bigrams a template allows: so a licence of several paragraphs is found
above code, in comments and re-wrapped. Normalised: A-Z lower-cased, words of letters, digits and characters beyond ASCII.
With a and b bigrams the coefficient is at most 2 min(a, b) / (a + b), so a template is a candidate only for units whose
number of bigrams lies between its own times LEAST / (2 - LEAST) and its own times the inverse; units of any other size are
passed over. A unit that matches needs half of its template's bigrams and more in the text, so texts without are done with
after their lines.

Defined results: null or empty texts, units of fewer than two words: no match; several templates at one coefficient: the
first by name; repeated rows each get their result. Columns named like the new ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import alnum_words, map_texts

LEAST = 0.8

_WARRANTY = (
    'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the '
    "warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or "
    "copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
    "otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_BSD_END = (
    'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, '
    "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or "
    "services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, "
    "whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of "
    "this software, even if advised of the possibility of such damage."
)
_BSD_START = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_ISC = (
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_END = (
    ' the software is provided "as is" and the author disclaims all warranties with regard to this software including all '
    "implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, "
    "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an "
    "action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of "
    "this software."
)
#: Fixed values: (licence, wording) of public licences and of the notices by which texts name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "software"), to deal in the software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to "
        "permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software. " + _WARRANTY,
    ),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("0BSD", _ISC + "." + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START + "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. " + _BSD_END,
    ),
    (
        "Zlib",
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held "
        "liable for any damages arising from the use of this software. permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. the origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. if you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. this notice may not be removed or altered from any source "
        "distribution.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public "
        "license as published by the free software foundation, either version 3 of the license, or (at your option) any later "
        "version. this program is distributed in the hope that it will be useful, but without any warranty; without even the "
        "implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more "
        "details.",
    ),
    (
        "GPL-2.0-or-later",
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public "
        "license as published by the free software foundation; either version 2 of the license, or (at your option) any later "
        "version. this program is distributed in the hope that it will be useful, but without any warranty; without even the "
        "implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more "
        "details.",
    ),
    (
        "MPL-2.0",
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not "
        "distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license."),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license."),
    ("CC0-1.0", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def bigrams(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:]))


class Templates:
    """Templates by the numbers of bigrams that a match with them can have."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        self.all = [(name, bigrams(alnum_words(text.encode()))) for name, text in templates]
        sizes = [len(b) for _, b in self.all]
        # No unit of more words than this can hold so few bigrams unless it repeats itself; those are counted exactly.
        self.low = math.ceil(min(sizes) * least / (2 - least) - 1e-9)
        self.high = math.floor(max(sizes) * (2 - least) / least + 1e-9)
        self.by_size = {
            n: [(name, b) for name, b in self.all if 2 * min(n, len(b)) >= least * (n + len(b))] for n in range(self.low, self.high + 1)
        }

    def possible(self, words: list[bytes]) -> bool:
        """Whether the text has so many bigrams of a template that a unit of it can match."""
        own = bigrams(words)
        return any(len(b & own) * (2 - self.least) >= self.least * len(b) for _, b in self.all)

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        if len(words) <= self.low:
            return None
        own = bigrams(words)
        found = None
        for name, b in self.by_size.get(len(own), ()):
            score = 2 * len(own & b) / (len(own) + len(b))
            if score >= self.least and (found is None or (-score, name) < (-found[0], found[1])):
                found = (score, name)
        return found


SENTENCE_END = re.compile(rb"[.;!?][ \t]+")


def units(text: bytes, high: int, more) -> Iterator[list[bytes]]:
    """The words of every line, of the sentences of lines with several, and of every sequence of several lines of paragraphs.

    high: the bigrams that a unit can have at most; more(words): whether sequences of paragraphs of so many words can match.
    """
    raw = text.split(b"\n")
    lines = [alnum_words(x) for x in raw]
    yield from lines
    for x in raw:
        pieces = SENTENCE_END.split(x)
        if len(pieces) > 1:
            yield from map(alnum_words, pieces)
    runs, in_run = [], False
    for words in lines:
        if words and in_run:
            runs[-1].append(words)
        elif words:
            runs.append([words])
        in_run = bool(words)
    flat = [([w for words in run for w in words], len(run)) for run in runs]
    if not any(n > 1 for _, n in flat) and len(flat) < 2 or not more([w for words, _ in flat for w in words]):
        return
    for i in range(len(flat)):
        words, seen, n = [], set(), 0
        for own, k in flat[i:]:
            seen.update(zip([*words[-1:], *own], own if words else own[1:]))
            words, n = words + own, n + k
            if len(seen) > high:
                break
            if n > 1:
                yield words


FOUND = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("dice", T.DoubleType()),
        T.StructField("n_matches", T.LongType()),
    ]
)


def find_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs with license and dice of the best match of any unit (null: none) and n_matches, the number of units with one."""

    def make():
        known = Templates(templates, least)

        def f(texts, _):
            names, scores, counts = [], [], []
            for t in texts:
                found = [x for x in map(known.best, units(t, known.high, known.possible)) if x] if t else []
                score, name = min(found, key=lambda x: (-x[0], x[1])) if found else (None, None)
                names.append(name)
                scores.append(score)
                counts.append(len(found))
            return [names, scores, counts]

        return f

    return map_texts(docs, text, FOUND, make, keep=keep)
