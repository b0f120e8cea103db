r"""Licence notices in documents, by the Dice coefficient over word bigrams.

Text is normalised: A-Z lower-cased, all but letters and digits to single spaces. A window is
a run of the text's word bigrams, wherever it starts, also in the middle of a line or over
several. It matches a template if 2 |A and B| / (|A| + |B|), over the sets of bigrams of
window and template, is at least the threshold t. Each template that some window matches is
reported once, with its best window (ties: the first, then the shortest), unless a window that
overlaps it matches another template better.

Size bounds, exact: |A and B| must be at least need = t/(2-t) * |B|, and a window longer than
(2-t)/t * |B| can't reach t, so windows have need to (2-t)/t * |B| bigrams. A window gets no
worse by dropping an end that isn't in B, so only windows that start and end with a bigram
of B and hold at least `need` places with one are scored. Before that a template is dropped
if the text has fewer than `need` of its bigrams, and a text if it has none of a few words of
which every match has one.

All is built-in functions within a row: no shuffle, no Python, no limit. Null or empty text
and texts of one word match nothing; repeated rows match alike. An input column of the name
`licences` is replaced; other columns pass.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operative words of public licences and of their usual notices, without copyright lines.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "under the GNU Affero General Public License, version 3",
    "all-rights-reserved": "All rights reserved",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": "under the Apache License, Version 2.0",
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "bsd-notice": "under the BSD License",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by-4.0-notice": "under a Creative Commons Attribution 4.0 International License",
    "cc-by-4.0-short": "under CC BY 4.0",
    "cc-by-nc-4.0-notice": "under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-4.0-short": "under CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": "under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-sa-4.0-short": "under CC BY-SA 4.0",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "under the GNU General Public License, version 2",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "under the GNU General Public License, version 3",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "isc-notice": "under the ISC License",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "under the GNU Lesser General Public License, version 2.1",
    "lgpl-3.0-notice": "under the GNU Lesser General Public License, version 3",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
    "mit-notice": "under the MIT License",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-notice": "under the Mozilla Public License, version 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
THRESHOLD = 0.8
GAP = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template of ASCII text, in order."""
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """(least number of common bigrams, most bigrams of a window) for a template of `size` bigrams."""
    return math.ceil(threshold / (2 - threshold) * size - 1e-9), math.floor((2 - threshold) / threshold * size + 1e-9)


# Words too common in any text to look for.
_COMMON = frozenset(
    "a above all an and any are as at available be by conditions contract copy copies damages direct distribute distributed distribution documentation either express file files following for free from general has have "
    "if in including indirect is it its law list limited loss made may modify must name not notice of on or original other person persons products program profits provided public publish "
    "action anyone author but can claim code data do event except language regard related removed was way form http https international kind later legal materials no obtain option org out product shall so such unless will would works writing wrote www "
    "purpose required sell services software source special specific subject terms that the this to under use used version whether which with without work you your 0 1 2 3 4".split()
)


def marker_words(templates: dict[str, str], threshold: float) -> list[str]:
    """A few words of which every match has one.

    A match has `need` of a template's bigrams, so one of any (size - need + 1) of them: words
    are taken, those in most such bigrams first, until each template has as many.
    """
    left, due = {}, {}
    for key, text in templates.items():
        left[key] = [g.split(" ") for g in template_bigrams(text)]
        due[key] = len(left[key]) - bounds(len(left[key]), threshold)[0] + 1
    chosen = []
    while any(n > 0 for n in due.values()):
        gain: dict[str, int] = {}
        for key, grams in left.items():
            per: dict[str, int] = {}
            for g in grams if due[key] > 0 else ():
                for w in set(g):
                    per[w] = per.get(w, 0) + 1
            for w, n in per.items():
                gain[w] = gain.get(w, 0) + min(n, due[key])
        best = max(gain, key=lambda w: (w not in _COMMON, gain[w], w))
        chosen.append(best)
        for key in left:
            due[key] -= sum(best in g for g in left[key])
            left[key] = [g for g in left[key] if best not in g]
    return sorted(chosen)


def _strings(items) -> str:
    return "array({})".format(", ".join(f"'{i}'" for i in items))


_MATCH = "STRUCT<licence: STRING, dice: DOUBLE, window: STRING, start: INT, stop: INT>"


def licence_matches(text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<licence, dice, window, start, stop>>: matching templates by name; the best window's text and range of words."""
    name, found = f"`{text}`", []
    let = lambda value, var, body: f"transform(array({value}), {var} -> {body})[0]"
    for key, body in sorted(templates.items()):
        grams = template_bigrams(body)
        need, most = bounds(len(grams), threshold)
        items = _strings(grams)
        # Places of the template's bigrams, then the windows between two of them, scored.
        places = "filter(sequence(0, size(x.g) - 1), i -> array_contains(c, x.g[i]))"
        windows = f"flatten(transform(sequence(0, size(h) - {need}), i -> transform(filter(sequence(i + {need - 1}, least(i + {most - 1}, size(h) - 1)), j -> h[j] - h[i] < {most}), j -> named_struct('s', h[i], 'n', h[j] - h[i] + 1))))"
        dice = f"CAST(2 * size(array_intersect({items}, a)) AS DOUBLE) / (size(array_distinct(a)) + {len(grams)})"
        scored = f"array_max(transform({windows}, w -> {let('slice(x.g, w.s + 1, w.n)', 'a', f'named_struct({chr(39)}d{chr(39)}, {dice}, {chr(39)}s{chr(39)}, -w.s, {chr(39)}n{chr(39)}, -w.n)')}))"
        best = let(places, "h", f"IF(size(h) >= {need}, {scored}, NULL)")
        words = "array_join(slice(x.w, 1 - b.s, 1 - b.n), ' ')"
        result = let(best, "b", f"IF(b.d >= {threshold}D, named_struct('licence', '{key}', 'dice', b.d, 'window', {words}, 'start', -b.s, 'stop', 1 - b.s - b.n), NULL)")
        found.append(let(f"array_intersect(x.few, {items})", "c", f"IF(size(c) >= {need}, {result}, CAST(NULL AS {_MATCH}))"))
    every = _strings(dict.fromkeys(g for body in templates.values() for g in template_bigrams(body)))
    clean = f"translate({name}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"filter(split(regexp_replace({clean}, r'{GAP}', ' '), ' '), w -> w <> '')"
    grams = "IF(size(w) < 2, CAST(array() AS ARRAY<STRING>), transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat(w[i - 1], ' ', w[i])))"
    row = let(words, "w", let(grams, "g", f"named_struct('w', w, 'g', g, 'few', array_intersect(g, {every}))"))
    none = f"CAST(array() AS ARRAY<{_MATCH}>)"
    best = "filter(ms, m -> NOT exists(ms, o -> o.dice > m.dice AND o.start < m.stop AND o.stop > m.start))"
    out = let(row, "x", f"IF(size(x.few) = 0, {none}, {let(f'filter(array({chr(44).join(found)}), m -> m IS NOT NULL)', 'ms', best)})")
    markers = _strings(marker_words(templates, threshold))
    return F.expr(f"IF(arrays_overlap(split(lower({name}), '[^a-z0-9]+'), {markers}), {out}, {none})")


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a column `licences`, see licence_matches()."""
    return docs.withColumn("licences", licence_matches("text", templates, threshold))
