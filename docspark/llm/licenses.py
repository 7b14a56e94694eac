"""License scan: Dice coefficient over word bigrams against licence templates.

A document is compared whole and in its units: lines, sentences, and blocks between
empty lines. A unit's text is normalised to lower-case words; its Dice coefficient
with a template is 2 * |A & B| / (|A| + |B|) over the sets of word bigrams. At least
``LIKE`` is possible only if the sizes are within LIKE / (2 - LIKE) of each other, so
only templates of such sizes are compared, and of them only those that share a bigram
(found in an inverted index of the templates' bigrams). Templates are few and a
parameter; tasks hold them all, and documents are never shuffled.

Defined results: one row for each row of the input; license and template are null and
dice is 0 if no template is as like; of several that are, that wins with which the
document shares most bigrams, then the most like one, then the first by name: a whole
licence says more than its first sentence, which others may have, too. Null texts match
nothing; an empty table gives an empty result; a very long text is held by one task at a
time, as its words. Only id and text are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import pieces

LIKE = 0.85

#: Licence ids with the wordings of their notices, and full texts of short licences without their copyright lines.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice2", "Licensed under the MIT License."),
    ("MIT", "grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "notice", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    (
        "MIT", "text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC", "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause", "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-3-Clause", "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Zlib", "text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense", "text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("proprietary", "notice", "All rights reserved."),
]

_words = re.compile(r"[^\W_]+").findall
_sentence_end = re.compile(r"([.!?])[ \t]+")
_empty_line = re.compile(r"\n[ \t]*\n")


def bigrams(text: str) -> set:
    w = _words(text)
    return set(zip(w, w[1:]))


def units(text: str) -> set[str]:
    """The text, its blocks, lines and sentences."""
    lines = text.split("\n")
    out = {text, *lines}
    if "\n" in text:
        out.update(_empty_line.split(text))
    for line in lines:
        out.update(_sentence_end.sub(r"\1\n", line).split("\n"))
    return out


class Templates:
    def __init__(self, templates=TEMPLATES, like: float = LIKE):
        self.like = like
        self.names = [(f"{lic}/{part}", lic) for lic, part, _ in templates]
        self.sets = [bigrams(text.lower()) for _, _, text in templates]
        self.index: dict = {}
        for k, s in enumerate(self.sets):
            for x in s:
                self.index.setdefault(x, []).append(k)
        ratio = like / (2 - like)
        self.bounds = [(len(s) * ratio, len(s) / ratio) for s in self.sets]
        self.least, self.most = min(b[0] for b in self.bounds), max(b[1] for b in self.bounds)

    def best(self, text: str | None) -> tuple:
        """(dice, template, licence) of the unit and template with most common bigrams, of those that are like enough."""
        top, order = (0.0, None, None), None
        for unit in units(text.lower()) if text else ():
            w = _words(unit)
            if len(w) - 1 < self.least:
                continue
            found: dict = {}
            pairs = set(zip(w, w[1:])) if len(w) <= 4 * self.most else self._all(w)
            if not self.least <= len(pairs) <= self.most:
                continue
            for x in pairs & self.index.keys():
                for k in self.index[x]:
                    found[k] = found.get(k, 0) + 1
            for k, both in found.items():
                low, high = self.bounds[k]
                dice = 2 * both / (len(pairs) + len(self.sets[k]))
                if low <= len(pairs) <= high and dice >= self.like:
                    name, lic = self.names[k]
                    if order is None or (-both, -dice, name) < order:
                        top, order = (dice, name, lic), (-both, -dice, name)
        return top

    def _all(self, w: list[str]) -> set:
        """The bigrams of a long unit, which may repeat few; no more than needed to exceed every bound."""
        pairs = set()
        for x in zip(w, w[1:]):
            pairs.add(x)
            if len(pairs) > self.most:
                break
        return pairs


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, like: float = LIKE) -> DataFrame:
    """doc_id, license, template and dice of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.string()), ("dice", pa.float64())])

    def match(batches):
        known = Templates(templates, like)
        for b in pieces(batches):
            best = [known.best(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[2] for x in best], pa.string()), pa.array([x[1] for x in best], pa.string()), pa.array([x[0] for x in best], pa.float64())], schema=schema
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(match, "doc_id long, license string, template string, dice double")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP6_SQL = (
    "WITH t(template, license, body) AS (VALUES "
    + ", ".join(f"({_literal(f'{lic}/{part}')}, {_literal(lic)}, {_literal(text)})" for lic, part, text in TEMPLATES)
    + r"""),
tw AS (SELECT template, license, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM t),
tg AS (SELECT DISTINCT template, license, w[k] || ' ' || w[k + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS k FROM tw)),
tn AS (SELECT template, count(*) AS n FROM tg GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS rid, lower(coalesce(text, '')) AS x FROM documents),
u AS (SELECT DISTINCT rid, unit FROM (
  SELECT rid, x AS unit FROM d UNION ALL SELECT rid, unnest(string_split(x, chr(10))) FROM d
  UNION ALL SELECT rid, unnest(regexp_split_to_array(x, '\n[ \t]*\n')) FROM d
  UNION ALL SELECT rid, unnest(string_split(regexp_replace(x, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) FROM d)),
uw AS (SELECT rid, row_number() OVER () AS k, regexp_extract_all(unit, '[\p{L}\p{N}]+') AS w FROM u),
ug AS (SELECT DISTINCT rid, k, w[p] || ' ' || w[p + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS p FROM uw)),
un AS (SELECT k, count(*) AS n FROM ug GROUP BY 1),
m AS (SELECT rid, k, template, license, count(*) AS s FROM ug JOIN tg USING (g) GROUP BY ALL),
b AS (SELECT rid, template, license, 2 * s / (un.n + tn.n) AS dice, row_number() OVER (PARTITION BY rid ORDER BY s DESC, 2 * s / (un.n + tn.n) DESC, template) AS r
  FROM m JOIN un USING (k) JOIN tn USING (template) WHERE 2 * s / (un.n + tn.n) >= 0.85)
SELECT d.doc_id, b.license, b.template, coalesce(b.dice, 0.0)::DOUBLE AS dice FROM d LEFT JOIN b ON b.rid = d.rid AND b.r = 1
"""
)
