"""Licence scans with DataFrame functions only: Dice coefficient over word bigrams against licence templates.

Words are runs of letters and digits in lower case; so neither wrapping nor comment signs matter. For a template of m words a
segment is any m consecutive words of the text (fewer at its end) that begin with one of the template's bigrams: a licence
is found in a file of its own, wrapped in the head of a source file, or within a longer line. With a and b distinct bigrams
in segment and template, Dice is 2 * common / (a + b). Since common is at most a, Dice t needs common >= b * t / (2 - t).
This size bound prunes twice: templates of which the whole text holds fewer bigrams, and segments in which fewer than so
many places hold one, which a look at one later place tells.

Of the segments of a licence that reach the threshold the best is given: the one with the most bigrams in common, then the
largest Dice, then the first. A licence goes unreported if its segment overlaps a better one of another licence, or one as
good of a name before its own.

A text that holds a licence also holds one of a few words of each template; texts without any are not cut into words.

Null and empty text, and texts of fewer than two words, have no bigrams and match nothing. Each input row is scanned, also
rows that are alike; an empty table gives no rows. Very long texts cost time in proportion to their words, and one array of
them in memory. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import let

THRESHOLD = 0.8

#: Licence names and the texts that declare them (public licence texts and customary notices).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("AGPL-3.0", 'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-4.0", 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
    ("CC-BY-4.0", 'Licensed under CC BY 4.0.'),
    ("CC-BY-NC-4.0", 'Licensed under CC BY-NC 4.0.'),
    ("CC-BY-NC-4.0", 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
    ("CC-BY-SA-4.0", 'Licensed under CC BY-SA 4.0.'),
    ("CC-BY-SA-4.0", 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.'),
    ("CC0-1.0", 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.'),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("GPL-2.0", 'GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("GPL-3.0", 'This work is licensed under the GNU General Public License, version 3.'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("GPL-3.0", 'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.'),
    ("LGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("LGPL-3.0", 'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.'),
    ("MIT", 'Released under the MIT License.'),
    ("MIT", 'This project is licensed under the MIT License.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: Words that stand in most texts; others are tried first as the words that a match must hold.
COMMON = frozenset("a an and any are as at by for from in is it of on or that the this to under with without you use work free".split())
WORD = r"[\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def required_words(bigrams: list[str], threshold: float = THRESHOLD, chosen: frozenset[str] = frozenset()) -> list[str]:
    """Words one of which stands in every segment that reaches the threshold; those already chosen are taken first."""
    missable = len(bigrams) - math.ceil(len(bigrams) * threshold / (2 - threshold) - 1e-9)
    left, found, covered = list(bigrams), [], 0
    while covered <= missable:
        count = Counter(w for x in left for w in set(x.split()))
        word = max(count, key=lambda w: (w in chosen, w not in COMMON and len(w) >= 5, w not in COMMON, count[w], len(w), w))
        found.append(word)
        covered += count[word]
        left = [x for x in left if word not in x.split()]
    return found


def needed_words(templates: tuple[tuple[str, str], ...], threshold: float = THRESHOLD) -> list[str]:
    """Words one of which stands in every text that holds a licence; short templates choose first."""
    chosen: set[str] = set()
    for _, body in sorted(templates, key=lambda x: (len(x[1]), x)):
        chosen.update(required_words(bigrams_of(body), threshold, frozenset(chosen)))
    return sorted(chosen)


def _holds(text: Column, words: list[str]) -> Column:
    """True if one of the words may stand in text: short ones are looked for between other characters."""
    tests = [text.contains(w) for w in words if len(w) >= 5]
    if short := [w for w in words if len(w) < 5]:
        tests.append(text.rlike(f"(?<![a-z0-9])({'|'.join(short)})(?![a-z0-9])"))
    return reduce(lambda a, b: a | b, tests)


def _pairs(words: Column) -> Column:
    return let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def _least(grams: list[str], threshold: float) -> int:
    return max(1, math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, line of the first word, licence, dice, n_bigrams: a row for each licence found in a row of docs."""
    own = [(name, bigrams_of(body), len(words_of(body))) for name, body in templates]
    needed = needed_words(templates, threshold)
    lower = F.lower(F.col(text))
    some = docs.filter(F.coalesce(let(lower, lambda t: _holds(t, needed)), F.lit(False))).select(F.col(doc_id).alias("doc_id"), lower.alias("text"))
    # A word's line is told by the newlines before it: its place among words and newlines less that among words.
    tokens = F.transform(F.regexp_extract_all("text", F.lit(rf"{WORD}|\n"), F.lit(0)), lambda x, i: F.struct(x.alias("word"), i.alias("at")))
    words = some.select("doc_id", F.filter(tokens, lambda x: x["word"] != "\n").alias("words"))
    cut = words.select("doc_id", F.transform("words", lambda x: x["at"]).alias("at"), _pairs(F.transform("words", lambda x: x["word"])).alias("grams"))
    every = sorted({g for _, x, _ in own for g in x})
    hits = F.filter(F.transform("grams", lambda g, i: F.struct((i + 1).alias("p"), g.alias("g"))), lambda x: x["g"].isin(every))
    cut = cut.withColumn("hits", hits).filter(F.size("hits") >= min(_least(x, threshold) for _, x, _ in own))
    cut = cut.withColumn("held", F.array_distinct(F.transform("hits", lambda x: x["g"])))
    known = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*[F.lit(g) for g in grams]).alias("grams"), F.lit(len(grams)).alias("b"), F.lit(m).alias("m"), F.lit(_least(grams, threshold)).alias("least")) for name, grams, m in own])
    cut = cut.withColumn("fitting", F.filter(known, lambda t: F.size(F.array_intersect(F.col("held"), t["grams"])) >= t["least"])).filter(F.size("fitting") > 0)

    def segment(t: Column, p: Column) -> Column:
        def scored(grams: Column) -> Column:
            n, common = F.size(F.array_distinct(grams)), F.size(F.array_intersect(grams, t["grams"]))
            return F.struct((-common).alias("more"), (-2.0 * common / (n + t["b"])).alias("less"), p.alias("p"), t["licence"].alias("licence"), n.alias("n"), (p + F.least(t["m"], F.size("at") - p + 1)).alias("end"))

        return let(F.slice("grams", p, t["m"] - 1), scored)

    def segments(t: Column) -> Column:
        def of(places: Column) -> Column:
            full = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + t["least"] - 1) <= p + t["m"] - 2, F.lit(False)))
            return F.array_min(F.filter(F.transform(full, lambda p: segment(t, p)), lambda s: -s["less"] >= threshold))

        return let(F.transform(F.filter("hits", lambda x: F.array_contains(t["grams"], x["g"])), lambda x: x["p"]), of)

    cut = cut.withColumn("found", F.filter(F.transform("fitting", segments), lambda s: s.isNotNull()))

    def beaten(s: Column) -> Column:
        """By a segment of its own licence, or by one of another that overlaps it."""

        def better(x: Column) -> Column:
            own = F.struct(x["more"], x["less"], x["p"], x["n"], x["end"]) < F.struct(s["more"], s["less"], s["p"], s["n"], s["end"])
            other = (F.struct(x["more"], x["less"], x["licence"]) < F.struct(s["more"], s["less"], s["licence"])) & (x["p"] < s["end"]) & (s["p"] < x["end"])
            return F.when(x["licence"] == s["licence"], own).otherwise(other)

        return F.exists("found", better)

    best = cut.select("doc_id", "at", F.explode(F.array_distinct(F.filter("found", lambda s: ~beaten(s)))).alias("s"))
    return best.select("doc_id", (F.element_at("at", F.col("s.p")) - F.col("s.p") + 2).cast("long").alias("line"), "s.licence", F.round(-F.col("s.less"), 6).alias("dice"), F.col("s.n").cast("long").alias("n_bigrams"))


def oracle(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """The same rows in DuckDB SQL, from all segments that begin with a bigram of a template."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in bigrams_of(body))}], {len(words_of(body))})" for name, body in templates)
    return rf"""
WITH t(licence, grams, m) AS (VALUES {rows}),
tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|\n') AS x FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT doc_id, list_filter(x, lambda y: y <> chr(10)) AS w, list_filter(range(1, len(x) + 1), lambda i: x[i] <> chr(10)) AS places FROM tokens),
grams AS MATERIALIZED (SELECT doc_id, places, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM words WHERE len(w) > 1),
every AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS p FROM grams),
starts AS (SELECT doc_id, p, licence, grams, m FROM every JOIN (SELECT licence, grams, m, unnest(grams) AS gram FROM t) USING (gram)),
segments AS (
  SELECT doc_id, p, licence, grams, p + least(m, len(places) - p + 1) AS last, places[p] - p + 1 AS line, list_slice(g, p, p + m - 2) AS s
  FROM starts JOIN grams USING (doc_id)),
scored AS MATERIALIZED (
  SELECT doc_id, p, last, line, licence, len(list_distinct(s)) AS n, len(list_intersect(s, grams)) AS common, 2.0::DOUBLE * len(list_intersect(s, grams)) / (len(list_distinct(s)) + len(grams)) AS dice
  FROM segments QUALIFY dice >= {threshold} AND row_number() OVER (PARTITION BY doc_id, licence, grams ORDER BY common DESC, dice DESC, p) = 1),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY common DESC, dice DESC, p, n, last) = 1)
SELECT doc_id, line, licence, round(dice, 6) AS dice, CAST(n AS BIGINT) AS n_bigrams
FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM scored x WHERE x.doc_id = b.doc_id AND x.licence <> b.licence AND x.p < b.last AND b.p < x.last AND (x.common > b.common OR x.common = b.common AND (x.dice > b.dice OR x.dice = b.dice AND x.licence < b.licence)))
"""
