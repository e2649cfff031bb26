"""Licence scans: segments of a text against licence templates by the Dice coefficient over word bigrams.

A text is cut into lines, sentences of lines and paragraphs, and is a segment as a whole too, which is how a licence file
is met; each is normalised (A-Z lower-cased, other characters than
letters a-z and digits become spaces) and turned into its set of word bigrams. Dice at THRESHOLD or more needs sizes
within a factor of (2 - THRESHOLD) / THRESHOLD, so each segment meets only templates of like size, and segments larger
or smaller than all templates allow meet none. Before that, whole texts are passed over if they hold no key word: each
template has enough key words that a segment without any of them cannot share the bigrams that THRESHOLD needs.

Defined results: a null or empty text matches nothing; repeated rows and null doc_ids are scanned row by row; equal
scores go to the template that comes first; an empty table gives an empty result; extra columns are ignored; whole
texts of any length are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.quality import let

THRESHOLD = 0.7
# Wording of public licences and of the usual notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT license, see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Copyright (c). Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Copyright (c). Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Copyright. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
)
#: Words too common to be key words.
COMMON = frozenset("a above all an and any appear are as at be by can copies copy either for form forms free in is it later may of on only or other out project provided s source that the this to under use version v with without work you 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Sizes of sets that can reach the threshold with a set of that size."""
    ratio = (2 - threshold) / threshold
    return size / ratio, size * ratio


def key_words(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which every segment that reaches the threshold with some template has one."""
    keys: set[str] = set()
    for grams in templates:
        # at the smallest size allowed a segment shares at least this many bigrams
        least = threshold * (bounds(len(grams), threshold)[0] + len(grams)) / 2
        own = {w for g in grams for w in g.split()} - COMMON
        bare = lambda k: sum(not (set(g.split()) & k) for g in grams)
        chosen = own & keys
        while bare(chosen) >= least:
            left = sorted(own - chosen, key=lambda w: (-sum(w in g.split() and not (set(g.split()) & chosen) for g in grams), w))
            if not left:
                raise ValueError("a template has too few key words")
            chosen.add(left[0])
        keys |= chosen
    return sorted(keys)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def _bigrams(segment: Column) -> Column:
    def pairs(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))

    return let(F.split(_normal(segment), " "), pairs)


HIT = "array<struct<licence:string,dice:double,segment:string>>"


def hits_of(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array of struct(licence, dice, segment): the best template of each segment that reaches the threshold."""
    made = [(name, bigrams_of(body)) for name, body in templates]
    sizes = [bounds(len(g), threshold) for _, g in made]
    low, high = min(s[0] for s in sizes), max(s[1] for s in sizes)
    shelf = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(k).alias("k"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for k, (name, g) in enumerate(made)])
    keys = "|".join(map(re.escape, key_words([g for _, g in made], threshold)))
    ratio = (2 - threshold) / threshold

    def best(segment: Column, grams: Column) -> Column:
        n = F.size(grams)
        fit = F.filter(shelf, lambda t: (t["n"] <= n * ratio) & (n <= t["n"] * ratio))
        scored = F.transform(fit, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(t["grams"], grams)) / (t["n"] + n)).alias("dice"), (-t["k"]).alias("k"), t["licence"].alias("licence")))
        top = F.array_max(scored)
        return let(top, lambda x: F.when(x["dice"] >= threshold, F.struct(x["licence"].alias("licence"), x["dice"].alias("dice"), segment.alias("segment"))))

    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.;!?])\s+")))
    paragraphs = F.split(text, r"\n\s*\n")
    segments = F.array_distinct(F.filter(F.transform(F.concat(lines, sentences, paragraphs, F.array(text)), F.trim), lambda x: (F.length(x) >= 3) & x.rlike(f"(?i)(?<![A-Za-z0-9])(?:{keys})(?![A-Za-z0-9])")))
    scored = F.transform(segments, lambda s: let(_bigrams(s), lambda g: F.when(F.size(g).between(low, high), best(s, g))))
    found = F.filter(scored, lambda x: x.isNotNull())
    return F.when(text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{keys})(?![A-Za-z0-9])"), found).otherwise(F.array().cast(HIT))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and hits of every row of docs(doc_id, text)."""
    return docs.select("doc_id", F.coalesce(hits_of(F.col("text"), templates, threshold), F.array().cast(HIT)).alias("hits"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["licence"])))
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        F.array_join(names, ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )
