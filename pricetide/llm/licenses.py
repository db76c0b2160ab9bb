"""License scans: digests of canonical texts are joined to those of known licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, as (pattern, replacement), applied in this order (fixed values).
SPELLINGS = (
    (r"licen[cs]", "licens"),
    (r"\b(organi|recogni|authori|utili|optimi)s(e|ed|es|ing|ation)\b", "$1z$2"),
    (r"\bsub-licens", "sublicens"),
    (r"\bnon-commercial\b", "noncommercial"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bcopyright (holder|owner)s?\b", "copyright holder"),
    (r"\bv(?:ersion|er)?[. ]*(\d)", "version $1"),
    (r"&", " and "),
    (r"\bhttps?://", ""),
)
#: A line that only states a copyright, or reserves all rights. Words of license texts may follow "copyright" at the begin
#: of a line wherever the text is wrapped; such a line is none.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\r\n©(]*(?:copyright(?![ \t]*(?:holders?|owners?|notices?|laws?|licen[cs]es?|statements?|and|or|is|in|to)\b)\b"
    r"(?=[ \t]*[^ \t\r\n])|\(c\)|©|all rights reserved\b)[^\r\n]*$"
)

#: Names of licenses and how they are written (fixed values).
NAMES = {
    "MIT": ("the MIT License", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache-2.0", "the Apache License 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "GPL-3.0", "GPLv3"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "MPL-2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
}
#: Sentences that put a work under a license (fixed values).
NOTICES = (
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "Published under {}.",
    "This work is licensed under {}.",
    "This work is released under {}.",
    "This project is licensed under {}.",
    "This file is licensed under {}.",
    "SPDX-License-Identifier: {}",
)
#: Whole texts of short licenses, without their copyright lines (fixed values).
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
}


#: A line that is the title of a license.
TITLE = r"^[^\r\n]*\blicen[cs]e[^\r\n]*\r?\n\s*\r?\n"
#: What is looked for: whole texts, single lines, and paragraphs that follow each other.
WHOLE, LINE, RUN = range(3)


def _canonical(part: Column) -> Column:
    part = F.regexp_replace(part, r"\s+", " ")
    for pattern, replacement in SPELLINGS:
        part = F.regexp_replace(part, pattern, replacement)
    return F.trim(F.regexp_replace(part, r"[^\p{L}\p{N}]+", " "))


def _told(text: Column) -> Column:
    """The text in lower case without its copyright lines."""
    return F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, _canonical), lambda part: part != "")


def canonical_lines(text: Column) -> Column:
    """Lines of a text in canonical form, without copyright lines and lines that have no letter or digit."""
    return _kept(F.split(_told(text), r"\r\n|[\r\n]"))


def canonical_paragraphs(text: Column) -> Column:
    """Paragraphs of a text in canonical form, which does not depend on where their lines break."""
    return _kept(F.split(_told(text), r"(?:\r\n|[\r\n])[^\S\r\n]*(?:\r\n|[\r\n])\s*"))


def known_digests(spark: SparkSession) -> DataFrame:
    """Rows (digest, license) of notices and whole texts, with their title and without it: a fixed number."""
    rows = [(name, notice.format(spelt)) for name, ways in NAMES.items() for spelt in ways for notice in NOTICES]
    rows += list(TEXTS.items())
    texts = spark.createDataFrame(rows, "license string, text string")
    bare = texts.select("license", F.regexp_replace("text", f"(?i){TITLE}", "").alias("text"))
    whole = F.array_join(canonical_paragraphs(F.col("text")), " ")
    return texts.unionByName(bare).select(F.sha2(whole, 256).alias("digest"), "license").distinct()


def known_paragraphs(spark: SparkSession) -> DataFrame:
    """Rows (digest, license, part, parts) of the paragraphs of whole texts without their titles: a fixed number."""
    texts = spark.createDataFrame(list(TEXTS.items()), "license string, text string")
    found = canonical_paragraphs(F.regexp_replace("text", f"(?i){TITLE}", ""))
    texts = texts.select("license", found.alias("found"))
    rows = texts.select("license", F.size("found").alias("parts"), F.posexplode("found").alias("part", "paragraph"))
    return rows.select(F.sha2("paragraph", 256).alias("digest"), "license", "part", "parts")


def scan_licenses(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licenses of documents: of the whole text, of lines that are a notice, and of paragraphs that are a license.

    One row per row of `docs`: `doc_id`, `n_lines` (lines that are not empty in canonical form), `text_license`
    (the license that the whole text is, or NULL), `licenses` (names found, sorted, joined by a comma; empty
    if none) and `n_hits` (lines found; the whole text counts if it has more lines than one, and so does each run of
    paragraphs inside a longer text that is a license without its title). Equal means equal but for case, punctuation,
    line breaks, copyright lines and equivalent spellings. NULL and empty texts have no lines; a long text is read
    whole; repeated texts and ids are rows like others; other columns are not looked at. `known` has rows (digest,
    license), is broadcast if Spark finds it small, and has no paragraphs; the built-in tables have a fixed size.
    """
    spark, builtin = docs.sparkSession, known is None
    whole_or_line = (known_digests(spark) if builtin else known).select("digest", "license", F.lit(False).alias("in_run"), F.lit(0).alias("part"), F.lit(0).alias("parts"))
    in_runs = known_paragraphs(spark).select("digest", "license", F.lit(True).alias("in_run"), "part", "parts")
    table = F.broadcast(whole_or_line.unionByName(in_runs)) if builtin else whole_or_line
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A number per row keeps rows with the same id apart.
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        canonical_lines(text).alias("lines"),
        canonical_paragraphs(text).alias("paragraphs"),
    )
    unit = lambda kind: lambda part, place: F.struct(F.lit(kind).alias("kind"), place.alias("place"), F.sha2(part, 256).alias("digest"))
    whole = F.array(unit(WHOLE)(F.array_join("paragraphs", " "), F.lit(0)))
    # A text of one line is that line, and a run is looked for in longer texts.
    lines = F.transform("lines", unit(LINE))
    runs = F.when(F.size("paragraphs") > 1, F.transform("paragraphs", unit(RUN))).otherwise(F.array().cast("array<struct<kind:int,place:int,digest:string>>"))
    size = F.size("lines").cast("long").alias("n_lines")
    units = rows.select("row", "doc_id", size, F.explode(F.concat(whole, lines, runs)).alias("unit"))
    units = units.select("row", "doc_id", "n_lines", "unit.*", (F.col("unit.kind") == RUN).alias("in_run"))
    # Texts are read once: a unit that meets nothing stays, and paragraphs are counted by where their license would begin.
    start = F.when(F.col("in_run"), F.col("place") - F.col("part"))
    met = units.join(table, ["digest", "in_run"], "left").groupBy("row", "doc_id", "n_lines", "kind", "license", "parts", start.alias("start"))
    met = met.agg(F.count("*").alias("n"))
    is_run = F.col("kind") == RUN
    complete = F.col("license").isNotNull() & (~is_run | (F.col("n") == F.col("parts")))
    found = met.groupBy("row", "doc_id", "n_lines").agg(
        F.min(F.when(F.col("kind") == WHOLE, F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(complete, F.col("license")))), ",").alias("licenses"),
        F.coalesce(F.sum(F.when(complete & (F.col("kind") == LINE), F.col("n"))), F.lit(0)).alias("in_lines"),
        F.count(F.when(complete & is_run, 1)).alias("in_runs"),
    )
    # Of a text that is a license as a whole, the run is no other one.
    more = F.when(F.col("text_license").isNull(), F.col("in_runs")).otherwise((F.col("n_lines") > 1).cast("long"))
    return found.select("doc_id", "n_lines", "text_license", "licenses", (F.col("in_lines") + more).alias("n_hits"))
