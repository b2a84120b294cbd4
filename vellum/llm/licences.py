"""Licence scan: canonical digests of whole texts and of their lines, hash-joined to known licences.

Canonical form, by line: copyright statements and the numbers or marks of lists dropped, lower case, equivalent spellings
made one, everything but letters and digits made single spaces. A text's form is its lines' joined by a space, without
lines that are only a licence's title or reserve all rights, so neither line breaks nor headings matter. A text is a
licence if its form's digest is a known one; each line that is a known notice counts as well. DataFrame functions only.

`known_licences` holds the short licences whole; longer ones are given as (name, text) rows.

Cases: null, empty and blank texts have a null digest and match nothing; repeated rows each keep their row; a null
doc_id keeps its row too; an empty table gives an empty result; texts are whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common

#: Known licences are broadcast up to this many rows (a digest and a name each), else joined by a shuffle.
BROADCAST_ROWS = 200_000

# A copyright statement, the number or mark of a list's entry (RE2 and Java alike), and titles in canonical form.
COPYRIGHT_LINE = r"(?i)^[^a-z0-9]*(copyright[ \t]*(\(c\)|©|[12][0-9]{3}|by[ \t]|<|\[y)|\(c\)[ \t]|©)"
LIST_MARK = r"^[ \t]*([0-9]{1,2}[.)]|\([0-9a-z]\)|[*•-])[ \t]+"
TITLES = [
    "mit license", "the mit license", "mit license mit", "the mit license mit", "isc license", "the isc license", "bsd 2 clause license", "bsd 3 clause license", "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license", "new bsd license",
    "bsd zero clause license", "zero clause bsd", "zlib license", "the zlib license", "boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "the unlicense", "unlicense", "license", "all rights reserved",
]
# Spellings that licences use for the same thing, in order.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("http:", "https:"), ("&", " and "), ("per cent", "percent"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("whilst", "while"),
]

# Short notices as people write them under a text, by SPDX identifier or a plain name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("all-rights-reserved", "All rights reserved."),
]
# Whole licence texts in the public form, some of which share parts.
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
]


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, in order; lines that leave nothing are left out."""

    def line(x: Column) -> Column:
        out = F.lower(F.regexp_replace(x, LIST_MARK, ""))
        for old, new in SPELLINGS:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))

    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.rlike(x, F.lit(COPYRIGHT_LINE)))
    return F.filter(F.transform(kept, line), lambda x: x != "")


def digest(lines: Column) -> Column:
    """Digest of a text by its canonical lines but titles; null where nothing is left."""
    body = F.filter(lines, lambda x: ~x.isin(TITLES))
    return F.when(F.size(body) > 0, F.sha2(F.array_join(body, " "), 256))


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(known_digest, licence) of canonical digests; a digest that two names claim goes to the first by name."""
    rows = spark.createDataFrame(NOTICES + TEXTS if texts is None else texts, "licence string, text string")
    lines = canonical_lines(F.col("text"))
    # A notice that is itself a title, such as the reservation of all rights, is known as a line.
    own = F.coalesce(digest(lines), F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256)))
    return rows.select(own.alias("known_digest"), "licence").where("known_digest IS NOT NULL").groupBy("known_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, text_licence, line_licences, n_licence_lines): the licence that the whole text is, if any; the
    names and the number of the different known lines in it.

    Known digests are few, so both joins hash them; only lines that match are shuffled, to their document's row.
    """
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("raw"), canonical_lines(F.col(text_col)).alias("lines"))
    rows = rows.select("doc_id", "raw", digest(F.col("lines")).alias("digest"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("line_digests"))
    whole = rows.join(known, rows["digest"] == known["known_digest"], "left").select("doc_id", "raw", "digest", F.col("licence").alias("text_licence"))
    lines = rows.select("doc_id", "raw", F.explode("line_digests").alias("line_digest")).join(known, F.col("line_digest") == known["known_digest"])
    found = lines.groupBy(F.col("doc_id").alias("i"), F.col("raw").alias("r")).agg(F.collect_set(F.struct("line_digest", "licence")).alias("found"))  # no more than are known
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("raw").eqNullSafe(F.col("r")), "left")
    names = F.sort_array(F.array_distinct(F.transform("found", lambda x: x["licence"])))
    return joined.select("doc_id", "digest", "text_licence", F.coalesce(F.array_join(names, ","), F.lit("")).alias("line_licences"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licence_lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known_licences(spark))


def sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    line = f"lower(regexp_replace(x, {quoted(LIST_MARK)}, ''))"
    for old, new in SPELLINGS:
        line = f"replace({line}, {quoted(old)}, {quoted(new)})"
    lines = lambda text: f"list_filter(list_transform(list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(x, {quoted(COPYRIGHT_LINE)})), lambda x: trim(regexp_replace({line}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda x: x <> '')"
    body = f"list_filter(lines, lambda x: x NOT IN ({', '.join(map(quoted, TITLES))}))"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in NOTICES + TEXTS)
    return f"""
WITH known AS (SELECT sha256(array_to_string(CASE WHEN len({body}) > 0 THEN {body} ELSE lines END, ' ')) AS known_digest, min(licence) AS licence FROM (SELECT licence, {lines("t")} AS lines FROM (VALUES {values}) v(licence, t)) GROUP BY 1),
rows AS (SELECT doc_id, row_number() OVER () AS n, lines, {body} AS body FROM (SELECT doc_id, {lines("text")} AS lines FROM documents)),
found AS (SELECT n, list(DISTINCT licence ORDER BY licence) AS names, count(DISTINCT known_digest) AS hits
  FROM (SELECT n, unnest(lines) AS line FROM rows) l JOIN known ON sha256(line) = known_digest GROUP BY n)
SELECT doc_id, CASE WHEN len(body) > 0 THEN sha256(array_to_string(body, ' ')) END AS digest, k.licence AS text_licence,
  coalesce(array_to_string(names, ','), '') AS line_licences, coalesce(hits, 0)::BIGINT AS n_licence_lines
FROM rows LEFT JOIN known k ON len(body) > 0 AND sha256(array_to_string(body, ' ')) = k.known_digest LEFT JOIN found USING (n)"""
