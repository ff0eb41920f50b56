"""Licence scan by canonical digest, on built-in functions only.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings) and its SHA-256 is joined with the digests of known
licence texts. The whole document is one text. So is each of its lines, since
notices are mostly one line within other prose. A longer known text may stand
anywhere between other words, wrapped as it likes: where its first words occur,
as many characters of the canonical form as it has are one text more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import let

#: Wording that several licences share.
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details."

#: Known licence texts, file headers and notices (public wording), by SPDX id.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + BSD_DISCLAIMER),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + GNU_WARRANTY.format("General")),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version." + GNU_WARRANTY.format("General")),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + GNU_WARRANTY.format("Affero General")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)

#: Spellings that count as equal (Java and RE2 pattern, replacement), applied in order to canonical words.
EQUIVALENT = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("v([0-9])", "version $1"), ("ver([0-9])", "version $1"))

#: Each known text has one of these words.
HINT = r"(?i)licen[sc]e|permission|permitted|warrant"

#: A line that only states a copyright (with a sign or a year) or all rights does not belong to the canonical form,
COPYRIGHT = r"(?im)^[ \t#*/;-]*(copyright[ \t:,]*(\(c\)|©|[0-9]{4}|[<\[]y)[^\n]*|\(c\)[ \t]*(copyright[ \t]*)?[0-9][^\n]*|©[^\n]*|all rights reserved\.?[ \t\r]*)$"
#: nor does one that is only the name of a licence.
HEADING = r"(?im)^[ \t#*/;=-]*(the[ \t]+)?(mit|expat|x11|isc|zlib|zero-clause bsd|(new |simplified |modified )?bsd([ \t]+[0-9]-clause)?|[0-9]-clause bsd|boost software)[ \t]+licen[sc]e([ \t]*\([^\n()]{1,30}\))?[ \t]*:?[ \t\r]*$"
#: Known texts of at least so many characters in canonical form are found inside other texts too, by so many first words.
LONG, ANCHOR = 150, 5


def canonical(text: Column) -> Column:
    """Lower-case words and numbers, one space apart, without headings and copyright lines."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, " "), HEADING, " ")
    plain = F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))
    for spelled, same in EQUIVALENT:
        plain = F.regexp_replace(plain, rf"\b{spelled}\b", same)
    return plain


def canonical_text(text: str) -> str:
    """The same of one known text, for the patterns of the scan."""
    plain = re.sub(HEADING, " ", re.sub(COPYRIGHT, " ", text))
    plain = re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip(" ")
    for spelled, same in EQUIVALENT:
        plain = re.sub(rf"\b{spelled}\b", same.replace("$", "\\"), plain)
    return plain


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for a text without words."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license); of two ids with one digest the least stays. Its size is that of the list given."""
    for name, text in known:
        if not re.search(HINT, text):
            raise ValueError(f"known text of {name} has no word of HINT, so the scan could not find it")
    table = spark.createDataFrame(list(known), "license string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "license").where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def runs(form: Column, known=KNOWN) -> Column:
    """The runs of words of a canonical form that may be long known texts: they begin like one and have its length."""
    padded = F.concat(F.lit(" "), form, F.lit(" "))
    starts = {(" " + " ".join(c.split()[:ANCHOR]) + " ", len(c)) for c in (canonical_text(t) for _, t in known) if len(c) >= LONG}

    def at(anchor: str, length: int) -> Column:
        def places(parts: Column) -> Column:
            ends = F.aggregate(
                F.slice(parts, 1, F.size(parts) - 1),
                F.struct(F.lit(1 - len(anchor)).alias("end"), F.array().cast("array<int>").alias("all")),
                lambda a, x: F.struct((a["end"] + len(anchor) + F.length(x)).alias("end"), F.concat(a["all"], F.array(a["end"] + len(anchor) + F.length(x))).alias("all")),
                lambda a: a["all"],
            )
            whole = F.filter(ends, lambda p: F.substring(padded, p + 1 + length, F.lit(1)) == " ")
            return F.transform(whole, lambda p: F.substring(padded, p + 1, F.lit(length)))

        return F.when(padded.contains(anchor), let(F.split(padded, anchor, -1), places)).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array().cast("array<string>"), *[at(*x) for x in sorted(starts)])


def scan_licenses(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, license, scope, n_found: one row for each licence that a document's text (scope ``text``), lines of it (``line``) or runs of words in it (``part``) are.

    Nothing is returned for null or empty texts and for those without a known
    licence. Repeated rows of a doc_id are one document whose finds add up. Of
    two ids with one digest the least is given. Extra columns are ignored. Only
    texts and lines with a word of ``HINT`` are brought to canonical form, which
    loses nothing: each known text has one. A run is a known text of ``LONG``
    characters or more that is not the whole text.
    """
    digests = known_digests(docs.sparkSession, known)
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(HINT))
    form = let(canonical(F.col("text")), lambda c: F.struct(c.alias("whole"), F.filter(runs(c, known), lambda x: x != c).alias("runs")))
    scoped = F.concat(F.array(F.struct(F.lit("text").alias("scope"), F.col("f.whole").alias("form"))), F.transform("f.runs", lambda x: F.struct(F.lit("part").alias("scope"), x.alias("form"))))
    whole = texts.select("doc_id", form.alias("f")).select("doc_id", F.explode(scoped).alias("s")).select("doc_id", "s.scope", "s.form")
    lines = texts.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(HINT))
    lines = lines.select("doc_id", F.lit("line").alias("scope"), canonical(F.col("line")).alias("form"))
    found = whole.unionByName(lines).where("form <> ''").select("doc_id", "scope", F.sha2("form", 256).alias("digest")).join(F.broadcast(digests), "digest")
    return found.groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n_found"))


def _oracle() -> str:
    """The same over DuckDB, with runs counted by containment: each word stands between spaces of its own."""

    def form(x: str) -> str:
        for pattern in (COPYRIGHT, HEADING):
            x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
        x = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
        for spelled, same in EQUIVALENT:
            x = f"regexp_replace({x}, '\\b{spelled}\\b', '{same.replace('$', chr(92))}', 'g')"
        return x

    spaced = lambda x: f"(' ' || replace({x}, ' ', '  ') || ' ')"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
WITH known AS (SELECT form, min(license) AS license FROM (SELECT {form("text")} AS form, license FROM (VALUES {values}) v(license, text)) GROUP BY 1),
parts AS (
  SELECT doc_id, text AS part, 'text' AS scope FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), 'line' FROM documents WHERE text IS NOT NULL
), forms AS (SELECT doc_id, scope, {form("part")} AS form FROM parts),
found AS (
  SELECT doc_id, license, scope, 1 AS n FROM forms JOIN known USING (form) WHERE form <> ''
  UNION ALL SELECT doc_id, license, 'part', (length({spaced("f.form")}) - length(replace({spaced("f.form")}, {spaced("k.form")}, ''))) // length({spaced("k.form")})
    FROM forms f JOIN known k ON length(k.form) >= {LONG} AND f.form <> k.form AND contains({spaced("f.form")}, {spaced("k.form")}) WHERE scope = 'text'
)
SELECT doc_id, license, scope, CAST(sum(n) AS BIGINT) AS n_found FROM found GROUP BY ALL
"""


ORACLE_SQL = _oracle()
