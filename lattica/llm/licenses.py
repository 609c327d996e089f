"""License scans by canonical digest lookup (operator 9), in DataFrame functions only.

A text is normalised (case, punctuation and white space, copyright lines, equivalent spellings) and
its SHA-256 looked up among those of known licence texts and notices, normalised alike. Whole
documents are matched by a hash join; lines that mention a licence are looked up too, as a notice
is a text of its own within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
NOTICE = r"(?i)licen[cs]e|creative commons|public domain|\bcc[ -](by|0)"

# Spellings that count as equal, as variant and canonical word.
EQUIVALENT = dict(
    line.split()
    for line in """
acknowledgement acknowledgment
analogue analog
analyse analyze
artefact artifact
authorisation authorization
authorised authorized
calibre caliber
cancelled canceled
capitalisations capitalizations
catalogue catalog
categorise categorize
centre center
favour favor
favourite favorite
fulfil fulfill
fulfilment fulfillment
initialise initialize
judgement judgment
labelling labeling
labour labor
licence license
licences licenses
licenced licensed
maximise maximize
modelled modeled
modelling modeling
offence offense
optimise optimize
organisation organization
organise organize
practise practice
programme program
realise realize
recognise recognize
signalling signaling
sublicence sublicense
utilisation utilization
whilst while
wilful willful
https http
""".strip().split("\n")
)

# Licence texts and notices by SPDX id.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form: lower-case words of letters and digits, one space between, without copyright lines."""
    words = F.split(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "")), r"[^\p{L}\p{N}]+")
    pairs = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    same = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(w.isin(list(EQUIVALENT)), F.element_at(pairs, w)).otherwise(w))
    return F.sha2(F.array_join(same, " "), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, known_digest) of KNOWN: a fixed table of some dozens of rows."""
    texts = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(t).alias("text")) for k, t in KNOWN])
    rows = spark.range(1).select(F.explode(texts).alias("known"))
    return rows.select(digest(F.col("known.text")).alias("known_digest"), F.col("known.id").alias("license_id")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license_id, notices) of every row of ``docs``.

    license_id: the licence that the whole text is, or null. notices: the licences of the lines that
    are known notices, sorted, with commas; empty if none. Null texts count as empty, and an empty text is
    no licence. Repeated rows give repeated rows, an empty table an empty result; other columns are ignored.
    """
    known = known_digests(docs.sparkSession)
    by_digest = F.create_map(*[F.lit(x) for r in known.collect() for x in (r["known_digest"], r["license_id"])])  # KNOWN's size
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), digest(text).alias("digest"), F.filter(F.split(text, "\n"), lambda x: x.rlike(NOTICE)).alias("_lines"))
    rows = rows.join(F.broadcast(known), rows.digest == known.known_digest, "left")
    found = F.when(F.size("_lines") > 0, F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("_lines", lambda x: F.element_at(by_digest, digest(x))), lambda x: x.isNotNull()))), ",")).otherwise("")
    return rows.select(id_col, "digest", "license_id", found.alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    line = COPYRIGHT_LINE.replace("(?im)", "")
    pairs = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in EQUIVALENT.items()) + "}"
    words = rf"list_filter(regexp_split_to_array(lower(regexp_replace({text}, {_quoted('(?im)' + line)}, '', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"sha256(array_to_string(list_transform({words}, lambda w: coalesce({pairs}[w], w)), ' '))"


#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH k AS (SELECT known_digest, min(license_id) AS license_id FROM (
       SELECT {_sql_digest("t")} AS known_digest, id AS license_id FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}) v(id, t)) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
      FROM (SELECT doc_id, {_sql_digest("line")} AS h FROM l WHERE regexp_matches(line, {_quoted(NOTICE)})) l JOIN k ON l.h = k.known_digest GROUP BY l.doc_id),
g AS (SELECT doc_id, {_sql_digest("text")} AS digest FROM d)
SELECT g.doc_id, g.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM g LEFT JOIN k ON g.digest = k.known_digest LEFT JOIN n ON g.doc_id = n.doc_id
"""
