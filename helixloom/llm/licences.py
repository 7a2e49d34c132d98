"""Licence scan: the digest of a text's canonical form is looked up among those of known licences.

Canonical form, in this order: lower case; lines that state a copyright or reserve all rights go; every run
of other than letters and digits becomes one space; equivalent spellings become one. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as equal, from the public SPDX matching guidelines.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analog": "analogue", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalog": "catalogue",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favor": "favour", "favorite": "favourite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "sub license": "sublicense", "sub licence": "sublicense",
    "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder", "https": "http",
}

_CLAIM = r"(^|\n)[ \t\r*#/;%-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]*[0-9]|©)[^\n]*"
_RESERVED = r"(^|\n)[ \t\r*#/;%-]*all rights reserved[.]?[ \t\r]*"
_OTHER = r"[^\p{L}\p{N}]+"
_ANY = r"\b(" + "|".join(EQUIVALENT) + r")\b"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: (identifier, text): public licence texts, standard notices and one-line statements.
LICENCES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-or-later", _GPL_NOTICE.format(v=2)),
    ("GPL-3.0-or-later", _GPL_NOTICE.format(v=3)),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
]


def _respelled(text: Column) -> Column:
    for a, b in EQUIVALENT.items():
        text = F.regexp_replace(text, rf"\b{a}\b", b)
    return text


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, _CLAIM, "\n"), _RESERVED, "\n"), _OTHER, " "))
    return F.when(plain.rlike(_ANY), _respelled(plain)).otherwise(plain)


def canonical_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    sql = f"lower(coalesce({text}, ''))"
    for pattern, by in ((_CLAIM, "chr(10)"), (_RESERVED, "chr(10)"), (_OTHER, "' '")):
        sql = f"regexp_replace({sql}, '{pattern}', {by}, 'g')"
    sql = f"trim({sql})"
    for a, b in EQUIVALENT.items():
        sql = rf"regexp_replace({sql}, '\b{a}\b', '{b}', 'g')"
    return sql


def known(spark) -> DataFrame:
    """(canonical_sha256, license_id): a row per known digest; as many rows as LICENCES at most."""
    rows = spark.createDataFrame(LICENCES, "license_id string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), "license_id").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical_sha256, license_id): one row per row of docs; license_id is null where none matches.

    Whole texts are compared, by digest. licences has columns canonical_sha256 (distinct) and license_id; without
    it the built-in list is used, which is broadcast as its length is fixed. Null and empty texts share a digest
    that no licence has. An empty table gives no rows; other columns are not read.
    """
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(canonical(F.col(f"`{text_col}`")), 256).alias("canonical_sha256"))
    table = F.broadcast(known(docs.sparkSession)) if licences is None else licences.select("canonical_sha256", "license_id")
    return found.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
