"""Licence scan by canonical digest: whole texts, normalised, against digests of known licences.

Two copies of a licence differ in case, punctuation, line breaks, the copyright
line and a few spellings. All of these are normalised with built-in functions,
and the digest of what is left is looked up in a table of known digests of fixed
size. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import whole_text

#: Spellings that licence matching guidelines hold to be equal.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sub license": "sublicense", "sub licence": "sublicense", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized", "favour": "favor", "honour": "honor",
    "organisation": "organization", "recognised": "recognized", "whilst": "while", "wilful": "willful", "merchantibility": "merchantability", "non infringement": "noninfringement", "per cent": "percent", "copyright owner": "copyright holder", "copyright owners": "copyright holders",
}
#: Marks beyond ASCII that count as punctuation.
MARKS = "‘’“”–—…•·«» ﻿"
#: A line that names a holder; its words differ from copy to copy.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]|©)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Fixed values: (id, text) of known licences and of notices that stand for one. Long licences
#: (the full texts of Apache-2.0, MPL-2.0 and the GNU licences) come in through `known`.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT-0", "MIT No Attribution\n\n" + _MIT_GRANT + "." + _MIT_WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def canonical(text: Column) -> Column:
    """The normalised text: lower-case words one space apart, without copyright lines, in one spelling."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(" "))
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, PUNCTUATION, " ")), F.lit(" "))
    for old, new in [*EQUIVALENT.items(), ("all rights reserved", "")]:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} " if new else " "))
    return F.trim(out)


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, license_id) for each row; license_id is null if no known licence has the text's digest.

    known: (id, text) pairs; they are normalised by the same expressions, and
    the table of their digests is broadcast (as many rows as pairs, few by
    nature). Of several ids for one digest the least is returned, so each row
    comes back once. Null and empty texts have the digest of the empty text; a
    known text that is empty matches nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string").select("license_id", canonical(whole_text()).alias("text"))
    digests = table.where("text <> ''").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.sha2(canonical(whole_text(text_column)), 256).alias("digest"))
    return rows.join(F.broadcast(digests), "digest", "left").select("doc_id", "digest", "license_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql() -> str:
    """The same in DuckDB SQL."""

    def norm(text: str) -> str:
        out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        for mark in MARKS:
            out = f"replace({out}, {_quoted(mark)}, ' ')"
        out = f"' ' || trim(regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g')) || ' '"
        for old, new in [*EQUIVALENT.items(), ("all rights reserved", "")]:
            out = f"replace({out}, ' {old} ', {_quoted(f' {new} ' if new else ' ')})"
        return f"trim({out})"

    values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)
    return f"""
    WITH known AS (SELECT sha256(c) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {norm("text")} AS c FROM (VALUES {values}) AS v(license_id, text)) WHERE c <> '' GROUP BY 1),
    scanned AS (SELECT doc_id, sha256({norm("coalesce(text, '')")}) AS digest FROM documents)
    SELECT doc_id, s.digest, license_id FROM scanned s LEFT JOIN known k ON s.digest = k.digest
    """
