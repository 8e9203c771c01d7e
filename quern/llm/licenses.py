"""Licence scans by canonical digest: a text in canonical form is hashed and joined to the digests of known licences.

The canonical form drops what does not change a licence: case, white space and so line breaks, punctuation, comment and
list marks, notices of copyright, a title, whose name stands in a disclaimer, and which of several usual spellings a word
has. Whole texts are joined by digest; each line of a text is looked up too, which finds the one-line notices that stand
within other texts. All of it is native expressions.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the canonical form, in order, on a text in lower case. A step is a pattern and what comes for it
#: (Java's, RE2's and Python's engines read them alike), or, where ``plain`` is first, a string and another.
CANONICAL: list[tuple[str, ...]] = [
    # lines that are notices: a sign or a year follows the word
    (r"(^|\n)[^a-z0-9\n\x{A9}(]*(portions )?(copyright[ \t:,]*(\(c\)|\x{A9}|[<\[{]?(yyyy|year|[0-9]{4}))|(\(c\)|\x{A9})[ \t]*[0-9]{4})[^\n]*", "\n"),
    ("plain", "&", " and "),
    (r"[ \t\r\n\x0b\x0c]+", " "),
    # numbers and letters of a list, but not those that name a version or a section
    (r"(version|sections?|clause|paragraph|license|licence) ([0-9])", r"\1\2"),
    (r"(^| )\(?([0-9]{1,2}|[a-z]|[ivx]{2,4})[.)] ", " "),
    (r"[^a-z0-9\x{C0}-\x{1FFF}\x{2070}-\x{24FF}\x{2600}-\x{10FFFF}]+", " "),
    ("plain", "all rights reserved", ""),
    ("plain", "licence", "license"),
    ("plain", "sub license", "sublicense"),
    ("plain", "per cent", "percent"),
    ("plain", "copyright owner", "copyright holder"),
    ("plain", "organisation", "organization"),
    ("plain", "acknowledgement", "acknowledgment"),
    ("plain", "favour", "favor"),
    ("plain", "https ", "http "),
    # names that each holder puts in for their own
    (r"neither the names? of .{1,120}? nor the names? of .{1,60}? may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"provided by .{1,120}? as is", "provided by the copyright holders and contributors as is"),
    (r"in no event shall .{1,120}? be liable", "in no event shall the authors be liable"),
    (r"^ *(the )?(mit|expat|isc|zlib|zlib libpng|((new|simplified|modified|revised) )?((bsd )?(zero|[0234]) clause )?bsd|bsd (zero|[0234]) clause) license( mit| expat| isc| new bsd)? ", ""),
    (r" +", " "),
    (r"^ | $", ""),
]
#: Every known one-line notice holds one of these in lower case; other lines need no canonical form.
HINTS = ("licen", "cc0")
#: Most known texts: their digests are a literal of the plan and go to every task.
MOST_KNOWN = 10_000

#: Digests of the canonical forms of long public licences, by SPDX identifier. Of Apache-2.0 the second
#: is that of the text without the appendix.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "fc207de7a9e1c008c06538ab70c985accaf1839cfca6f5f33509b48e62687575"),
    ("Apache-2.0", "c9a5823b63b0e98f46a0d930399bea46b23bb5f4ea81dac26180c4d99bd8df47"),
    ("Artistic-1.0-Perl", "314980d8dde67987f829e66043c6143a67ac391980903dd4b261566e70c5889c"),
    ("CC0-1.0", "b9de395036b42fbe05e5c2da5ef535a7bc23b4ec9ff9874644e09caa6c6122d1"),
    ("GFDL-1.2-or-later", "f139164c8719179262a4adbad77939120b7d9b8a828f5432f86a68c9a530c9e2"),
    ("GFDL-1.3-or-later", "acac33267acbc7695520950931260e1be19cb4a2d94e93460359111b97e675da"),
    ("GPL-1.0-only", "c95b1d0834745411ab6c26624bf938a84d2fca351a96fd3b674c4f040ecf2430"),
    ("GPL-2.0-only", "c7346a981170f07a571059d9856dd457a486e03a2e2e353178eaa8198114034e"),
    ("GPL-3.0-only", "a21157a597e3bbb5dcfac8928612b8f528c715b4e18b2adcca866ff0bc4ba442"),
    ("LGPL-2.0-only", "810b6425b7376701c06320ae437ab88a7d80bd3e4a5b7663aae4acfc6d76fc44"),
    ("LGPL-2.1-only", "f70aaaa8a1fdb1f54f5d478d5feab32520b2b5ec3c9c7f1dd368e3c1cb8155e3"),
    ("LGPL-3.0-only", "2f6cbed106e1f72a5e0556018ce5bbda991e793e5feba8f4eae45b022b54ce1a"),
    ("MPL-1.1", "87c7b8c305a0698fccdccf2f2557212d7ef8f47902a5c50b34e354f351b5a334"),
    ("MPL-2.0", "eff0acb9d0a112c5873292a45f4ebba6630345ea852f1d9cf8b32fa4233ed0f7"),
]

#: Public licence texts and notices, by SPDX identifier.
KNOWN: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0.'),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
]


def _step(engine: str, step: tuple[str, ...]) -> tuple[str, str]:
    """Pattern and replacement as ``engine`` (java, re2, python) writes them."""
    pattern, to = step
    if engine == "python":
        pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
    return pattern, re.sub(r"\\([0-9])", r"$\1", to) if engine == "java" else to


def canonical(text: Column) -> Column:
    """The canonical form of a text, as an expression; null for null."""
    out = F.lower(text)
    for step in CANONICAL:
        out = F.replace(out, F.lit(step[1]), F.lit(step[2])) if step[0] == "plain" else F.regexp_replace(out, *_step("java", step))
    return out


def canonical_text(text: str) -> str:
    """The same of one text, for what a plan or a test needs beforehand."""
    out = text.lower()
    for step in CANONICAL:
        out = out.replace(step[1], step[2]) if step[0] == "plain" else re.sub(*_step("python", step), out)
    return out


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known_digests(known: list[tuple[str, str]] | None = None) -> dict[str, str]:
    """Licence by SHA-256 of its canonical text; of several with one digest the first. None: KNOWN and DIGESTS."""
    found: dict[str, str] = {}
    for name, text in KNOWN if known is None else known:
        found.setdefault(digest_of(text), name)
    for name, digest in DIGESTS if known is None else []:
        found.setdefault(digest, name)
    return found


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, digest (SHA-256 of the whole text's canonical form), license (whose text
    it is, else null), notices (licences of which a line of the text is a notice, sorted, each once).

    ``known``: (name, text) of at most MOST_KNOWN licences; none at all find nothing. Null texts are empty; texts that
    the canonical form leaves empty have a digest, no licence and no notices. Repeated rows fare alike; ids may be null
    and of any name but those of the other three columns; other columns are ignored. A line is what stands between ``\\n``.
    """
    digests = known_digests(known)
    if len(digests) > MOST_KNOWN:
        raise ValueError(f"{len(digests)} known texts; {MOST_KNOWN} go to every task at most")
    entries = F.array(*(F.struct(F.lit(d).alias("known"), F.lit(n).alias("license")) for d, n in digests.items())).cast("array<struct<known: string, license: string>>")
    table = docs.sparkSession.range(1).select(F.inline(entries))
    hinted = all(any(h in text.lower() for h in HINTS) for _, text in known or []) if known is not None else True
    rows = docs.select(F.col(id_col).alias("_quern_id"), F.coalesce(text_col, F.lit("")).alias("t"))
    names = F.map_from_entries(entries)
    hit = lambda x: reduce(Column.__or__, (F.contains(F.lower(x), F.lit(h)) for h in HINTS))
    lines = F.split("t", "\n")
    found = F.transform(F.filter(lines, hit) if hinted else lines, lambda x: F.try_element_at(names, F.sha2(canonical(x), 256)))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    notices = F.when(hit(F.col("t")), found).otherwise(F.array().cast("array<string>")) if hinted else found
    scanned = rows.select("_quern_id", F.sha2(canonical(F.col("t")), 256).alias("_quern_digest"), notices.alias("notices"))
    met = scanned.join(F.broadcast(table), F.col("_quern_digest") == F.col("known"), "left")
    return met.select(F.col("_quern_id").alias(id_col), F.col("_quern_digest").alias("digest"), "license", "notices")


def oracle() -> str:
    """DuckDB's SQL for ``license_scan`` over ``documents``, with notices joined by a comma."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def form(text: str) -> str:
        out = f"lower({text})"
        for step in CANONICAL:
            if step[0] == "plain":
                out = f"replace({out}, {quoted(step[1])}, {quoted(step[2])})"
            else:
                pattern, to = _step("re2", step)
                out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
        return out

    known = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in known_digests().items())
    return f"""
WITH known(digest, license) AS (VALUES {known}),
rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM rows),
found AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON known.digest = sha256({form("line")}) GROUP BY rid),
whole AS (SELECT rid, doc_id, sha256({form("t")}) AS digest FROM rows)
SELECT doc_id, whole.digest, license, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (rid)
"""
