"""Whole texts that are known licences, by digest of a canonical form.

Everything is DataFrame functions: the canonical form is a chain of regular expressions, its SHA-256 digest is joined
to the digests of the known texts.  The table of known texts is fixed, so broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence texts and notices, by SPDX identifier.
KNOWN = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Zero-Clause BSD

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

_MIT_BODY, _BSD = KNOWN["MIT"].partition("\n")[2], KNOWN["BSD-2-Clause"].partition("\n")[2]
_BSD_3 = _BSD.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
#: Usual titles, and texts without one, beside those of KNOWN; the SQL knows KNOWN only.
VARIANTS = [
    *[("MIT", title + _MIT_BODY) for title in ("", "The MIT License\n", "The MIT License (MIT)\n", "MIT License (MIT)\n")],
    *[("BSD-2-Clause", title + _BSD) for title in ("", "The 2-Clause BSD License\n", "BSD-2-Clause License\n", "Simplified BSD License\n")],
    *[("BSD-3-Clause", title + _BSD_3) for title in ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n", "BSD-3-Clause License\n")],
    ("ISC", KNOWN["ISC"].partition("\n")[2]),
    ("ISC", "The ISC License\n" + KNOWN["ISC"].partition("\n")[2]),
]
#: SHA-256 of the canonical form of full licence texts, as Debian ships them in /usr/share/common-licenses.
FULL = {
    "Apache-2.0": "bf1bd8e70f9e48b7c553fd9a59e5bf6a5e5e610f21f0efe52c6b9ba138c42ea6",
    "GPL-2.0": "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123",
    "GPL-3.0": "af9d1e7b0a50a8d8687f8a8570d57d3873edbaa2f7b25edc80097a1bdb1de91b",
    "LGPL-2.0": "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769",
    "LGPL-2.1": "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f984389a723626d357385bd0262673e78df7b908492157a5e99a47ed8d0d4c0e",
    "MPL-2.0": "b59ad31436b35a95a00cff48e84c1f014339f59fac784c1935fc6f7dc34abf70",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
}

#: Pattern and replacement of each step, in order, on text with A-Z lowered; Java and RE2 read them alike.
STEPS = [
    (r"\r\n?", "\n"),
    # Lines that only claim copyright.
    (r"(?m)^[^a-z0-9\n]*(copyright|copr\.?|\(c\)|©)[^\n]*(<year>|[0-9]{4}|\(c\)|©|all rights reserved)[^\n]*$", " "),
    (r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", " "),
    (r"https?://(www\.)?", ""),
    (r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’«»–—]+", " "),
    # Equivalent spellings.
    (r"\b(sub)?licenc(e|es|ed|ing|ee|ees|or|ors)\b", "${1}licens${2}"),
    (r"\bcopyright (holder|owner)s?\b", "copyright holder"),
    (r"\backnowledgement(s?)\b", "acknowledgment${1}"),
    (r"\bnon (commercial|infringement)\b", "non${1}"),
    (r"\bsub (licens)", "sub${1}"),
    (r"\b(organ|recogn|author|util|custom)is(e|es|ed|ing|ation|ations)\b", "${1}iz${2}"),
    (r"\b(fav|hon|behavi|col)our(s?)\b", "${1}or${2}"),
    (r"\b(fulfil|instal)(s|ment)?\b", "${1}l${2}"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\s+", " "),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, one spelling, single spaces; null is empty."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, _java(replacement))
    return F.trim(out)


def _java(replacement: str) -> str:
    return replacement.replace("${1}", "$1").replace("${2}", "$2")


def known(docs: DataFrame) -> DataFrame:
    """``digest, license_id`` of the fixed texts, by the same expression as for documents, and of FULL."""
    rows = docs.sparkSession.createDataFrame([*KNOWN.items(), *VARIANTS], "license_id string, body string")
    full = docs.sparkSession.createDataFrame(list(FULL.items()), "license_id string, digest string")
    every = rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license_id").union(full.select("digest", "license_id"))
    return every.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def matched(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``canonical_sha256, license_id`` (null: no known licence), for every row.

    - Only whole texts match: a licence with anything beside copyright lines and punctuation added does not.
    - Null, empty and unmarked texts have the digest of the empty text, which is no licence.
    - Repeated rows each get their result; columns with the new names are replaced; no rows give no rows.
    """
    docs = docs.drop("canonical_sha256", "license_id").withColumn("canonical_sha256", F.sha2(canonical(F.col("text")), 256))
    table = known(docs).select(F.col("digest").alias("_digest"), "license_id")
    return docs.join(F.broadcast(table), F.col("canonical_sha256") == F.col("_digest"), "left").drop("_digest")


def sql(text: str) -> str:
    """The canonical form as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, replacement in STEPS:
        rewritten = replacement.replace("${1}", r"\1").replace("${2}", r"\2")
        newline = "chr(10)" if replacement == "\n" else quote(rewritten)
        out = f"regexp_replace({out}, {quote(pattern)}, {newline}, 'g')"
    return f"trim({out})"
