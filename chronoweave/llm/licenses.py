"""Licence scan by canonical digests.

A text is brought to a canonical form: A-Z in lower case, lines that only state a copyright removed, equivalent spellings
unified, and everything but letters and digits made one space.  The SHA-256 of the whole canonical text is joined with the digests of known licences, which
get the same treatment; a text that is not known so is looked up once more without the titles and copyright statements it begins with.
Known are ``KNOWN`` and the files of ``license_texts``, these also without what follows their terms; the SQL form knows ``KNOWN`` only, as it
stands.  Built-in functions only; texts are not shuffled.

Defined cases: null text has a null digest and no licence; a text that is empty in canonical form has the digest of the empty string
and no licence; known texts with equal digests give the smallest licence id; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

# Spellings that count as one.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("acknowledgement", "acknowledgment"),
    ("non commercial", "noncommercial"),
    ("whilst", "while"),
    ("https", "http"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINES = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9][0-9][0-9][0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies"""
_ISC_WARRANTY = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known texts: whole licences and the notices by which texts name one.
KNOWN = {
    "MIT": _MIT,
    "MIT-titled": "MIT License\n\n" + _MIT,
    "ISC": _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY,
    "0BSD": _ISC_GRANT + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_NAMES + _BSD_END,
    "Zlib": _ZLIB,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


#: Lines that a licence may begin with (at most 200): titles of licences whose text does not hold its name, and copyright statements of any form.
HEAD = (
    r"\A(?:[ \t*#/;-]*+(?:(?:the )?(?:mit|expat|isc|zlib|0bsd|bsd zero clause|bsd [23][- ]clause) licen[cs]e(?: \([^)\n]*\))?"
    r"|copyright[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\n]*)?[ \t\r.:]*\n){1,200}"
)


def shipped() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in licences."""
    out = list(KNOWN.items())
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        whole = path.read_text(encoding="utf-8")
        end = whole.find(mark := "END OF TERMS AND CONDITIONS")
        out += [(path.stem, whole), *([(path.stem, whole[:end]), (path.stem, whole[: end + len(mark)])] if end > 0 else [])]
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINES, "")
    out = F.trim(F.regexp_replace(out, SEPARATORS, " "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def bare(text: Column) -> Column:
    """A text without the titles and copyright statements it begins with; null if it begins with none."""
    lower = F.translate(text, UPPER, LOWER)
    return F.when(lower.rlike(HEAD), F.regexp_replace(lower, HEAD, ""))


def known_digests(spark: SparkSession, known: DataFrame | None = None, headless: bool = False) -> DataFrame:
    """digest (of texts without what they begin with, if ``headless``) and license_id of known licences: of ``known`` (license_id, text), or of the built-in ones."""
    if known is None:
        known = spark.createDataFrame(shipped(), "license_id string, text string")
    digests = known.where("text is not null").select("license_id", canonical(F.coalesce(bare(F.col("text")), "text") if headless else F.col("text")).alias("form")).where("form <> ''")
    return digests.groupBy(F.sha2("form", 256).alias("cw_digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the whole canonical text, and license_id (null if none is known) of every row."""
    digests, headless = (known_digests(docs.sparkSession, known, h) for h in (False, True))
    headless = headless.select(F.col("cw_digest").alias("cw_other"), F.col("license_id").alias("cw_license"))
    if known is None or known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests, headless = F.broadcast(digests), F.broadcast(headless)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"), bare(F.col("text")).alias("cw_bare"))
    rows = rows.withColumn("cw_bare", F.coalesce(F.sha2(canonical(F.col("cw_bare")), 256), "digest"))
    rows = rows.join(digests, F.col("digest") == F.col("cw_digest"), "left").join(headless, F.col("cw_bare") == F.col("cw_other"), "left")
    return rows.select("doc_id", "digest", F.coalesce("license_id", "cw_license").alias("license_id"))


def duckdb_sql() -> str:
    """The same scan of table ``documents`` with the built-in licences as DuckDB SQL."""

    def form(column: str) -> str:
        out = f"regexp_replace(translate({column}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINES}', '', 'g')"
        out = f"trim(regexp_replace({out}, '{SEPARATORS}', ' ', 'g'), ' ')"
        for one, other in SPELLINGS:
            out = f"replace({out}, '{one}', '{other}')"
        return out

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    return f"""
        WITH known AS (
            SELECT sha256({form("text")}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS k(license_id, text) GROUP BY 1
        )
        SELECT d.doc_id, d.digest, known.license_id FROM (SELECT doc_id, sha256({form("text")}) AS digest FROM documents) d LEFT JOIN known USING (digest)
    """
