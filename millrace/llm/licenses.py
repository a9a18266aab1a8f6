"""License scans by canonical digest lookup, with DataFrame functions only.

A text is canonical after: lower case; copyright lines dropped; equivalent spellings made one;
every run of other characters than letters and digits made one blank; outer blanks cut. Its
SHA-256 is hash-joined to the digests of known licence texts, canonical by the same rule.

There are two forms. The first, whose digest is returned and which the SQL has, blanks ASCII
alone and keeps all other characters. In the second, dashes of any kind are hyphens and all that
is no Unicode letter or digit is blanked: typographic quotes, dashes, bullets, no-break spaces.
A text, or line, that is not known in the first form is looked up in the second.

The known texts are ``KNOWN`` (all that the SQL has), ``variants`` of title lines and item marks,
and the digests in license_digests.tsv beside this file, of texts too long to be repeated here.
What is in none of them (AGPL, EPL and many more) is not found; ``known`` takes a longer list.

``scan`` compares entire texts. Its further columns count the lines of each text that are, on
their own, a known licence notice, as prose often carries one.

Defined cases: null and empty texts (and those of copyright lines alone) match nothing; a
licence known by several ids, or the same text listed twice, gives the smallest id; documents
that repeat are each reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Equivalent spellings, as (pattern, replacement), applied in order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("authorisation", "authorization"), ("organisation", "organization"), ("recognise", "recognize"), ("utilise", "utilize"), ("favour", "favor"), ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("modelled", "modeled"), ("programme", "program"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("wilful", "willful"), ("https://", "http://"), ("&", " and "),
)

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_TERMS = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

# Known licence texts and notices, as (SPDX id, text).
KNOWN = (
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n{_MIT_TERMS}\n{_MIT_WARRANTY}"),
    ("MIT", f"MIT License\n{_MIT_GRANT}, subject to the following conditions:\n{_MIT_TERMS}\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT_GRANT}, subject to the following conditions:\n{_MIT_TERMS}\n{_MIT_WARRANTY}"),
    ("MIT-0", f"{_MIT_GRANT}.\n{_MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

#: Digests of long texts: SPDX id, digest, source.
LISTED = Path(__file__).with_name("license_digests.tsv")


def variants() -> list[tuple[str, str]]:
    """Texts of ``KNOWN`` under their usual title lines, those of BSD also with bullets for numbers."""
    bsd = (_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY)
    titles = {
        "MIT": ("The MIT License", "MIT License (MIT)", "Expat License", "License: MIT", "The MIT License (MIT) (http://opensource.org/licenses/MIT)"),
        "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0"),
        "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"),
        "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"),
        "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
        "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    }
    texts = {"MIT": [KNOWN[0][1]], **{k: [t] for k, t in KNOWN if k in titles and k != "MIT" and len(t) > 500}}
    texts["ISC"].append(texts["ISC"][0].replace("and/or distribute", "and distribute"))
    for k, lines in (("BSD-2-Clause", bsd[:3] + bsd[4:]), ("BSD-3-Clause", bsd)):
        texts[k].append("\n".join(x[3:] if x[0].isdigit() else x for x in lines))
    return [(k, f"{title}\n{t}") for k, ts in texts.items() for title, t in product(("", *titles[k]), ts)]


#: A copyright line starts so, behind at most 40 other characters of the line; (c) alone counts only before a year.
COPYRIGHT = r"^[^a-z0-9\n]{0,40}((portions )?copyright|\(c\) *(copyright|[0-9])|©|all rights reserved)"
#: A line break before such words only wraps a sentence of the licence.
WRAPPED = r"\n[^a-z0-9\n]{0,40}copyright (holder|owner|notice|licen[sc]e|law|statement)"


#: What the second form treats otherwise than the first; dashes, and what is not seen at all.
MARKS = r"[^\x00-\x7f\p{L}\p{N}]"
DASHES, UNSEEN = r"[\p{Pd}\x{2212}]", r"[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]"


def canonical(line: Column, marks: bool = False) -> Column:
    """One line, or a text without line breaks, in canonical form but for outer blanks."""
    c = F.lower(line)
    if marks:
        c = F.regexp_replace(F.regexp_replace(c, UNSEEN, ""), DASHES, "-")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+" if marks else r"[^a-z0-9\x{80}-\x{10ffff}]+", " ")


def canonical_text(text: Column, marks: bool = False) -> Column:
    """Copyright lines are dropped before the lines are joined."""
    dropped = F.regexp_replace(F.regexp_replace(F.lower(text), WRAPPED, " copyright $1"), r"(?m)" + COPYRIGHT + r"[^\n]*$", " ")
    return F.trim(canonical(dropped, marks))


def _digest(x: Column, form, marks: bool = False) -> Column:
    """SHA-256 of a canonical form; the second is that of the first where there is nothing to blank."""
    first = F.sha2(F.trim(form(x)), 256)
    return F.when(x.rlike(MARKS), F.sha2(F.trim(form(x, True)), 256)).otherwise(first) if marks else first


def digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): a row for each distinct canonical text, of either form."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    both = F.array_distinct(F.array(*(_digest(F.col("text"), canonical_text, m) for m in (False, True))))
    return rows.select(F.explode(both).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def all_digests(spark: SparkSession) -> DataFrame:
    """``digests`` of every text that comes with this module."""
    listed = [tuple(x.split("\t")[1::-1]) for x in LISTED.read_text().splitlines() if x[0] != "#"]
    both = digests(spark, [*KNOWN, *variants()]).unionByName(spark.createDataFrame(listed, "digest string, license string"))
    return both.groupBy("digest").agg(F.min("license").alias("license"))


def scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license (of the entire text), n_notices, notices (ids, sorted, distinct).

    known: (digest, license). The join to it is by hash; it is broadcast if the optimizer finds
    it small. Notice lines are looked up in the built-in list, a literal map.
    """
    known = all_digests(spark) if known is None else known
    notices = {r["digest"]: r["license"] for r in digests(spark, [k for k in KNOWN if "\n" not in k[1] and len(k[1]) < 120]).collect()}  # a dozen rows
    lookup = F.create_map(*(F.lit(x) for kv in sorted(notices.items()) for x in kv))
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)licen[sc]e"))
    found = F.filter(F.transform(line, lambda x: F.coalesce(*(F.try_element_at(lookup, _digest(x, canonical, m)) for m in (False, True)))), lambda x: x.isNotNull())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text, canonical_text).alias("digest"), F.when(text.rlike(MARKS), F.sha2(canonical_text(text, True), 256)).alias("second"), F.when(text.rlike("(?i)licen[sc]e"), found).alias("found"))
    of = known.select(F.col("digest").alias("__digest"), F.col("license"))
    also = known.select(F.col("digest").alias("__second"), F.col("license").alias("__license"))
    rows = rows.join(of, F.col("digest") == F.col("__digest"), "left").join(also, F.coalesce("second", "digest") == F.col("__second"), "left")
    return rows.select("doc_id", "digest", F.coalesce("license", "__license").alias("license"), F.coalesce(F.size("found"), F.lit(0)).alias("n_notices"), F.coalesce(F.array_join(F.array_sort(F.array_distinct("found")), ","), F.lit("")).alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    for old, new in SPELLINGS:
        x = f"replace({x}, '{old}', '{new}')"
    return rf"trim(regexp_replace({x}, '[^a-z0-9\x{{80}}-\x{{10ffff}}]+', ' ', 'g'))"


def _sql_known(known) -> str:
    quoted = ", ".join("('{}', '{}')".format(k.replace("'", "''"), t.replace("'", "''")) for k, t in known)
    return f"SELECT digest, min(license) AS license FROM (SELECT license, sha256({_sql_text('lower(t)')}) AS digest FROM (VALUES {quoted}) v(license, t)) GROUP BY digest"


def _sql_text(low: str) -> str:
    return _sql_canonical(f"regexp_replace(regexp_replace({low}, '{WRAPPED}', ' copyright \\1', 'g'), '(?m){COPYRIGHT}[^\\n]*$', ' ', 'g')")


SQL = f"""
WITH known AS ({_sql_known(KNOWN)}),
notice AS ({_sql_known([k for k in KNOWN if chr(10) not in k[1] and len(k[1]) < 120])}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, sha256({_sql_canonical('lower(l)')}) AS digest FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '(?i)licen[sc]e')),
found AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids FROM lines JOIN notice USING (digest) GROUP BY r),
whole AS (SELECT r, doc_id, sha256({_sql_text('lower(t)')}) AS digest FROM d)
SELECT doc_id, digest, license, coalesce(n, 0)::INT AS n_notices, coalesce(ids, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (r)
"""
