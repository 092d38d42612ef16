"""Licence scan by canonical digests, in DataFrame functions only.

A text becomes canonical: lower case, copyright lines dropped, marks and blanks to one space,
equivalent spellings to one. The SHA-256 of the canonical whole document, of each paragraph and of
each line is joined to the digests of known licence texts and notices. Only hashes are compared.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm.common import row_key, text_of

# Lines that name the holder, and spellings that mean the same.
COPYRIGHT_LINE = (r"(?m)^[ \t#/*;%>-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{]|:)|\(c\)[ \t]*[0-9]|©"
                  r"|all rights reserved)[^\n]*$")
SPELLINGS = {"licence": "license", "sub license": "sublicense", "non commercial": "noncommercial",
             "copyright owner": "copyright holder", "per cent": "percent", "web site": "website",
             "judgement": "judgment", "organisation": "organization", "favour": "favor"}

# Short notices, as projects write them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

# Whole licence texts, with the titles they go by.
TEXTS = {
    "MIT": ("MIT License", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.

""" + _WARRANTY),
    "ISC": ("ISC License", """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies.

""" + _ISC_WARRANTY),
    "0BSD": ("BSD Zero Clause License", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

""" + _ISC_WARRANTY),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD_START + _BSD_END),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD_START + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
""" + _BSD_END),
}


def known_licences(spark: SparkSession) -> DataFrame:
    """license, text: whole texts with and without their title, and notices. Spark can tell that
    it is small."""
    rows = [(name, t) for name, (title, body) in TEXTS.items() for t in (body, f"{title}\n\n{body}")]
    rows += [(name, t) for name, notices in NOTICES.items() for t in notices]
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in rows])
    return spark.range(1).select(F.inline(listed))


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, `text_digest` (of the canonical whole text), `license`
    (the whole text's, NULL if unknown), `n_matches` (lines and paragraphs that are known) and
    `licenses` (all distinct names found, sorted and comma-joined; empty if none).

    Null text counts as empty; a text or line with nothing canonical left matches nothing.
    Several names for one digest are all reported. Rows equal in id and text have the same
    result; extra columns are ignored; an empty table gives no rows. `known` needs license, text.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    known = (known.select("license", canonical(text_of()).alias("c")).filter("c != ''")
             .groupBy(F.sha2("c", 256).alias("digest")).agg(F.collect_set("license").alias("names")))
    digest = lambda x: F.sha2(canonical(x), 256)
    rows = docs.select("doc_id", row_key().alias("key"), text_of().alias("text")).select(
        "doc_id", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "text")
    whole = rows.select("doc_id", "a", "b", digest(F.col("text")).alias("text_digest")).join(
        known.withColumnsRenamed({"digest": "text_digest", "names": "whole"}), "text_digest", "left")
    # a paragraph of one line is a line already, and a text without blank lines is no paragraph
    paragraphs = F.split("text", r"\n[ \t\r]*\n")
    units = F.concat(F.transform(F.split("text", "\n"), digest), F.when(
        F.size(paragraphs) > 1, F.transform(F.filter(paragraphs, lambda x: F.contains(x, F.lit("\n"))), digest),
    ).otherwise(F.array().cast("array<string>")))
    hits = (rows.select("a", "b", F.posexplode(units).alias("pos", "digest")).join(known, "digest")
            .groupBy("a", "b").agg(F.count_distinct("pos").alias("n_matches"),
                                   F.array_distinct(F.flatten(F.collect_set("names"))).alias("names")))
    none = F.array().cast("array<string>")
    return whole.join(hits, ["a", "b"], "left").select(
        "doc_id", "text_digest", F.array_min("whole").alias("license"),
        F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("names", none), F.coalesce("whole", none))), ",").alias("licenses"))
