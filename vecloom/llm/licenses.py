"""License scans by canonical digest; DataFrame functions only.

A text is brought into a canonical form (lower case; copyright lines dropped, up
to the grant if one goes on in the same line; equivalent spellings made one; punctuation and white space folded), hashed, and
the digest is joined with those of known licence texts.  Two texts meet only if
they are wholly the same in canonical form.  Notices of one line ("Licensed
under the ...") are found the same way, line by line: only lines that hold
"licen" or "releas" or "copyright" after lower-casing are looked up, which the
known notices all do.

The known texts and notices are tables (license, digest; see ``known``) of one row
a digest that the caller may replace by tables of any size; the built-in one has the common licences, in the layouts they come in (see
``layouts``), and common notices.  Its digests are
made by the same expression, so both sides always agree.  They are counted and
broadcast up to a bound, and joined salted beyond it.

Defined cases: null text gives a null digest and no licence; a text without
letters or digits has the digest of '' and matches nothing; ties (one digest
under several names) give the first name; repeated rows are returned as often
as they occur; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_ids, join_small, staged

#: Equivalent spellings, applied in order to lower-cased text whose words single spaces part.
SPELLINGS = (
    ("(^| )licence", "$1license"), ("(^| )sublicence", "$1sublicense"), ("(^| )sub license", "$1sublicense"), ("(^| )merchantibility", "$1merchantability"), ("(^| )non commercial", "$1noncommercial"),
    ("(^| )noninfringement", "$1non infringement"), ("(^| )authorisation", "$1authorization"), ("(^| )https ", "$1http "), ("(^| )copyright holder", "$1copyright owner"),
    ("(^| )per cent ", "$1percent "), ("(^| )version ([0-9])", "$1v$2"), ("(^| )(v[0-9]+) 0( |$)", "$1$2$3"),
)
#: A line that says who holds the copyright, or that all rights are reserved; if a sentence after it starts a grant, the line stays from there on (group 1).
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n][^\n]*?(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*?(?:[.;][ \t]+((?:permission|licen[cs]ed|released|distributed|redistribution|this (?:work|software|program|file|text|document)) [^\n]*))?$"
MARKS = r"[^\p{L}\p{N}]+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License")}


def layouts(name: str) -> list[tuple[str, str]]:
    """A licence of the folder license_texts as it is found: with and without a title, the numbers of its
    clauses and what follows its terms, that with a year filled in or not; in lines, and a paragraph a line
    (which differs where a line starts like a copyright line)."""
    text = files(__package__).joinpath("license_texts", f"{name}.txt").read_text("utf-8")
    found = [text]
    if name in TITLES:
        found += [re.sub(r"(?m)^[0-9]\. ", "* ", text), text.replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS")]
        found += [f"{title}\n\n{t}" for t in found for title in TITLES[name]]
    terms = text.partition("END OF TERMS AND CONDITIONS")
    if terms[1]:
        found += [terms[0], terms[0] + terms[1], text.replace("Copyright [yyyy]", "Copyright 2000")]
    found += [re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t) for t in found if re.search(r"(?im)^\W*(copyright|\(c\)|©|all rights)", t)]
    return [(name, t) for t in dict.fromkeys(found)]


#: Known texts: whole licences, and notices of one line.
TEXTS = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License\n\n" + MIT),
    ("ISC", f"{ISC_GRANT}{ISC_KEEP}.\n\n{ISC_WARRANTY}"), ("ISC", f"ISC License\n\n{ISC_GRANT}{ISC_KEEP}.\n\n{ISC_WARRANTY}"), ("0BSD", f"{ISC_GRANT}.\n\n{ISC_WARRANTY}"),
    *(x for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0") for x in layouts(name)),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT_LINE), F.lit(" $1"))
    out = F.regexp_replace(out, F.lit(MARKS), F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, F.lit(spelling), F.lit(one))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """license and digest of known texts; of several names the first."""
    return spark.createDataFrame(list(texts), "license string, text string").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, texts: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """Every document: doc_id, its canonical digest, the licence that it wholly is, and the licences of its notice lines (sorted, comma-joined)."""
    spark = docs.sparkSession
    texts = known(spark) if texts is None else texts
    notices = known(spark, NOTICES) if notices is None else notices
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike("licen|releas|copyright"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.when(F.size(lines) > 0, F.array_distinct(F.transform(lines, digest))).alias("_lines"))
    # The texts are read once; what follows joins digests, and gathers notices by the row's number.
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    looked_up = staged(rows.where("_lines IS NOT NULL").select("_row", F.explode("_lines").alias("digest")), "lines")
    found = join_small(looked_up, notices, ["digest"]).where("license IS NOT NULL").groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = join_ids(join_small(rows.drop("_lines"), texts, ["digest"]), staged(found, "notices"), "left", key="_row")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
