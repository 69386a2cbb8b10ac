"""License scan by canonical digest lookup, in DataFrame functions only.

A text is normalised so that copies of a licence which differ in case, punctuation, layout, copyright lines or spelling are
one string, whose SHA-256 is looked up among those of known licences by a hash join. Whole texts are compared: a text
that quotes a licence among other words isn't one. A licence's usual title at the very beginning is left out of the digest, so
that a licence is known under any of its titles and without one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm.license_digests import DIGESTS

#: Spellings that licence matching guidelines hold to be equivalent, each to be read as the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Texts and one-line notices of public licences, by identifier. More of them are in DIGESTS.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT notice", "Released under the MIT License."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
)

#: Titles that licences stand under. A licence's own title is no part of what it says.
TITLES = (
    "MIT License",
    "The MIT License",
    "MIT License (MIT)",
    "The MIT License (MIT)",
    "Expat License",
    "ISC License",
    "The ISC License",
    "ISC License (ISC)",
    "The ISC License (ISC)",
    "BSD Zero Clause License",
    "Zero-Clause BSD",
    "Zero-Clause BSD License",
    "BSD License",
    "The BSD License",
    "BSD 2-Clause License",
    "The BSD 2-Clause License",
    "The 2-Clause BSD License",
    'BSD 2-Clause "Simplified" License',
    "Simplified BSD License",
    "BSD 3-Clause License",
    "The BSD 3-Clause License",
    "The 3-Clause BSD License",
    'BSD 3-Clause "New" or "Revised" License',
    "New BSD License",
    "Modified BSD License",
    "Apache License",
    "Apache License Version 2.0, January 2004",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "The Artistic License",
    "CC0 1.0 Universal",
    "Creative Commons Legal Code CC0 1.0 Universal",
    "GNU Free Documentation License Version 1.2, November 2002",
    "GNU Free Documentation License Version 1.3, 3 November 2008",
    "GNU General Public License Version 1, February 1989",
    "GNU General Public License Version 2, June 1991",
    "GNU General Public License Version 3, 29 June 2007",
    "GNU Library General Public License Version 2, June 1991",
    "GNU Lesser General Public License Version 2.1, February 1999",
    "GNU Lesser General Public License Version 3, 29 June 2007",
    "Mozilla Public License Version 1.1",
    "Mozilla Public License Version 2.0",
)

#: The BSD licences, with places for the conditions' numbers and for those whom they speak of.
BSD_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_NAMES = "{0} Neither the name of {1} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {0} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {1} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_NUMBERS = (("", "", ""), ("1.", "2.", "3."), ("a.", "b.", "c."))
BSD_NAMED = ("the copyright holder", "the copyright holders", "the University", "the author", "the organization", "its copyright holder")
BSD_PARTIES = (
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
    ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"),
    ("THE AUTHORS AND CONTRIBUTORS", "THE AUTHORS OR CONTRIBUTORS"),
    ("THE AUTHOR", "THE AUTHOR"),
)


def bsd_texts() -> list[tuple[str, str]]:
    """The BSD licences in all their wordings."""
    made = []
    for numbers, (provider, liable) in itertools.product(BSD_NUMBERS, BSD_PARTIES):
        begun, ended = BSD_SOURCE.format(*numbers), BSD_DISCLAIMER.format(provider, liable)
        made.append(("BSD-2-Clause", begun + ended))
        made += [("BSD-3-Clause", begun + BSD_NAMES.format(numbers[2], named) + ended) for named in BSD_NAMED]
    return made


#: A line that begins with a copyright sign or word, after comment signs, is a copyright line; all of it goes.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
SIGNS = r"[^\p{L}\p{N}\p{M}]+"


def spellings() -> list[tuple[str, str]]:
    """SPELLINGS as they stand between words: a blank at either end, two between words."""
    return [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in SPELLINGS]


def normalised(text: Column) -> Column:
    """Words of a text in their canonical form, with single spaces; null: ''."""
    text = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    # two blanks between words: neighbours that are spelt anew share none
    plain = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), SIGNS, "  ")
    spelt = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), spellings(), F.concat(F.lit(" "), plain, F.lit(" ")))
    return F.trim(F.regexp_replace(spelt, " +", " "))


def title_pattern() -> str:
    """A regular expression of TITLES as they begin a normalised text; the longest that fits is taken."""
    plain = sorted({re.sub(r"\W+", " ", t.lower()).strip() for t in TITLES}, key=lambda t: (-len(t), t))
    return f"^(?:{'|'.join(plain)})(?: |$)"


def untitled(normal: Column) -> Column:
    """A normalised text without a licence's title at its beginning."""
    return F.regexp_replace(normal, title_pattern(), "")


def canonical_digest(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the normalised text without a title."""
    return F.sha2(untitled(normalised(text)).cast("binary"), 256)


def known_licenses(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest of KNOWN and the BSD licences, or of other texts. Of licences that are one after normalisation the first is named."""
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate([*KNOWN, *bsd_texts()] if known is None else known)], "k int, license_id string, text string")
    return rows.select("k", "license_id", canonical_digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min_by("license_id", "k").alias("license_id"))


def shipped_licenses(spark: SparkSession) -> DataFrame:
    """license_id, digest: those of the texts here and of ``DIGESTS``, which has none of them."""
    more = spark.createDataFrame([(d, name) for name, digests in DIGESTS.items() for d in digests], "digest string, license_id string")
    return known_licenses(spark).select("digest", "license_id").unionByName(more)


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_normal (characters of the normalised text), digest (of what follows a title), license_id
    (null: not known).

    Null, empty and blank texts, and texts of signs, copyright lines or a title only, all have the digest of ''. Only digests are
    joined; which side is broadcast, if one is, Spark decides by its size. Repeated rows and null ids are looked up like all others.
    An empty table gives no rows. Texts may be of any length; no other column of ``docs``, whatever its name, is read.
    """
    known = shipped_licenses(docs.sparkSession) if known is None else known
    rows = docs.select(F.col(id_col), normalised(F.col(text_col)).alias("normal")).select(id_col, F.char_length("normal").cast("long").alias("n_normal"), F.sha2(untitled(F.col("normal")).cast("binary"), 256).alias("digest"))
    return rows.join(known.select("digest", "license_id"), "digest", "left").select(id_col, "n_normal", "digest", "license_id")
