"""Whole files of common licences are known, with their titles or without."""

import os

import pytest

from tablesense.llm import licenses
from tablesense.llm.license_digests import DIGESTS

COMMON = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
BSD_2 = """BSD 2-Clause License

Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def ids(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).collect()}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts here")
def test_common_licenses(spark):
    texts = {f: open(f"{COMMON}/{f}", encoding="utf-8").read() for f in FILES}
    assert ids(spark, texts) == FILES
    apache = texts["Apache-2.0"]
    untitled = apache[apache.index("TERMS AND CONDITIONS FOR USE") :]
    assert ids(spark, {"terms": untitled[: untitled.index("APPENDIX")], "changed": apache.replace("perpetual", "brief"), "part": apache[:5000]}) == {"terms": "Apache-2.0", "changed": None, "part": None}


def test_titled_licenses(spark):
    known = dict(licenses.KNOWN)
    texts = {
        "mit": "The MIT License (MIT)\n\nCopyright (c) 2014 Someone\n\n" + known["MIT"],
        "isc": "ISC License\n\nCopyright (c) 2014 Someone\n\n" + known["ISC"],
        "0bsd": "BSD Zero Clause License\n\n" + known["0BSD"],
        "bsd2": BSD_2.format("1. ", "2. "),
        "bsd2-bullets": BSD_2.format("* ", "* "),
    }
    assert ids(spark, texts) == {"mit": "MIT", "isc": "ISC", "0bsd": "0BSD", "bsd2": "BSD-2-Clause", "bsd2-bullets": "BSD-2-Clause"}


def test_a_licence_is_known_under_each_of_its_titles(spark):
    """The commonest file: a title, a copyright line, the text."""
    mit = dict(licenses.KNOWN)["MIT"]
    titles = ["MIT License", "The MIT License", "MIT LICENCE", "The MIT License (MIT)", "# MIT License\n====", "  mit license:", ""]
    texts = {str(i): f"{t}\n\nCopyright (c) 2020 Someone\n\n{mit}\n" for i, t in enumerate(titles)}
    assert set(ids(spark, texts).values()) == {"MIT"}
    odd = {"title": "MIT License", "twice": f"MIT License MIT License\n{mit}", "inside": f"It has the MIT License\n{mit}", "after": f"{mit}\nMIT License"}
    assert set(ids(spark, odd).values()) == {None}


def test_a_query_with_positive_rows(spark, tmp_path):
    """The registered query and its SQL over documents of which some are licences."""
    import duckdb

    from tablesense.llm import queries

    mit = dict(licenses.KNOWN)["MIT"]
    rows = [(i, f"The {name} story" if i % 3 else f"MIT License\nCopyright 2020 N.\n{text.lower()}") for i, (name, text) in enumerate([*licenses.KNOWN, *licenses.bsd_texts()])]
    rows += [(1000, mit), (1001, None), (1002, ""), (1003, mit[:-9])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_licenses"])
    columns = [c[0] for c in want.description]
    got = sorted(tuple(map(str, r)) for r in queries.op8_licenses(spark, str(tmp_path)).select(*columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall()) and sum(r[3] != "None" for r in got) > 40


def test_digests_are_of_one_license_each(spark):
    every = [d for digests in DIGESTS.values() for d in digests] + [r["digest"] for r in licenses.known_licenses(spark).collect()]
    assert len(every) == len(set(every))
