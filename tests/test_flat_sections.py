"""Flat sections and those that a question asks about."""

from pyspark.sql import functions as F

from tablesense.operators import documents as D

TEXT = "before\n# One ship\nharbour tax\n\n##### deep\nmore\n#nothing\n## Two\n#### Three \t\nthe harbour, the tax, the ship\n"


def test_flat_sections(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no heading\n"), (3, None), (4, "")], "id int, text string")
    got = sorted((r["id"], r["section_no"], r["heading"], r["body"]) for r in D.flat_sections(docs, "id", "text").collect())
    assert got == [(1, 1, "One ship", "harbour tax\n\n##### deep\nmore\n#nothing"), (1, 2, "Two", ""), (1, 3, "Three", "the harbour, the tax, the ship"), (2, 1, "(top)", "no heading\n"), (4, 1, "(top)", "")]


def test_focus(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "# A\nx\n# B\ny")], "id int, text string")
    sections = D.flat_sections(docs, "id", "text")
    pick = lambda q, n: sorted((r["id"], r["section_no"], r["score"]) for r in D.focused_sections(sections, "id", F.lit(q), n).collect())
    assert pick("Which ship is in the harbour of Two?", 9) == [(1, 1, 2), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 0)]
    assert pick("harbour?", 1) == [(1, 1, 1), (2, 1, 0)]
