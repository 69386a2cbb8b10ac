"""Dates in words, keyword terms, previews of findings."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablesense.functions.cells import date_value
from tablesense.functions.text import keyword_terms
from tablesense.sources.sinks import finding_preview

DAY = datetime.date(2020, 1, 31)
DATES = {"2020-01-31": DAY, "2020-01-31 10:20": DAY, "2020-01-31T10": DAY, "1/31/2020": DAY, "01/31/20": DAY, "January 31st, 2020": DAY, "jan 31 2020": DAY, " 31 JAN. 2020 ": DAY, "31st of January 2020": DAY, "September 3, 1999": datetime.date(1999, 9, 3), "Sept 3 1999": datetime.date(1999, 9, 3), "May 1st 2001": datetime.date(2001, 5, 1)}
OTHERS = ["February 30, 2020", "2020-13-01", "2020-01-311", "31/31/2020", "Foo 3, 2020", "January 2020", "", "today", None]


@pytest.mark.parametrize("said", [*DATES, *OTHERS])
def test_dates(spark, said):
    got = spark.createDataFrame([(said,)], "t string").select(date_value(F.col("t")).alias("d")).first()["d"]
    assert got == DATES.get(said)


def test_keyword_terms(spark):
    rows = [("Ships and SHIPS of x1 a-b_c ab, the ab3 ünder",), (None,), (" ".join(f"word{i:03d}" for i in range(99)),)]
    got = [r["k"] for r in spark.createDataFrame(rows, "t string").select(keyword_terms(F.col("t")).alias("k")).collect()]
    assert got[0] == ["ships", "and", "a-b_c", "the", "ab3", "nder"] and got[1] == [] and len(got[2]) == 80


def test_finding_preview(spark):
    some, more = finding_preview(spark.range(25), 20)
    assert some.count() == 20 and more and not finding_preview(spark.range(20), 20)[1]
