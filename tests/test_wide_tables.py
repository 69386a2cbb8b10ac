"""Steps over every cell of large tables: dates without parsers' errors, JSON fields in one pass, cells counted before they become tokens."""

import json

from pyspark.sql import functions as F

from tablesense.functions import cells as C
from tablesense.functions.cells import date_value
from tablesense.operators import answers as A
from tablesense.operators import json_profile as J


def test_wrong_dates_raise_nothing_inside(spark):
    texts = {"February 30, 2020": None, "Feb. 29th of 2020": "2020-02-29", "29 Feb 1900": None, "2/29/00": "2000-02-29", "2020-13-01": None, "2020-12-31T10:00": "2020-12-31", "31 sept 2020": None, "3 Xyz 2020": None, "": None, "1/31/2020th": "2020-01-31"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", date_value(F.col("t")).cast("string").alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == texts
    assert "timestamp" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_scalars_are_written_once_at_any_depth(spark, monkeypatch):
    deep = lambda n, v: v if n == 0 else ([deep(n - 1, v), {}, []] if n % 2 else {"k": deep(n - 1, v)})
    docs = [json.dumps(deep(n, x)) for n in range(12) for x in (1, "1", None, True)] + ["nonsense", None]
    df = spark.createDataFrame(list(enumerate(docs)), "n long, j string").repartition(3)
    written = []
    keep = J.store.written
    monkeypatch.setattr(J.store, "written", lambda d, name: written.append(name) or keep(d, name))
    got = {(r["path"], r["rank"], r["value"], r["cnt"]) for r in J.json_field_profile(df, "n", "j").collect()}
    path = lambda n: "$" + "".join("[]" if i % 2 else ".k" for i in range(n, 0, -1))
    assert got == {(path(n), rank, v, c) for n in range(12) for rank, v, c in ((1, "1", 2), (2, "1", 1), (3, "null", 1))}
    assert len(written) == 3  # five levels a pass
    scalars = J.json_scalars(df, "n", "j")
    assert "SortAggregate" not in scalars.groupBy("path", "class", "shown", "at").agg(F.count("*"), F.min("pos"))._jdf.queryExecution().executedPlan().toString()


def test_numbers_become_tokens_as_their_text_does(spark):
    odd = [None, 0.0, -0.0, 0.005, 0.015, -2.675, 1e-300, 1e15, 123456.785, float("nan"), float("inf"), float("-inf"), 3.0]
    df = spark.createDataFrame([(x, None if x is None else i * 10**15 - 7) for i, x in enumerate(odd)], "d double, n long")
    rows = df.select(*[f(F.col(c)).alias(f"{c}{i}") for c in ("d", "n") for i, f in enumerate((C.match_token, C.number_token))]).collect()
    assert all(r["d0"] == r["d1"] and r["n0"] == r["n1"] for r in rows)


def test_values_are_counted_before_they_become_tokens(spark, monkeypatch):
    """Regular expressions see each different value once, not each cell."""
    df = spark.range(4000, numPartitions=2).select((F.col("id") % 5).alias("n"), F.concat((F.col("id") % 5).cast("string"), F.lit(".0 ")).alias("s"), (F.col("id") % 5 / 1.0).alias("x"))
    plans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or collect(d))
    assert [tuple(r) for r in sorted(A.column_classes([df, df.select("x", "n")]).collect())] == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 0, 0), (1, 1, 0)]
    confirmed = next(p for p in plans if "FullOuter" in p)
    for line in confirmed.split("\n"):
        assert "explode" not in line or "rlike" not in line.lower()
    below = confirmed[confirmed.index("FullOuter"):].split("Generate")[1]
    assert "bround" not in below.lower() and "rlike" not in below.lower()
