"""Searches sum a chunk's scores where its range lies, and terms are counted within rows."""

import collections
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tablesense.functions.text import index_tokens
from tablesense.operators import retrieval as R
from tablesense.operators import term_index as T


def test_scores_are_not_shuffled(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} other") for i in range(50)], "id long, text string")
    index = T.write_index(chunks, "id", "text", f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(1, "word1 other"), (2, "word3 word3")], "qid int, question string")
    searches = [f(index, queries, "qid", "question") for f in (T.bm25_scores, T.tfidf_scores)]
    for df in (*searches, R.bm25(chunks, queries, "id", "text", "qid", "question")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        partial = re.search(r"HashAggregate.*?partial_sum", plan, re.S).group()
        assert "Exchange" not in partial, plan  # sums are whole in the task that they were begun in


def test_counts_are_of_index_tokens(spark):
    texts = ["The cat, the CAT and x_1 a1 b", "", None, "漢字 漢 Kelvin İx Été naïve", "of the a", "9 99\n99\t_ __"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {r["i"]: collections.Counter(r["w"]) for r in df.select("i", index_tokens(F.col("t")).alias("w")).collect()}
    for r in R.counted(df, "i", "t").collect():
        assert {x["term"]: x["tf"] for x in r["terms"]} == want[r["i"]]
        assert (r["len"], r["top"]) == (want[r["i"]].total(), max(want[r["i"]].values(), default=None))


def test_ranges_end_where_places_do():
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    chunk = lambda *places: pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([2] * len(places), pa.int32()), pa.array([0.5] * len(places), pa.float64()), pa.array([[{"term": "b", "tf": p + 1}, {"term": "a", "tf": 1}] for p in places], kind)], names=["place", "len", "scale", "terms"])
    blocks = [r for b in T._blocks(3)(iter([chunk(0, 1), chunk(), chunk(2, 3, 4, 9), chunk(10)])) for r in b.to_pylist()]
    assert [(b["range_no"], b["term"], b["n"]) for b in blocks] == [(0, "b", 3), (0, "a", 3), (3, "b", 2), (3, "a", 2), (9, "b", 2), (9, "a", 2)]
    assert blocks[0]["most_tf"] == 3 and blocks[0]["postings"][2] == {"place": 2, "tf": 3, "len": 2, "weight": 1.5}
