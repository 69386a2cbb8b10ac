"""Columns of equal signatures are told apart by their cells, and signatures need no shuffle of cells."""

import collections

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesense.operators import answers as A


def forged(token):
    """Hashes that are alike for all tokens: every two columns of the same length collide."""
    return [F.lit(1).cast("long")]


def table(spark, columns):
    return spark.createDataFrame([tuple(r) for r in zip(*columns, strict=True)], ", ".join(f"c{i} string" for i in range(len(columns))))


def test_forged_collisions_are_told_apart(spark):
    one, two = table(spark, [["a", "b", "b"], ["1", "1.0", "2"], ["b", "a", "a"]]), table(spark, [["2", "1", "1"], ["B ", "b", "a"], ["", None, "x"]])
    assert {r["signature"] for t in (one, two) for r in A.signatures(t, hashes=forged).collect()}.__len__() == 1
    got = sorted(tuple(r) for r in A.column_classes([one, two], hashes=forged).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 1, 0), (1, 2, 5)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["1", "1.0", "a", "", "A", "nan"]), min_size=3, max_size=3), min_size=1, max_size=6), st.booleans())
def test_classes_are_those_of_equal_multisets(spark, columns, collide):
    norm = lambda c: tuple(sorted({"1.0": "1", "A": "a"}.get(v, v) for v in c))
    firsts = {}
    want = [firsts.setdefault(norm(c), i) for i, c in enumerate(columns)]
    got = A.column_classes([table(spark, columns)], hashes=forged if collide else A.cell_hashes).collect()
    assert [r["class_no"] for r in sorted(got, key=lambda r: r["col_idx"])] == want


def test_exact_matching_agrees_with_signatures(spark):
    gold, pred = table(spark, [["a", "b"], ["a", "b"], ["c", "d"]]), table(spark, [["b", "a"], ["d", "e"], ["B", "A"], ["a", "b"]])
    pairs = [sorted(tuple(r) for r in A.match_columns(gold, pred, exact=e).collect()) for e in (False, True)]
    assert pairs[0] == pairs[1] == [(0, 2), (1, 0)]


def test_tables_without_rows_or_columns(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert [r["class_no"] for r in A.column_classes([empty, empty]).collect()] == [0] * 4
    assert A.column_classes([spark.createDataFrame([(1,)], "a int").drop("a"), empty]).count() == 2
    assert A.score_table(empty, empty).first()["score"] == 1.0


def test_cells_and_tables_have_the_same_signatures(spark):
    df = table(spark, [["a", "b", None], ["", "2", "2.0"]])
    cells = spark.createDataFrame([(0, "a"), (0, "b"), (0, A.EMPTY), (1, A.EMPTY), (1, "#200"), (1, "#200"), (2, None)], "col_idx int, token string")
    long = {r["col_idx"]: r["signature"] for r in A.signed(cells, "col_idx").collect()}
    assert {r["col_idx"]: r["signature"] for r in A.signatures(df).collect()} == {k: long[k] for k in (0, 1)}
    assert long[2] == A.signatures(df.limit(0)).first()["signature"]


@pytest.mark.parametrize("make", [lambda g, p: A.signatures(g), lambda g, p: A.strict_match(g, p)])
def test_no_cell_is_shuffled(spark, make):
    df = spark.range(50_000).selectExpr("id", "cast(id as string) AS t", "id % 7 AS k").repartition(4)
    plan = make(df, df)
    plan.collect()
    metrics = collections.Counter()

    def walk(node):
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            walk(node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan())
            return
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and "RoundRobin" not in node.toString():
            metrics["shuffled"] += node.metrics().apply("shuffleRecordsWritten").value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan._jdf.queryExecution().executedPlan())
    assert metrics["shuffled"] < 100
