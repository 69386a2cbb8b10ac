"""Queries of answer tables: tokens, signatures, matching, scores, validation, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.functions.cells import EMPTY, is_emptyish, match_token, show_tokens
from tablesense.operators import answers as A
from tablesense.plans.q_core import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _gold(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _noisy(gold: DataFrame) -> DataFrame:
    """The same answer with other names, columns in another order, other case and blanks, numbers as text, and a column more."""
    return gold.select(F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("a"), F.col("o_totalprice").cast("string").alias("b"), F.format_string("%d.0", "o_orderkey").alias("c"), F.lower("o_orderstatus").alias("d"), F.lit("x").alias("a2")).orderBy(F.desc("b"))


@query(f"""
SELECT o_orderkey, '#' || CAST(CAST(round_even(o_totalprice / 0.01, 0) AS DECIMAL(38, 0)) AS VARCHAR) AS price, lower(o_orderpriority) AS priority,
 CASE WHEN o_orderkey % 2 = 0 THEN '{EMPTY}' ELSE 'nan' END AS gap FROM orders""")
def cell_normalize(spark, d):
    gap = F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(" NaN")
    return table(spark, d, "orders").select("o_orderkey", match_token(F.col("o_totalprice")).alias("price"), match_token(F.concat(F.lit("\t"), "o_orderpriority")).alias("priority"), match_token(gap).alias("gap"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS shown_key, lower(o_orderstatus) AS shown_status FROM orders""")
def cell_display(spark, d):
    show = show_tokens(1e-2)
    return table(spark, d, "orders").select("o_orderkey", show(F.format_string("%d.000", "o_orderkey")).alias("shown_key"), show(F.concat("o_orderstatus", F.lit(" "))).alias("shown_status"))


@query("""SELECT * FROM (VALUES (0, 2), (1, 3), (2, 1), (3, 0)) t(gold_idx, pred_idx)""")
def column_signature_equal(spark, d):
    g, p = A.signatures(_gold(spark, d)), A.signatures(_noisy(_gold(spark, d)))
    return g.alias("g").join(p.alias("p"), "signature").select(F.col("g.col_idx").alias("gold_idx"), F.col("p.col_idx").alias("pred_idx"))


@query("""
WITH cells AS (
  SELECT 0 AS t, unnest([{'c': 0, 'v': CAST(l_quantity AS DOUBLE)}, {'c': 1, 'v': l_discount}, {'c': 2, 'v': l_tax}, {'c': 3, 'v': CAST(l_linenumber AS DOUBLE)}]) AS x FROM lineitem
  UNION ALL SELECT 1, unnest([{'c': 0, 'v': l_tax}, {'c': 1, 'v': CAST(l_linenumber AS DOUBLE)}, {'c': 2, 'v': l_quantity + CASE WHEN l_linenumber = 1 AND l_quantity = 1 THEN 1 ELSE 0 END}, {'c': 3, 'v': l_discount}]) FROM lineitem
), counts AS (SELECT t, x.c AS c, round_even(x.v / 0.01, 0) AS v, count(*) AS n FROM cells GROUP BY 1, 2, 3),
 columns_ AS (SELECT t, c, string_agg(CAST(v AS VARCHAR) || ':' || n, ',' ORDER BY v) AS content, t * 4 + c AS k FROM counts GROUP BY 1, 2)
SELECT CAST(t AS INTEGER) AS table_no, CAST(c AS INTEGER) AS col_idx, CAST(min(k) OVER (PARTITION BY content) AS INTEGER) AS class_no FROM columns_""")
def confirmed_columns(spark, d):
    li = table(spark, d, "lineitem")
    changed = F.col("l_quantity") + F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") == 1), 1).otherwise(0)
    return A.column_classes([li.select("l_quantity", "l_discount", "l_tax", "l_linenumber"), li.select(F.col("l_tax").alias("a"), F.col("l_linenumber").cast("string").alias("a"), changed.alias("b"), F.col("l_discount").alias("c"))])


@query("""SELECT * FROM (VALUES (0, 1), (1, 0), (2, 3)) t(gold_idx, pred_idx)""")
def match_columns(spark, d):
    g = table(spark, d, "nation").select(F.col("n_name").alias("x"), F.col("n_name").alias("y"), "n_nationkey", "n_regionkey")
    p = table(spark, d, "nation").select(F.upper("n_name").alias("x"), F.col("n_name").alias("x"), F.lit(7).alias("z"), F.col("n_nationkey").cast("double").alias("k"))
    return A.match_columns(g, p)


@query("""SELECT CAST(4 AS BIGINT) AS matched, CAST(4 AS BIGINT) AS gold_columns, CAST(5 AS BIGINT) AS pred_columns, CAST(1.0 AS DOUBLE) AS recall, CAST(0.9 AS DOUBLE) AS score""")
def score_table(spark, d):
    return A.score_table(_gold(spark, d), _noisy(_gold(spark, d)))


@query("""SELECT true AS correct""")
def strict_grade(spark, d):
    return A.strict_match(_gold(spark, d), _noisy(_gold(spark, d)))


@query("""SELECT * FROM (VALUES ('empty_column', 'error', 1), ('empty_column', 'error', 2), ('mixed_types', 'warning', 3)) t(code, severity, col_idx)""")
def validate_issues(spark, d):
    o = table(spark, d, "orders")
    return A.validation_issues(o.select("o_orderkey", F.lit("").alias("gap"), F.lit(None).cast("string").alias("gap"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("1").alias("mixed")))


@query("""SELECT 'ragged_row' AS code, 'error' AS severity, o_orderkey AS pos, CAST(o_orderkey % 4 AS INTEGER) AS width FROM orders WHERE o_orderkey % 4 <> 2""")
def validate_ragged(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey"), F.slice(F.array(*[F.lit("v")] * 3), 1, (F.col("o_orderkey") % 4).cast("int")).alias("cells"))
    return A.ragged_rows(rows, "cells", 2, "o_orderkey")


@query("""SELECT count(*) FILTER (lower(trim(v)) IN ('', 'null', 'none', 'nan', 'n/a', 'na')) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN ' N/A' WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE 'x' END AS v FROM orders)""")
def emptyish_cells(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select(F.when(k == 0, " N/A").when(k == 1, "None").when(k == 2, "").otherwise("x").alias("v")).agg(F.count_if(is_emptyish(F.col("v"))).alias("n"))


def _samples(spark, d) -> DataFrame:
    """Signatures of four answers to one question: two agree on two columns, a third on one of them, a fourth on nothing."""
    n = table(spark, d, "nation")
    base = n.select("n_nationkey", "n_name")
    return A.sample_signatures([base, base.select(F.lower("n_name").alias("b"), "n_nationkey"), n.select("n_name", "n_regionkey", "n_nationkey"), n.select(F.lit(1).alias("one"), F.lit(2).alias("two"))])


@query("""SELECT nth, CAST(votes AS BIGINT) AS votes FROM (VALUES (0, 3), (1, 3), (2, 1), (3, 1), (4, 1)) t(nth, votes)""")
def vote_columns(spark, d):
    votes = A.column_votes(_samples(spark, d)).agg(F.sort_array(F.collect_list("votes"), asc=False).alias("v"))
    return votes.select(F.posexplode("v").alias("nth", "votes"))


@query("""SELECT CAST(2 AS BIGINT) AS width""")
def vote_modal_width(spark, d):
    return A.modal_width(_samples(spark, d))


@query("""SELECT 0 AS sample_id, CAST(2 AS BIGINT) AS coverage, CAST(0 AS BIGINT) AS extras""")
def best_sample(spark, d):
    sigs = _samples(spark, d)
    return A.best_sample(sigs, A.vote_winners(sigs))


@query("""SELECT * FROM (VALUES (0), (1)) t(col_idx)""")
def cross_intersect(spark, d):
    sigs = _samples(spark, d)
    return A.agreed_columns(sigs.where("sample_id = 0"), sigs.where("sample_id > 0"), agreement=3)


@query("""SELECT n_name, n_nationkey FROM nation""")
def voted_answer(spark, d):
    n = table(spark, d, "nation")
    answer, _ = A.voted_answer([n.select("n_name", "n_regionkey", "n_nationkey"), n.select("n_nationkey", F.lower("n_name").alias("b"), F.lit(1).alias("one"))])
    return answer


@query("""SELECT c_custkey, c_name FROM customer""")
def intersected_answer(spark, d):
    c = table(spark, d, "customer")
    return A.intersected_answer(c.select("c_custkey", "c_name", "c_acctbal"), [c.select(F.upper("c_name").alias("x"), F.col("c_custkey").cast("string").alias("y"))])


def _run(spark, d) -> DataFrame:
    tasks = spark.createDataFrame([(f"task_{i}",) for i in range(1, 5)], "task_id string")
    gold, noisy, n = _gold(spark, d), _noisy(_gold(spark, d)), table(spark, d, "nation")
    tagged = lambda df, t: A.signatures(df).withColumn("task_id", F.lit(t))
    golds = reduce(DataFrame.unionByName, [tagged(gold, "task_1"), tagged(n, "task_2"), tagged(n, "task_3")])
    preds = reduce(DataFrame.unionByName, [tagged(noisy, "task_1"), tagged(n.select("n_name", F.lit(0).alias("z")), "task_2"), tagged(n, "task_4")])
    return A.score_run(tasks, golds, preds)


@query("""SELECT task_id, error, CAST(gold_columns AS BIGINT) AS gold_columns, CAST(pred_columns AS BIGINT) AS pred_columns, CAST(matched AS BIGINT) AS matched, CAST(score AS DOUBLE) AS score FROM (VALUES ('task_1', CAST(NULL AS VARCHAR), 4, 5, 4, 0.9), ('task_2', NULL, 3, 2, 1, round(1 / 3.0 - 0.25, 6)), ('task_3', 'missing_prediction', 3, 0, 0, 0.0), ('task_4', 'missing_gold', 0, 3, 0, 0.0)) t(task_id, error, gold_columns, pred_columns, matched, score)""")
def score_run(spark, d):
    return _run(spark, d)


@query("""SELECT CAST(4 AS BIGINT) AS tasks, CAST(2 AS BIGINT) AS scored, round((0.9 + round(1 / 3.0 - 0.25, 6)) / 4, 6) AS mean_score, round((1 + 1 / 3.0) / 4, 6) AS mean_recall""")
def score_run_summary(spark, d):
    return A.run_summary(_run(spark, d))
