"""Queries of contexts: order, relevance, budgets, previews, schemas, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesense.functions.text import fenced_code
from tablesense.operators import context as X
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


@query("""
WITH f AS (SELECT 'p' || page_id || ['.md', '.bin', '.tsv', '.csv', '.png', '.jsonl', '.db'][CAST(page_id % 7 AS INTEGER) + 1] AS name, [5, 7, 1, 1, 6, 3, 2][CAST(page_id % 7 AS INTEGER) + 1] AS k, ['', '', 'tsv', 'csv', '', '', ''][CAST(page_id % 7 AS INTEGER) + 1] AS own FROM pages)
SELECT name, row_number() OVER (ORDER BY k, name) AS place FROM f""")
def kind_order(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".bin", ".tsv", ".csv", ".png", ".jsonl", ".db"))), (F.col("page_id") % 7 + 1).cast("int"))
    files = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id", suffix).alias("name"))
    return X.in_kind_order(files.withColumn("kind", X.shown_kind(F.regexp_extract("name", r"\.(\w+)$", 1)))).select("name", "place")


@query("""SELECT * FROM (VALUES ('orders', 3), ('customer', 1), ('nation', 0)) t(name, relevance)""")
def relevance_of_tables(spark, d):
    rows = [(t, [c.replace("_", " ") for c in table(spark, d, t).columns]) for t in ("orders", "customer", "nation")]
    df = spark.createDataFrame(rows, "name string, columns array<string>")
    return df.select("name", X.table_relevance(F.col("name"), F.col("columns"), F.lit("Which orders of a custkey have the highest totalprice?")).alias("relevance"))


@query("""
WITH RECURSIVE b AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
 f(conv_id, pos, used, shown) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM (SELECT DISTINCT conv_id FROM b)
  UNION ALL SELECT f.conv_id, b.pos, CAST(f.used + CASE WHEN f.used + size <= 600 THEN size WHEN f.used + 20 <= 600 THEN 20 ELSE 0 END AS BIGINT),
   CASE WHEN f.used + size <= 600 THEN 'block' WHEN f.used + 20 <= 600 THEN 'stub' ELSE 'none' END FROM f JOIN b ON b.conv_id = f.conv_id AND b.pos = f.pos + 1)
SELECT conv_id, pos, shown FROM f WHERE pos > 0""")
def pack_with_stubs(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint"))
    return X.packed_blocks(c.withColumn("size", F.char_length("text")).withColumn("stub", F.lit(20)), "conv_id", "pos", "size", "stub", 600)


@query("""SELECT doc_id, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 8""")
def positive_preview(spark, d):
    rows = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return X.preview_rows(rows, "doc_id", F.col("toxic") == 1)


@query("""SELECT o_orderkey, ['patient_id,birth_year,birthday_text', 'patient_id,creatinine,creatinine_abnormal,evidence', 'race_id,year,name,date', 'got,gpt', 'id,name,date,value', 'race_id,year,round,name,date,constructor_id,constructor_ref,url'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS fields FROM orders""")
def target_schema(spark, d):
    pick = lambda *values: F.element_at(F.array(*values), (F.col("o_orderkey") % 6 + 1).cast("int"))
    path = pick(*map(F.lit, ("doc/Patient.md", "Laboratory.md", "races.md", "x.md", "x.md", "race.md")))
    asked = pick(*map(F.lit, ("Who was born before 1950?", "Is creatinine high?", "Which grand prix?", "What?", "What?", "How fast?")))
    none = F.array().cast("array<string>")
    seen = pick(F.array(F.lit("got")), none, none, F.array(F.lit("got"), F.lit("gpt")), none, F.array(F.lit("year")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(X.target_schema(F.concat("o_orderstatus", F.lit("/"), path), asked, seen), ",").alias("fields"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 20 + 1 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n <= 8 THEN array_to_string(range(1, n + 1), ',') ELSE '1,2,3,4,...' || (n - 6) || ' more...,' || (n - 1) || ',' || n END AS shown FROM o""")
def signature_preview(spark, d):
    cells = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 20 + 1).cast("int")), lambda i: i.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(X.signature_preview(cells), ",").alias("shown"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation""")
def override_union(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return X.override_union(n.drop("n_regionkey"), n.where("n_regionkey = 1").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name")), "n_nationkey")


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15""")
def counter_summary(spark, d):
    return X.counter_summary(table(spark, d, "part"), "p_brand")


@query("""SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def first_success(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("ok"))
    return X.first_success(c, "turn", "ok", ["conv_id"]).select("conv_id", "turn")


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"note":"a\\nb"}' AS reply FROM events""")
def json_repair(spark, d):
    said = F.concat(F.lit("Here it is:\n```json\n"), F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "note": "a\nb"\n```'))
    return table(spark, d, "events").select("event_id", X.json_of_reply(said).alias("reply"))


@query("""SELECT o_orderkey, 'x = ' || o_orderkey AS code FROM orders""")
def code_of_reply(spark, d):
    said = F.concat(F.lit("Sure:\n```python\nx = "), F.col("o_orderkey").cast("string"), F.lit("\n```\nDone."))
    return table(spark, d, "orders").select("o_orderkey", fenced_code(said).alias("code"))


@query("""SELECT * FROM (VALUES (1, 'easy', 'light_table_easy'), (2, 'docs', 'task_type_routing'), (3, 'exec', 'task_type_auto'), (4, 'rag', 'task_type_auto'), (5, 'loop', 'task_type_auto'), (6, 'exec', 'default_route')) t(n, route, reason)""")
def route_rules(spark, d):
    routes = {"easy": {"kind": "light"}, "exec": {"kind": "operator_executor"}, "rag": {"kind": "operator_executor", "rag": True}, "docs": {"kind": "other"}, "loop": {"kind": "react"}}
    taken = [X.route("table_computation", routes, light=True), X.route("document_qa", routes, {"document_qa": "docs"}), X.route("table_computation", routes), X.route("mixed_context", routes), X.route("image_understanding", routes), X.route("pure_reasoning", {"exec": {"kind": "x"}}, default="exec")]
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(taken)], "n int, route string, reason string")
