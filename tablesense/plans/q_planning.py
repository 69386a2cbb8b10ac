"""Queries of question profiles, budgets and plans, of repairs, and of files written and read back."""

from __future__ import annotations

import sqlite3
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.plans import checks as C
from tablesense.plans import routing as G
from tablesense.plans.dialect import sqlite_sql
from tablesense.plans.q_core import table
from tablesense.plans.spec import Filter, Join, Measure, QuerySpec
from tablesense.sources import files as S
from tablesense.sources import sinks as K
from tablesense.sources.delimited import scan_delimited
from tablesense.sources.sqlite_ds import read_sqlite, sqlite_catalog
from tablesense.sources.store import work_folder
from tablesense.streaming import events as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Beginnings that make questions of benchmark texts, by item.
OPENERS = ("How many", "What is the average", "Which of the top 5", "Is the highest", "Compare the ratio between", "List all", "For each month, show the sum of", "Name those whose total is related to")
_Q = "(SELECT item_id, list_extract([" + ", ".join(f"'{o}'" for o in OPENERS) + f"], CAST(item_id % {len(OPENERS)} AS INTEGER) + 1) || ' ' || text AS q FROM benchmark)"


def _questions(spark, d) -> DataFrame:
    opener = F.element_at(F.array(*map(F.lit, OPENERS)), (F.col("item_id") % len(OPENERS) + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.concat(opener, F.lit(" "), "text").alias("q"))


def _re(p: str) -> str:
    return p.replace("'", "''")


@query(f"""SELECT item_id, CASE WHEN regexp_matches(lower(trim(q)), '{G.BOOLEAN}') THEN 'boolean' WHEN regexp_matches(lower(q), '{G.COUNT}') OR regexp_matches(lower(q), '{G.AGGREGATE}') OR regexp_matches(lower(q), '{G.RATIO}') THEN 'scalar' ELSE 'table' END AS shape FROM {_Q}""")
def answer_shape(spark, d):
    return _questions(spark, d).select("item_id", G.answer_shape(F.col("q")).alias("shape"))


@query(f"""
WITH q AS (SELECT item_id, lower(q) AS q FROM {_Q}), o AS (SELECT item_id, list_filter([
 CASE WHEN regexp_matches(q, '{G.FILTER}') THEN 'filter' END, CASE WHEN regexp_matches(q, '{G.JOIN}') THEN 'join' END, CASE WHEN regexp_matches(q, '{G.GROUP}') THEN 'groupby' END,
 CASE WHEN regexp_matches(q, '{G.COUNT}') OR regexp_matches(q, '{G.AGGREGATE}') THEN 'aggregate' END, CASE WHEN regexp_matches(q, '{G.TOP}') THEN 'sort' END, CASE WHEN regexp_matches(q, '{G.TOP}') THEN 'topk' END,
 CASE WHEN regexp_matches(q, '{G.COMPARE}') OR regexp_matches(q, '{G.RATIO}') THEN 'compare' END, CASE WHEN regexp_matches(q, '{G.COMPARE}') OR regexp_matches(q, '{G.RATIO}') THEN 'compute' END], lambda x: x IS NOT NULL) AS ops FROM q)
SELECT item_id, CASE WHEN len(ops) = 0 THEN 'filter' ELSE array_to_string(ops, ',') END AS operations FROM o""")
def question_ops(spark, d):
    ops = G.operations(F.col("q"), F.lit(False), F.lit(True), F.lit(False))
    return _questions(spark, d).select("item_id", F.array_join(ops, ",").alias("operations"))


_POINTS = " + ".join(f"CAST(contains(q, '{w}') AS INTEGER)" for w in G.AGGREGATION_WORDS)
_HOPS = " + ".join(f"CAST(contains(q, '{w}') AS INTEGER)" for w in G.HOP_WORDS)


@query(f"""
WITH q AS (SELECT item_id, lower(q) AS q, q AS raw FROM {_Q}), p AS (SELECT item_id, 1 + 1 + 0 + 1 + 0 + 1 + 0 + CAST(len(list_filter(string_split_regex(raw, '\\s+'), lambda w: w <> '')) >= 22 AS INTEGER) + CAST(({_POINTS}) >= 2 AS INTEGER) + CAST(({_HOPS}) >= 1 AS INTEGER) + CAST(({_HOPS}) >= 2 AS INTEGER) AS points FROM q)
SELECT item_id, points, CASE WHEN points <= 1 THEN 'Easy' WHEN points <= 3 THEN 'Medium' WHEN points <= 6 THEN 'Hard' ELSE 'Extreme' END AS bucket FROM p""")
def difficulty_bucket(spark, d):
    points = G.difficulty_points(F.col("q"), F.lit(5), F.lit(2), F.lit(1), F.lit(0), F.lit(300_000))
    return _questions(spark, d).withColumn("points", points).select("item_id", "points", G.difficulty_bucket(F.col("points")).alias("bucket"))


_KINDS = (*G.BUDGETS, "something_else")
_DIFFICULTIES = ("easy", "MEDIUM", "hard", "extreme", "other")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""
WITH o AS (SELECT o_orderkey, {_listed(_KINDS)}[CAST(o_orderkey % {len(_KINDS)} AS INTEGER) + 1] AS kind, {_listed(_DIFFICULTIES)}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS difficulty, CAST(o_orderkey % 2 = 0 AS INTEGER) AS many, CAST(o_orderkey % 3 = 0 AS INTEGER) AS large, CAST(o_orderkey % 7 = 0 AS INTEGER) AS unsure FROM orders),
 b AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {m}, {t})" for k, (m, t) in G.BUDGETS.items())}) v(kind, m, t)), e AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {n})" for k, n in G.DIFFICULTY_CALLS.items())}) v(difficulty, more)),
 c AS (SELECT o_orderkey, o.kind, o.difficulty, least(coalesce(m, 10) + coalesce(more, 1) + many + 6 * large + unsure, 30) AS model_calls, least(coalesce(t, 18) + 2 * coalesce(more, 1) + 4 * many + 8 * large + 2 * unsure, 60) AS tool_calls
  FROM o LEFT JOIN b ON b.kind = o.kind LEFT JOIN e ON e.difficulty = lower(o.difficulty))
SELECT o_orderkey, kind, CASE WHEN model_calls <= 9 THEN 'small' WHEN model_calls <= 14 THEN 'medium' WHEN model_calls <= 22 THEN 'large' ELSE 'xlarge' END AS level, model_calls, tool_calls FROM c""")
def budget_levels(spark, d):
    key = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    flags = F.filter(F.array(F.when(key % 2 == 0, "many_files"), F.when(key % 3 == 0, "large_document_context"), F.when(key % 7 == 0, "low_confidence")), lambda x: x.isNotNull())
    tasks = table(spark, d, "orders").select("o_orderkey", pick(_KINDS).alias("kind"), pick(_DIFFICULTIES).alias("difficulty"), flags.alias("flags"))
    level, model, tools = G.budget(F.col("kind"), F.col("difficulty"), F.col("flags"))
    return tasks.select("o_orderkey", "kind", level.alias("level"), model.alias("model_calls"), tools.alias("tool_calls"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS tables, o_orderkey % 3 = 0 AS docs, o_orderkey % 5 = 0 AS records, o_orderkey % 7 = 0 AS rules, o_orderkey % 11 = 0 AS images, o_orderkey % 4 = 1 AS db FROM orders),
 t AS (SELECT *, CASE WHEN records AND rules THEN 'record_text_with_semantic_rule' WHEN tables AND rules THEN 'table_with_semantic_rule' WHEN tables AND (records OR docs) THEN 'mixed_context' WHEN docs AND NOT images THEN 'document_qa'
  WHEN tables AND NOT images THEN 'table_computation' WHEN images AND NOT (tables OR docs) THEN 'image_understanding' WHEN images THEN 'mixed_context' ELSE 'pure_reasoning' END AS kind FROM o)
SELECT o_orderkey, kind, CASE WHEN kind = 'record_text_with_semantic_rule' THEN 'document_extractor' WHEN kind IN ('table_with_semantic_rule', 'mixed_context') THEN 'pandas' WHEN kind = 'table_computation' THEN CASE WHEN db THEN 'sql' ELSE 'pandas' END
  WHEN kind = 'document_qa' THEN 'rag' WHEN kind = 'image_understanding' THEN 'vision' ELSE 'react' END AS tool,
 CASE kind WHEN 'record_text_with_semantic_rule' THEN 'pandas,document_parser,rag' WHEN 'table_with_semantic_rule' THEN CASE WHEN db THEN 'sql,' ELSE '' END || 'document_parser,rag' WHEN 'table_computation' THEN CASE WHEN db THEN 'pandas' ELSE 'sql' END
  WHEN 'document_qa' THEN 'document_parser' WHEN 'mixed_context' THEN CASE WHEN db THEN 'sql,rag' ELSE 'document_parser,rag' END ELSE '' END AS others FROM t""")
def task_type_rules(spark, d):
    has = lambda n, rest=0: F.col("o_orderkey") % n == rest
    kind = G.task_type(has(2, 1), has(3), has(5), has(7), has(11))
    return table(spark, d, "orders").withColumn("kind", kind).select("o_orderkey", "kind", G.primary_tool(F.col("kind"), has(4, 1)).alias("tool"), F.array_join(G.auxiliary_tools(F.col("kind"), has(4, 1)), ",").alias("others"))


@query(f"""WITH q AS (SELECT item_id, lower(q) AS q FROM {_Q}) SELECT item_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(q, '\\b{w}\\b') THEN '{w}' END" for w in G.WEAK)}], lambda x: x IS NOT NULL), ',') AS weak FROM q""")
def weak_words(spark, d):
    return _questions(spark, d).select("item_id", F.array_join(G.weak_words(F.col("q")), ",").alias("weak"))


@query("""
WITH RECURSIVE n(id) AS (VALUES ('a'), ('b'), ('c'), ('d'), ('e')), e(id, dep) AS (VALUES ('c', 'a'), ('c', 'b'), ('d', 'c'), ('e', 'a')),
 l(id, layer) AS (SELECT id, 0 FROM n UNION ALL SELECT e.id, l.layer + 1 FROM l JOIN e ON e.dep = l.id)
SELECT id AS subtask, CAST(max(layer) AS INTEGER) AS layer FROM l GROUP BY 1""")
def dag_layers(spark, d):
    layers = G.topological_layers({"a": [], "b": [], "c": ["a", "b"], "d": ["c"], "e": ["a", "elsewhere"]})
    return spark.createDataFrame([(k, i) for i, names in enumerate(layers) for k in names], "subtask string, layer int")


@query("""SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def spec_repair_column(spark, d):
    spec = QuerySpec("order", groups=("O-OrderStatus",), measures=(Measure("n", "count"),))
    return C.run_spec(spec, {"orders": table(spark, d, "orders")})


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(o_orderpriority) = lower('1-URGENT')""")
def zero_row_retry(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.format_string("%d.0", "o_custkey").alias("cust"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    spec = QuerySpec("orders", joins=(Join("customer", ("cust",), ("c_custkey",)),), filters=(Filter("o_orderpriority", "=", "1-urgent"),), columns=("o_orderkey", "c_name"))
    return C.run_spec(spec, {"orders": orders, "customer": customers})


@query("""SELECT * FROM (VALUES (1, 'no_such_column'), (2, 'no_such_table'), (3, 'bad_join_key'), (4, 'none')) t(n, code)""")
def check_codes(spark, d):
    have = {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")}
    specs = [QuerySpec("orders", filters=(Filter("nothing_like_it", "=", 1),)), QuerySpec("elsewhere"), QuerySpec("orders", joins=(Join("customer", ("o_custkey",), ("no_key",)),)), QuerySpec("orders", filters=(Filter("o_orderkey", "=", 1),))]
    rows = [(i + 1, found[0].code if (found := C.check(s, have)) else "none") for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, "n int, code string")


@query("""SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1""")
def guarded_sql(spark, d):
    view = f"nation_{uuid.uuid4().hex}"
    table(spark, d, "nation").createOrReplaceTempView(view)
    return C.read_only_sql(spark, f"SELECT n_regionkey, count(*) AS n FROM {view} GROUP BY n_regionkey")[0]


@query("""
SELECT o_orderkey // 7 AS weeks, o_totalprice / 7 AS seventh, 3 * o_custkey // 2 AS more, CASE WHEN o_orderpriority ILIKE '%urgent' THEN 'like / urgent' ELSE 'no' END AS urgent,
  substr(o_orderstatus || o_orderkey, 2) AS code, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate) + INTERVAL 40 DAY, '%Y-%m-%d') AS later,
  CAST(NULL AS DOUBLE) AS nothing, CAST(0 AS BIGINT) AS bad, regexp_matches(o_orderpriority, '^[1-3]-.*$') AS soon, greatest(o_custkey, 500) AS most
FROM orders""")
def sqlite_dialect(spark, d):
    view = f"orders_{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView(view)
    said = f"""
    SELECT CAST([o_orderkey] / 7 AS INTEGER) AS weeks, o_totalprice / 7 AS seventh, CAST(3 * o_custkey / 2 AS INTEGER) AS more, IIF(o_orderpriority LIKE '%URGENT', 'like / urgent', 'no') AS urgent,
      substr("o_orderstatus" || o_orderkey, 2) AS code, strftime('%Y-%m', o_orderdate) AS month, date(o_orderdate, 'start of month', '+40 days') AS later,
      o_totalprice / 0 AS nothing, CAST(o_orderstatus AS INT) AS bad, o_orderpriority GLOB '[1-3]-*' AS soon, max(o_custkey, 500) AS most
    FROM {view} -- a comment with a / b like c
    """
    return spark.sql(sqlite_sql(said))


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; without it, one of this process."""
    return work_folder(spark, "files")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "' || chr(10) || 'x' AS c_name, c_mktsegment FROM customer""")
def csv_roundtrip(spark, d):
    path = f"{_folder(spark)}/answer"
    K.write_answer(table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "\nx')).alias("c_name"), "c_mktsegment"), path, single_file=False)
    return S.read_delimited(spark, path)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS width, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || ', "' || chr(10) || c_mktsegment END AS second FROM customer""")
def ragged_scan(spark, d):
    path, k = f"{_folder(spark)}/ragged", F.col("c_custkey") % 3
    quoted = F.concat(F.lit('"'), "c_name", F.lit(', ""\n'), "c_mktsegment", F.lit('"'))
    line = F.concat(F.col("c_custkey").cast("string"), F.when(k == 0, "").otherwise(F.concat(F.lit(","), quoted)), F.when(k == 1, ",more").otherwise(""))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    rows = scan_delimited(spark, path)
    return rows.select(F.get("cells", F.lit(0)).alias("key"), F.size("cells").alias("width"), F.get("cells", F.lit(1)).alias("second"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part""")
def tsv_audit(spark, d):
    path = f"{_folder(spark)}/audit"
    K.write_tsv(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), path)
    return S.read_delimited(spark, path, "\t")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation""")
def json_records_roundtrip(spark, d):
    path = f"{_folder(spark)}/records"
    n = table(spark, d, "nation").agg(F.to_json(F.struct(F.lit("nation").alias("table"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("records"))).alias("value"))
    n.write.text(path)
    return S.read_records(spark, path)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey > 1""")
def sqlite_scan(spark, d):
    path = _sqlite(spark, d)
    return read_sqlite(spark, path, "nation").where("n_regionkey > 1")


def _sqlite(spark, d) -> str:
    root = _folder(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("a SQLite file is opened by its path: spark.checkpoint.dir must be a folder that all machines mount")
    folder = Path(root.removeprefix("file://"))
    folder.mkdir(parents=True, exist_ok=True)
    rows = [tuple(r) for r in table(spark, d, "nation").collect()]  # 25 rows at every scale
    with sqlite3.connect(folder / "nation.db") as c:
        c.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        c.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
    return str(folder / "nation.db")


@query("""SELECT * FROM (VALUES ('nation', 'n_nationkey', 'INTEGER', CAST(25 AS BIGINT)), ('nation', 'n_name', 'TEXT', 25), ('nation', 'n_regionkey', 'INTEGER', 25)) t(table_name, column_name, declared, row_count)""")
def sqlite_catalog_scan(spark, d):
    return sqlite_catalog(spark, _sqlite(spark, d)).drop("sql")


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark, d):
    return E.tumbling_counts(table(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, no""")
def events_sessions(spark, d):
    return E.sessions(table(spark, d, "events"))
