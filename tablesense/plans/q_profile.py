"""Queries of profiles, catalogs and links between columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.functions import names as N
from tablesense.functions.cells import cell_dtype, date_value, value_label
from tablesense.operators import json_profile as J
from tablesense.operators import linking as L
from tablesense.operators import profile as P
from tablesense.operators import task_profile as TP
from tablesense.plans.q_core import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_CELLS = """SELECT c_custkey AS pos, col_name, value FROM (SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer) UNPIVOT (value FOR col_name IN (c_name, c_nationkey, c_mktsegment))"""


def _customer_cells(spark, d) -> DataFrame:
    return P.long_form(table(spark, d, "customer"), ["c_name", "c_nationkey", "c_mktsegment"], "c_custkey")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS row_count FROM {t}" for t in STAR) + ")")
def profile_row_counts(spark, d):
    return reduce(DataFrame.union, [table(spark, d, t).agg(F.lit(t).alias("source"), F.count("*").alias("row_count")) for t in STAR])


@query(f"""
WITH f AS (SELECT col_name, value, count(*) AS cnt, min(pos) AS first_pos FROM ({_CELLS}) GROUP BY 1, 2),
 g AS (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY first_pos, value) AS nth FROM f),
 h AS (SELECT col_name, value, cnt, CAST(row_number() OVER (PARTITION BY col_name ORDER BY cnt DESC, first_pos, value) AS BIGINT) AS rank FROM g WHERE nth <= 60)
SELECT * FROM h WHERE rank <= 5""")
def profile_top5_values(spark, d):
    return P.top_values(P.value_frequencies(_customer_cells(spark, d))).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""SELECT col_name, least(count(DISTINCT value), 60) AS cardinality FROM ({_CELLS}) GROUP BY 1""")
def profile_cardinality_cap60(spark, d):
    return P.cardinalities(P.value_frequencies(_customer_cells(spark, d)))


@query("""SELECT * FROM (VALUES ('event_id', 'int'), ('ts', 'date'), ('user_id', 'int'), ('event_type', 'str'), ('value', 'float'), ('props', 'str')) t(col_name, dtype)""")
def profile_dtype_vote(spark, d):
    e = table(spark, d, "events")
    return P.dtype_votes(P.long_form(e.select("*", F.col("event_id").alias("__pos")), e.columns, "__pos"))


@query("""SELECT event_type AS value, cnt, cardinality FROM (SELECT event_type, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, event_type NULLS FIRST LIMIT 5), (SELECT count(DISTINCT event_type) AS cardinality FROM events)""")
def profile_database_column(spark, d):
    return P.exact_profile(table(spark, d, "events"), "event_type")


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_props_fields(spark, d):
    e = table(spark, d, "events").withColumn("k", F.try_variant_get(F.parse_json("props"), "$.k", "bigint"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""SELECT 'k' AS field, min(event_id) AS first_pos FROM events""")
def record_fields_union(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return P.field_order(e, "m", "event_id").select("field", "first_pos")


def _catalog(spark, d) -> DataFrame:
    """source, col_name, cardinality, samples of a few columns: the least five values of each."""
    columns = (("nation", "n_nationkey"), ("nation", "n_name"), ("customer", "c_nationkey"), ("customer", "c_mktsegment"), ("supplier", "s_nationkey"), ("supplier", "s_suppkey"), ("region", "r_regionkey"), ("region", "r_name"), ("nation", "n_regionkey"), ("part", "p_brand"))
    one = lambda t, c: table(spark, d, t).agg(F.lit(t).alias("source"), F.lit(c).alias("col_name"), F.count_distinct(c).alias("cardinality"), F.slice(F.array_sort(F.collect_set(F.lpad(F.col(c).cast("string"), 3, " "))) if c.endswith("key") else F.array_sort(F.collect_set(c)), 1, 5).alias("samples"))
    return reduce(DataFrame.union, [one(t, c) for t, c in columns])


_CATALOG = " UNION ALL ".join(
    f"SELECT '{t}' AS source, '{c}' AS col_name, count(DISTINCT {c}) AS cardinality, list_slice(list_sort(list(DISTINCT {v})), 1, 5) AS samples FROM {t}"
    for t, c, v in (
        ("nation", "n_nationkey", "lpad(CAST(n_nationkey AS VARCHAR), 3, ' ')"),
        ("nation", "n_name", "n_name"),
        ("customer", "c_nationkey", "lpad(CAST(c_nationkey AS VARCHAR), 3, ' ')"),
        ("customer", "c_mktsegment", "c_mktsegment"),
        ("supplier", "s_nationkey", "lpad(CAST(s_nationkey AS VARCHAR), 3, ' ')"),
        ("supplier", "s_suppkey", "lpad(CAST(s_suppkey AS VARCHAR), 3, ' ')"),
        ("region", "r_regionkey", "lpad(CAST(r_regionkey AS VARCHAR), 3, ' ')"),
        ("region", "r_name", "r_name"),
        ("nation", "n_regionkey", "lpad(CAST(n_regionkey AS VARCHAR), 3, ' ')"),
        ("part", "p_brand", "p_brand"),
    )
)


@query(f"""
WITH c AS ({_CATALOG}), v AS (SELECT source, col_name, len(samples) AS n, unnest(list_transform(samples, lambda x: lower(trim(x)))) AS v FROM c),
 p AS (SELECT a.source AS left_source, a.col_name AS left_column, b.source AS right_source, b.col_name AS right_column, a.n AS na, b.n AS nb, count(*) AS met
  FROM v a JOIN v b ON a.v = b.v AND (a.source, a.col_name) < (b.source, b.col_name) GROUP BY ALL)
SELECT left_source, left_column, right_source, right_column, round(met / (na + nb - met), 3) AS jaccard FROM p WHERE round(met / (na + nb - met), 3) >= 0.15
ORDER BY jaccard DESC, left_source, left_column, right_source, right_column LIMIT 8""")
def fk_candidates_jaccard(spark, d):
    return L.links_by_value(_catalog(spark, d))


def _names(spark, d) -> DataFrame:
    rows = [(t, c) for t in STAR for c in table(spark, d, t).columns] + [("attendance", "link_to_event"), ("event", "event_id"), ("event", "Event-Name"), ("budget", "event_name")]
    return spark.createDataFrame(rows, "source string, col_name string")


@query("""
WITH c AS (SELECT table_name AS source, column_name AS col_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')
  UNION ALL SELECT * FROM (VALUES ('attendance', 'link_to_event'), ('event', 'event_id'), ('event', 'Event-Name'), ('budget', 'event_name')) t(a, b)),
 n AS (SELECT source, col_name, regexp_replace(lower(col_name), '[^a-z0-9]+', '', 'g') AS name FROM c),
 s AS (SELECT *, CASE WHEN name LIKE '%id' AND length(name) > 2 THEN left(name, length(name) - 2) END AS stem FROM n),
 p AS (SELECT a.source AS left_source, a.col_name AS left_column, b.source AS right_source, b.col_name AS right_column, a.name = b.name AS same,
   coalesce(a.name = 'linkto' || b.stem, false) OR coalesce(b.name = 'linkto' || a.stem, false) AS link,
   coalesce(contains(a.stem, b.stem) OR contains(b.stem, a.stem), false) AS stems, max(a.name = b.name) OVER (PARTITION BY a.source, b.source) AS shares
  FROM s a JOIN s b ON a.source < b.source)
SELECT left_source, left_column, right_source, right_column, CASE WHEN same THEN 'same_normalized_name' WHEN link THEN 'link_to_foreign_key' ELSE 'related_id_name' END AS reason
FROM p WHERE same OR link OR (stems AND NOT shares) ORDER BY left_source, right_source, reason, left_column, right_column LIMIT 40""")
def fk_candidates_name(spark, d):
    return L.links_by_name(_names(spark, d))


@query(f"""
WITH c AS ({_CATALOG}), q AS (SELECT unnest(['nation', 'segment', 'building', 'europe', 'brand', 'region']) AS concept),
 x AS (SELECT concept, source, col_name, cardinality, samples, lower(concept) AS a, regexp_replace(lower(col_name), '[_.]', ' ', 'g') AS b FROM q, c),
 y AS (SELECT *, CASE WHEN a = b OR list_contains(string_split_regex(b, '\\s+'), a) THEN 1.0 WHEN contains(b, a) OR contains(a, b) THEN 0.85 ELSE 1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b), 1) AS DOUBLE) END AS s,
   len(list_filter(samples, lambda v: NOT regexp_matches(lower(trim(v)), '^[+-]?[0-9.]+$') AND trim(v) <> '' AND (contains(lower(trim(v)), a) OR contains(a, lower(trim(v)))))) > 0 AS hit FROM x),
 z AS (SELECT *, greatest(s, CASE WHEN hit THEN 0.9 ELSE 0.0 END) AS base FROM y),
 w AS (SELECT concept, source, col_name, round(CAST(least(base + CASE WHEN cardinality BETWEEN 1 AND 12 AND base >= 0.4 THEN 0.05 ELSE 0 END, 1.0) AS DOUBLE), 4) AS score FROM z),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY concept ORDER BY score DESC, source, col_name) AS BIGINT) AS rank FROM w WHERE score >= 0.4)
SELECT * FROM r WHERE rank <= 3""")
def concept_binding(spark, d):
    q = spark.createDataFrame([(x,) for x in ("nation", "segment", "building", "europe", "brand", "region")], "concept string")
    return L.bind_concepts(q, _catalog(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("")
def fuzzy_column_ratio(spark, d):
    known = [c for t in STAR for c in table(spark, d, t).columns]
    wanted = ("cust_key", "order date", "Ship-Date", "retail", "market segment")
    rows = [(w, c, round(N.name_ratio(w, c), 4)) for w in wanted for c in N.close_names(w, known)]
    return spark.createDataFrame(rows, "wanted string, col_name string, ratio double")


@query("""SELECT path FROM (SELECT 'csv/' || p_brand || '-' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.csv' ELSE '.json' END AS path FROM part) WHERE path LIKE '%.csv' ORDER BY levenshtein(path, 'csv/Brand#15.csv'), path LIMIT 1""")
def closest_path(spark, d):
    name = F.concat(F.lit("csv/"), "p_brand", F.lit("-"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".csv").otherwise(".json"))
    return L.closest_path(table(spark, d, "part").select(name.alias("path")), "csv/Brand#15.csv")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 5 = 1 THEN 'bool' WHEN o_orderkey % 5 = 2 THEN 'int' WHEN o_orderkey % 5 = 3 THEN 'float' ELSE 'date' END AS dtype,
 CASE WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 5 = 1 THEN 'string' WHEN o_orderkey % 5 IN (2, 3) THEN 'number' ELSE 'string' END AS label FROM orders""")
def cell_types(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "  ").when(k == 1, "Yes").when(k == 2, F.concat(F.lit(" +1_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).when(k == 3, "1e5").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH"))
    return table(spark, d, "orders").select("o_orderkey", cell_dtype(text).alias("dtype"), value_label(text).alias("label"))


@query("""
WITH f AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'db' WHEN 2 THEN 'md' WHEN 3 THEN 'png' ELSE 'docx' END AS kind, n_chars FROM documents)
SELECT count(*) AS file_count, count(DISTINCT kind) AS kind_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN kind IN ('md', 'docx') THEN n_chars END) AS BIGINT) AS document_bytes, CAST(sum(CASE WHEN kind IN ('csv', 'db') THEN n_chars END) AS BIGINT) AS table_bytes FROM f""")
def size_totals(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("csv", "db", "md", "png", "docx"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return P.size_totals(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), kind.alias("kind"), F.col("n_chars").alias("length")))


@query("""
WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
 c AS (SELECT event_id, '$.k' AS path, 0 AS slot, 'n:' || k AS class, CAST(k AS VARCHAR) AS shown FROM e
  UNION ALL SELECT event_id, '$.flag', 0, CASE WHEN event_id % 4 = 3 THEN 's:1' ELSE 'n:1' END, CASE event_id % 4 WHEN 0 THEN 'true' ELSE '1' END FROM e
  UNION ALL SELECT event_id, '$.in.kind', 0, 's:' || event_type, event_type FROM e
  UNION ALL SELECT event_id, '$.in.pair[]', 0, 'n:' || event_id % 7, CAST(event_id % 7 AS VARCHAR) FROM e
  UNION ALL SELECT event_id, '$.in.pair[]', 1, 'null', 'null' FROM e
  UNION ALL SELECT event_id, '$.in.pair[].deep', 2, 's:' || event_id % 3, CAST(event_id % 3 AS VARCHAR) FROM e),
 f AS (SELECT path, class, count(*) AS cnt, min(event_id * 10 + slot) AS first, arg_min(shown, event_id * 10 + slot) AS value FROM c GROUP BY 1, 2),
 g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first) AS nth, count(*) OVER (PARTITION BY path) AS different, sum(cnt) OVER (PARTITION BY path) AS n FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cnt DESC, first) AS rank FROM g WHERE nth <= 60)
SELECT path, rank, value, cnt, CAST(least(different, 60) AS BIGINT) AS cardinality, CAST(n AS BIGINT) AS n FROM h WHERE rank <= 5""")
def json_field_profile(spark, d):
    e = table(spark, d, "events")
    k = F.expr("get_json_object(props, '$.k')")
    flag = F.element_at(F.array(F.lit("true"), F.lit("1"), F.lit("1.0"), F.lit('"1"')), (F.col("event_id") % 4 + 1).cast("int"))
    pair = F.concat(F.lit("["), F.col("event_id") % 7, F.lit(',null,{"deep":"'), F.col("event_id") % 3, F.lit('"},[],{}]'))
    text = F.concat(F.lit('{"k":'), k, F.lit(',"flag":'), flag, F.lit(',"in":{"kind":"'), "event_type", F.lit('","pair":'), pair, F.lit("}}"))
    return J.json_field_profile(e.select("event_id", text.alias("doc")), "event_id", "doc")


_PROFILED = {"task_1": (("customer", "c_custkey"), ("nation", "n_nationkey")), "task_2": (("part", "p_partkey"), ("supplier", "s_suppkey"), ("region", "r_regionkey")), "task_3": (("orders", "o_orderkey"),)}
_COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_mktsegment",
    "nation": "n_nationkey n_name n_regionkey",
    "part": "p_partkey p_name p_brand p_type p_size",
    "supplier": "s_suppkey s_name s_nationkey",
    "region": "r_regionkey r_name",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
}
_ALL_CELLS = " UNION ALL ".join(f"SELECT '{task}' AS task_id, '{t}.csv' AS source, {n} AS col_no, '{c}' AS name, {pos} AS pos, CAST({c} AS VARCHAR) AS value FROM {t}" for task, tables in _PROFILED.items() for t, pos in tables for n, c in enumerate(_COLUMNS[t].split()))


@query(f"""
WITH seen AS (SELECT task_id, source, name, value, count(*) AS cnt, min(pos) AS first FROM ({_ALL_CELLS}) GROUP BY 1, 2, 3, 4),
 nth AS (SELECT *, row_number() OVER (PARTITION BY task_id, source, name ORDER BY first, value) AS nth FROM seen),
 best AS (SELECT *, row_number() OVER (PARTITION BY task_id, source, name ORDER BY cnt DESC, first, value) AS r FROM nth WHERE nth <= 60),
 whole AS (SELECT task_id, source, name, CAST(sum(cnt) AS BIGINT) AS row_count, least(count(*), 60) AS cardinality, bool_and(regexp_full_match(value, '[0-9]+')) AS whole FROM seen GROUP BY 1, 2, 3)
SELECT w.task_id, w.source, w.name, row_count, cardinality, CASE WHEN whole THEN 'int' ELSE 'str' END AS dtype, string_agg(value || '=' || cnt, '|' ORDER BY r) AS samples
FROM whole w JOIN best b ON b.task_id = w.task_id AND b.source = w.source AND b.name = w.name AND r <= 5 GROUP BY ALL""")
def task_profiles(spark, d):
    tasks = spark.createDataFrame([(t, "easy", "How many of them are there for each nation?") for t in _PROFILED], "task_id string, difficulty string, question string")
    sources = {(task, f"{t}.csv"): (table(spark, d, t).select(*_COLUMNS[t].split()), pos) for task, tables in _PROFILED.items() for t, pos in tables}
    files = spark.createDataFrame([(task, source, "csv", 1000) for task, source in sources], "task_id string, source string, kind string, length long")
    profiles = TP.task_profiles(tasks, sources, files)
    each = TP.schema_view(profiles).select("task_id", "source", "row_count", F.explode("columns").alias("c"))
    return each.select("task_id", "source", "c.name", "row_count", "c.cardinality", "c.dtype", F.array_join(F.transform("c.samples", lambda x: F.concat_ws("=", x["value"], x["cnt"])), "|").alias("samples"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS long_form, CAST(o_orderdate AS DATE) AS short_form, CAST(o_orderdate AS DATE) AS signs, CAST(NULL AS DATE) AS wrong FROM orders""")
def month_name_dates(spark, d):
    day, at = F.dayofmonth("o_orderdate"), F.col("o_orderdate")
    suffix = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    long = F.concat(F.date_format(at, "MMMM"), F.lit(" "), day, suffix, F.lit(", "), F.year(at))
    short = F.concat(F.lit(" "), day, F.lit(" "), F.upper(F.date_format(at, "MMM")), F.lit(". "), F.year(at))
    wrong = F.concat(F.lit("February 30, "), F.year(at))
    return table(spark, d, "orders").select("o_orderkey", date_value(long).alias("long_form"), date_value(short).alias("short_form"), date_value(F.date_format(at, "M/d/yyyy")).alias("signs"), date_value(wrong).alias("wrong"))
