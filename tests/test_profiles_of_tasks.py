"""JSON fields at any depth against a walk in Python; nested profiles of tasks."""

import collections
import json

from tablesense.operators import json_profile as J
from tablesense.operators import task_profile as TP
from tablesense.sources.files import read_delimited
from tablesense.sources.sinks import write_tsv

DOCS = [
    '{"a": true, "b": {"c": [1, 1.0, "1", null, {"d": []}], "e": {}}, "z": 1e2}',
    '{"a": 1, "b": {"c": [true, false, 0, -0.0, 2.50]}, "z": 100}',
    '[3, [3.0, [{"x": "y"}]]]',
    '"plain"',
    "7",
    "null",
    "not json",
    None,
    '{"a": 12345678901234567890123, "b": "null", "k.l": 1.5}',
    '{"deep": {"deep": {"deep": {"deep": {"deep": [[[["end"]]]]}}}}}',
]


def walk(value, path="$"):
    if isinstance(value, dict):
        for k in sorted(value):
            yield from walk(value[k], f"{path}.{k}")
    elif isinstance(value, list):
        for v in value:
            yield from walk(v, f"{path}[]")
    else:
        yield path, value


def expected(docs):
    found = collections.defaultdict(dict)
    for text in docs:
        try:
            root = json.loads(text or "")
        except ValueError:
            continue
        for path, value in walk(root):
            found[path][value] = found[path].get(value, 0) + 1  # true, 1 and 1.0 are one key
    return found


def test_fields_at_any_depth(spark):
    want = expected(DOCS)
    rows = J.json_field_profile(spark.createDataFrame(list(enumerate(DOCS)), "n int, j string").repartition(3), "n", "j").collect()
    assert {r["path"]: (r["cardinality"], r["n"]) for r in rows} == {p: (len(v), sum(v.values())) for p, v in want.items()}
    for path, values in want.items():
        got = sorted((r for r in rows if r["path"] == path), key=lambda r: r["rank"])
        assert [r["cnt"] for r in got] == sorted(values.values(), reverse=True)[:5]
    shown = [(r["value"], r["cnt"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["path"] == "$.b.c[]"]
    assert shown == [("1", 3), ("false", 3), ("1", 1), ("null", 1), ("2.5", 1)]  # the second 1 is a text
    assert next(r["value"] for r in rows if r["path"] == "$.a" and r["rank"] == 1) == "true"


def test_the_cap_counts_the_first_values(spark):
    docs = [(i, json.dumps({"v": i if i < 8 else 99})) for i in range(40)]
    rows = J.json_field_profile(spark.createDataFrame(docs, "n int, j string"), "n", "j", k=3, cap=4).orderBy("rank").collect()
    assert [(r["value"], r["cnt"], r["cardinality"], r["n"]) for r in rows] == [("0", 1, 4, 40), ("1", 1, 4, 40), ("2", 1, 4, 40)]


def test_no_documents(spark):
    assert J.json_field_profile(spark.createDataFrame([], "n int, j string"), "n", "j").count() == 0


def test_profiles_are_nested(spark):
    tasks = spark.createDataFrame([("t1", "easy", "How many ships are there?"), ("t2", "hard", "Which rule applies to each ship?"), ("t3", "easy", "Why?")], "task_id string, difficulty string, question string")
    ships = spark.createDataFrame([(1, "x", ""), (2, "y", None), (3, "x", "2020-01-02"), (4, "z", " ")], "id int, name string, built string").repartition(2)
    twice = ships.select("name", "name")
    sources = {("t1", "ships.csv"): (ships, "id"), ("t2", "ships.csv"): (ships.where("id < 3"), "id"), ("t2", "twice.tsv"): (twice, None)}
    files = spark.createDataFrame([("t1", "ships.csv", "csv", 10), ("t2", "ships.csv", "csv", 9), ("t2", "twice.tsv", "TSV", 9), ("t2", "doc/knowledge.md", "md", 7)], "task_id string, source string, kind string, length long")
    got = {r["task_id"]: r for r in TP.task_profiles(tasks, sources, files).collect()}
    assert [got[t]["answer_shape"] for t in ("t1", "t2", "t3")] == ["scalar", "table", "table"]
    assert [got[t]["task_type"] for t in ("t1", "t2", "t3")] == ["table_computation", "table_with_semantic_rule", "pure_reasoning"]
    (one,) = got["t1"]["sources"]
    assert (one["row_count"], one["role"]) == (4, "data")
    columns = {c["name"]: c for c in one["columns"]}
    assert [c["name"] for c in one["columns"]] == ["id", "name", "built"] and columns["id"]["dtype"] == "int"
    assert [(s["value"], s["cnt"]) for s in columns["name"]["samples"]] == [("x", 2), ("y", 1), ("z", 1)]
    assert (columns["built"]["dtype"], columns["built"]["n_empty"], columns["built"]["cardinality"]) == ("empty", 3, 3)
    rules, few, both = got["t2"]["sources"]
    assert (rules["role"], rules["columns"], few["row_count"], len(both["columns"])) == ("semantic_rule", None, 2, 2)
    assert got["t3"]["sources"] == [] and got["t2"]["tool_calls"] > got["t1"]["tool_calls"]


def test_routes_are_audited(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", "easy", "How many?"), ("t2", "hard", "Which rule?")], "task_id string, difficulty string, question string")
    files = spark.createDataFrame([("t1", "a.db", "db", 10), ("t2", "b.csv", "csv", 9), ("t2", "x\ty.zip", "zip", 9), ("t2", "knowledge.md", "md", 7)], "task_id string, source string, kind string, length long")
    table = spark.createDataFrame([(1, "x")], "id int, name string")
    profiles = TP.task_profiles(tasks, {("t2", "b.csv"): (table, "id")}, files)
    routes = {"direct": {"kind": "tablellm_direct", "model": "m1"}, "loop": {"kind": "react", "model": "m2"}}
    write_tsv(TP.route_audit(profiles, routes, {"table_with_semantic_rule": "loop"}), f"file://{tmp_path}/audit")
    rows = {r["task_id"]: r.asDict() for r in read_delimited(spark, f"file://{tmp_path}/audit", "\t").collect()}
    assert list(rows["t1"]) == list(TP.AUDIT_COLUMNS) and len(TP.AUDIT_COLUMNS) == 18
    one, two = rows["t1"], rows["t2"]
    assert (one["route"], one["route_reason"], one["kind"], one["model"]) == ("direct", "task_type_auto", "tablellm_direct", "m1")
    assert (one["primary_tool"], one["auxiliary_tools"], one["modalities"], one["source_kinds"]) == ("sql", "pandas", "table", "db:data")
    assert (two["route"], two["route_reason"], two["model"], two["difficulty"]) == ("loop", "task_type_routing", "m2", "hard")
    assert (two["modalities"], two["auxiliary_tools"]) == ("table,document,unknown", "document_parser,rag")
    assert two["sources"] == "b.csv:csv;knowledge.md:md;x y.zip:zip" and "semantic_rule_context" in two["flags"]


def test_views_cut_columns_and_samples(spark):
    wide = spark.range(9).selectExpr("id", *[f"id % 7 AS c{i}" for i in range(90)])
    tasks = spark.createDataFrame([("t", "easy", "q")], "task_id string, difficulty string, question string")
    files = spark.createDataFrame([("t", "w.csv", "csv", 1)], "task_id string, source string, kind string, length long")
    view = TP.schema_view(TP.task_profiles(tasks, {("t", "w.csv"): (wide, "id")}, files), samples=2).first()
    assert view["column_count"] == 91 and len(view["columns"]) == 80 and all(len(c["samples"]) == 2 for c in view["columns"])
    assert [c["name"] for c in view["columns"]][:3] == ["id", "c0", "c1"]
