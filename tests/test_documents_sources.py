"""Chunks, extraction, retrieval, files, SQLite, planning and streams."""

import json
import sqlite3
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesense.operators import documents as D
from tablesense.operators import extraction as X
from tablesense.operators import retrieval as R
from tablesense.plans import routing as G
from tablesense.sources import files as S
from tablesense.sources import sinks as K
from tablesense.sources.sqlite_ds import read_sqlite, register_tables, sqlite_catalog
from tablesense.streaming import events as E


def test_sections_follow_headings(spark):
    md = "before\n# A\none\n## B\ntwo\n#### C\nthree\n##### not one\n## D\n\n# E\nfive\n### F\nsix"
    got = {tuple(r["heading_path"]): r["raw_text"] for r in D.sections(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").collect()}
    assert got == {(): "before", ("A",): "one", ("A", "B"): "two", ("A", "B", "C"): "three\n##### not one", ("E",): "five", ("E", "F"): "six"}


def test_window_chunks():
    assert list(D.window_chunks("short")) == ["short"] and list(D.window_chunks("  ")) == []
    assert list(D.window_chunks("a" * 30, 10, 3)) == ["a" * 10, "a" * 10, "a" * 10, "a" * 9]
    assert list(D.window_chunks("aaaa\n\nbbbb\n\ncccc", 10, 2)) == ["aaaa\n\nbbbb", "bb\n\ncccc"]
    assert list(D.window_chunks("aa\n\n" + "b" * 25 + "\n\ncc", 10, 0)) == ["aa", "b" * 10, "b" * 10, "b" * 5, "cc"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=30), max_size=12), st.integers(5, 40), st.integers(0, 4))
def test_window_chunks_lose_nothing(parts, most, overlap):
    text = "\n\n".join(parts)
    chunks = "".join(D.window_chunks(text, most, overlap))
    for part in (p.strip() for p in parts):
        assert all(c in chunks for c in part.split() if len(c) <= most - overlap)


def test_record_and_json_chunks():
    assert list(D.record_chunks("id 123 a\n\nid 456 b\n\nnothing", 20)) == ["id 123 a\n\nid 456 b"]
    doc = json.dumps({"records": [{"a": "x" * 40}, {"a": "y"}], "n": 1})
    got = list(D.json_chunks(doc, 60, 4))
    assert got[0] == (["$"], 'top-level keys: ["records", "n"]\nrecords count: 2')
    assert [p for p, _ in got[1:]] == [["$", "records[0]"], ["$", "records[1]"], ["$", "n"]]
    assert list(D.json_chunks("not json")) == []


def test_extraction(spark):
    note = "Patient 12345 (female) was born on March 4th, 1944; records later said 1945. GOT was 35.0 U/L; corrected to 28.0 U/L. Creatinine 1.1 mg/dL, then 1.4 mg/dL, elevated."
    df = spark.createDataFrame([(0, note), (1, None), (2, "id 7")], "pos int, t string")
    c = F.col("t")
    r = X.corrected(X.extract_fields(df.where("pos = 0"), "t"), "t").select("*", X.birth_year(c).alias("born"), X.lab_value(c).alias("lab"), X.is_abnormal(X.lab_value(c), c).alias("bad")).first()
    assert (r["patient_id"], r["sex"], r["birthday"], r["got"], r["creatinine"], r["url"]) == (12345, "female", "March 4th, 1944", 28.0, 1.1, None)
    assert (r["born"], r["lab"], r["bad"]) == (1945, 1.4, True)
    assert df.where(X.is_record_block(c)).count() == 1
    assert X.corrections_of("T-BIL 2.0 mg/dL, amended to 1.5 mg/dL") == {"t_bil": 1.5} and X.corrections_of(None) == {}


def test_legalities_merge_by_field(spark):
    rows = [(0, "ID 123 has cards_id 4 in commander"), (1, "ID 123 is banned"), (2, "ID 55 alone"), (3, "no number, legal")]
    got = X.legalities(spark.createDataFrame(rows, "pos int, t string"), "t", "pos").collect()
    assert [tuple(r) for r in got] == [("123", 4, "commander", "Banned", 0)]


def test_retrieval_ranks_fuses_and_cuts(spark):
    chunks = spark.createDataFrame([(1, "red apple tree"), (2, "green apple"), (3, "blue sky"), (4, None)], "id int, t string")
    asked = spark.createDataFrame([("q", "red apple"), ("none", "zzz")], "qid string, q string")
    top = R.top_k(R.bm25(chunks, asked, "id", "t", "qid", "q"), "qid", "id")
    assert [(r["qid"], r["id"]) for r in sorted(top.collect(), key=lambda r: r["rank"])] == [("q", 1), ("q", 2)]
    tf = R.top_k(R.tfidf(chunks, asked, "id", "t", "qid", "q"), "qid", "id")
    fused = {r["id"]: r["score"] for r in R.fuse([top, tf], "qid", "id").collect()}
    assert fused[1] == pytest.approx(2 / 61) and fused[2] == pytest.approx(2 / 62)
    cut = R.within_budget(top, "qid", "rank", F.lit(10), 5)
    assert [r["id"] for r in cut.collect()] == [1]
    both = R.retrieve(chunks, asked, "id", "t", "qid", "q", encoder=R.hashed_terms(64), final=1)
    assert [(r["qid"], r["id"]) for r in both.where("qid = 'q'").collect()] == [("q", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n3\n4,5,6\n')
    (tmp_path / "sub" / "r.json").write_text(json.dumps({"table": [{"z": 1}], "records": [{"k": 1, "n": {"m": 2}}, {"k": 2}]}))
    (tmp_path / "knowledge.md").write_text("creatinine above 1.2")
    (tmp_path / "prediction.csv").write_text("a\n")
    (tmp_path / ".hidden.csv").write_text("a\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    listed = {r["path"]: (r["kind"], r["role"]) for r in S.listing(spark, str(tmp_path)).collect()}
    assert listed == {"a.csv": ("csv", "data"), "sub/r.json": ("json", "data"), "knowledge.md": ("md", "semantic_rule"), "d.docx": ("docx", "data")}
    assert [tuple(r) for r in S.read_table(spark, f"{tmp_path}/a.csv").collect()] == [("1", "two\nlines"), ("3", ""), ("4", "5")]
    assert S.json_profile(S.read_table(spark, f"{tmp_path}/sub/r.json")).columns == ["k"]
    assert S.read_documents(spark, f"{tmp_path}/d.docx").first()["text"] == "Hello\na | b"
    assert S.rule_text(S.read_texts(spark, str(tmp_path / "*.md"))).first()["rules"] == "creatinine above 1.2"
    assert S.resolve(str(tmp_path), "a.csv").endswith("a.csv")
    with pytest.raises(ValueError):
        S.resolve(str(tmp_path), "../x")
    with pytest.raises(FileNotFoundError):
        S.resolve(str(tmp_path), "b.csv")


def test_tasks(spark, tmp_path):
    for i in (10, 2):
        (tmp_path / f"task_{i}").mkdir()
        (tmp_path / f"task_{i}" / "task.json").write_text(json.dumps({"task_id": f"task_{i}", "difficulty": "Easy", "question": "How many?"}))
    assert [r["task_id"] for r in S.tasks(spark, str(tmp_path)).collect()] == ["task_2", "task_10"]
    assert S.tasks(spark, str(tmp_path), ids=["task_2"], difficulties=["easy"]).count() == 1
    (tmp_path / "task_2" / "task.json").write_text(json.dumps({"task_id": "task_2", "question": "?"}))
    with pytest.raises(Exception, match="not a task"):
        S.tasks(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,1", 'q"x')], "x string, y string")
    K.write_answer(df, str(tmp_path / "a"))
    assert [tuple(r) for r in S.read_delimited(spark, str(tmp_path / "a")).collect()] == [("a,1", 'q"x')]
    with pytest.raises(ValueError):
        K.check_answer(df.select())
    assert K.to_table(spark, 5).collect()[0]["value"] == "5" and K.to_table(spark, [{"a": 1}]).columns == ["a"]
    assert K.synthesised_name("x/Patient.md") == "x__Patient.synth.csv"
    calls = []

    def compute(d):
        calls.append(d.count())
        return d.withColumn("r", F.length("k"))

    for keys in (["a", "bb"], ["bb", "ccc"]):
        out = K.cached(spark, spark.createDataFrame([(k,) for k in keys], "k string"), str(tmp_path / "cache"), "k", compute)
        assert {r["k"]: r["r"] for r in out.collect()} == {k: len(k) for k in keys}
    assert calls == [2, 1]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER, v REAL, s TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2, f"é{i}") for i in range(50)] + [(None, "not a number", None)])
    t = read_sqlite(spark, path, "t")
    assert t.count() == 51 and t.where("id >= 48").select("s").collect() == [("é48",), ("é49",)]
    assert t.where("id is null").first()["v"] is None
    assert sqlite_catalog(spark, path).count() == 3
    assert register_tables(spark, path) == ["t"] and spark.sql("select max(id) m from t").first()["m"] == 49


def test_planning(spark):
    assert G.topological_layers({"b": ["a"], "a": [], "c": ["zz"]}) == [["a", "c"], ["b"]]
    with pytest.raises(ValueError):
        G.topological_layers({"a": ["b"], "b": ["a"]})
    assert G.blocked({"b": ["a"], "c": ["zz"], "d": []}, ["a"]) == ["c"]
    b = G.Budget({"tool": 1})
    b.spend("tool")
    with pytest.raises(G.BudgetExceeded):
        b.spend("tool")
    with pytest.raises(G.BudgetExceeded):
        G.Budget({"tool": 5}, seconds=-1).spend("tool")
    q = spark.createDataFrame([("Is it more than 5?",), ("How many patients per year whose age is highest?",), ("Show them",)], "q string")
    got = [(r["s"], r["o"]) for r in q.select(G.answer_shape(F.col("q")).alias("s"), G.operations(F.col("q"), F.lit(False), F.lit(True), F.lit(False)).alias("o")).collect()]
    assert got == [("boolean", ["compare", "compute"]), ("scalar", ["filter", "join", "groupby", "aggregate", "sort", "topk"]), ("table", ["filter"])]


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    events = spark.createDataFrame([(i, 1_700_000_000 + 3600 * i, i % 3, "ab"[i % 2], 1.0) for i in range(60)], "event_id long, s long, user_id int, event_type string, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    events.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in E.tumbling_counts(events).collect()}
    stream = E.tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == batch
    assert E.sessions(events).count() == 60 and E.first_by_id(events.union(events)).count() == 60
