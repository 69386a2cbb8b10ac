"""The four modes of rendering a task's context, and their budgets."""

import pytest
from pyspark.sql import functions as F

from tablesense.operators import render
from tablesense.operators.task_profile import task_profiles


@pytest.fixture(scope="module")
def context(spark):
    tasks = spark.createDataFrame([("t1", "easy", "Which harbour has the highest tax?"), ("t2", "easy", "Why?")], "task_id string, difficulty string, question string")
    ships = spark.createDataFrame([(i, ("red", "blue")[i % 2], i * 1.5) for i in range(9)], "id int, colour string, tons double")
    files = [("t1", "ships.csv", "csv", 90), ("t1", "notes.md", "md", 300), ("t1", "knowledge.md", "md", 20), ("t2", "pic.png", "png", 5)]
    profiles = task_profiles(tasks, {("t1", "ships.csv"): (ships, "id")}, spark.createDataFrame(files, "task_id string, source string, kind string, length long"))
    notes = "# One\nnothing here\n# Two\n" + "long text " * 100 + "\n# Three\nthe harbour and its tax\n# Four\nlast"
    texts = spark.createDataFrame([("t1", "notes.md", notes), ("t1", "knowledge.md", "tax is paid in a harbour")], "task_id string, source string, text string")
    return profiles, texts


def shown(context, mode, **more):
    return {r["task_id"]: r["text"] for r in render.render_context(*context, mode, **more).collect()}


def test_schema_mode_has_no_samples(spark, context):
    text = shown(context, "schema")
    assert text["t1"].startswith("## ships.csv\n(csv, 90 bytes)\n9 rows\n- id (int, 9 different)\n- colour (str, 2 different)\n- tons (float, 9 different)\n")
    assert "red" not in text["t1"] and text["t1"].index("knowledge.md") < text["t1"].index("notes.md")
    assert "(md, rules, 20 bytes)" in text["t1"] and "### Two\n" + ("long text " * 100)[:400] + "…" in text["t1"] and "Three" not in text["t1"]
    assert text["t2"] == "## pic.png\n(png, 5 bytes)\n"


def test_samples_mode(spark, context):
    text = shown(context, "samples")["t1"]
    assert "- colour (str, 2 different): red | blue" in text and "- id (int, 9 different): 0 | 1 | 2 | 3 | 4\n" in text


def test_focused_mode_shows_what_is_asked_about(spark, context):
    text = shown(context, "focused")["t1"]
    assert "### Three\nthe harbour and its tax" in text and "### One" not in text and "### (top)\ntax is paid in a harbour" in text


def test_retrieved_mode_shows_passages(spark, context):
    passages = spark.createDataFrame([("t1", 1, "first passage"), ("t1", 2, "x" * 5900), ("t1", 3, "y" * 200)], "task_id string, rank int, text string")
    text = shown(context, "retrieved", passages=passages)
    assert text["t1"].endswith("## retrieved passages\nfirst passage\n" + "x" * 5900 + "\n") and "###" not in text["t1"] and "passages" not in text["t2"]
    assert len(text["t1"]) <= render.MODES["retrieved"].budget + 40


def test_budgets_hold(spark, context, monkeypatch):
    monkeypatch.setitem(render.MODES, "schema", render.Mode(240, 0, 2, 400))
    text = shown(context, "schema")["t1"]
    assert len(text) <= 240 and "## notes.md\n_(omitted to stay within budget)_" in text
    assert render.render_context(context[0].where(F.lit(False)), context[1], "schema").count() == 0
