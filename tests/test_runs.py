import json

import pytest

from tablesense.operators import answers as A
from tablesense.plans.checks import tables_of, with_overrides
from tablesense.plans.routing import BudgetExceeded
from tablesense.plans.runtime import Events, Report, Settings, Tools, read_settings, retried, settings
from tablesense.plans.spec import Filter, QuerySpec
from tablesense.sources.runs import score_folder, task_names, write_score_summary


def _df(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(names)))).toDF(*names)


def _rows(df):
    return df.columns, sorted(tuple(r) for r in df.collect())


def test_votes_project_the_answer(spark):
    one = _df(spark, [("a", "1", "x"), ("b", "2", "y")], ["n", "k", "n"])
    two = _df(spark, [("2", "B"), ("1", "A")], ["p", "q"])
    three = _df(spark, [("b", "2.0", "u"), ("a", "1", "v")], ["n", "k", "z"])
    answer, chosen = A.voted_answer([one, two, three])
    assert chosen == 1 and _rows(answer) == (["p", "q"], [("1", "A"), ("2", "B")])
    answer, chosen = A.voted_answer([one, three])
    assert chosen == 0 and _rows(answer) == (["n", "k"], [("a", "1"), ("b", "2")])


def test_votes_without_winners_and_without_samples(spark):
    one, two = _df(spark, [("a", "a")], ["n", "m"]), _df(spark, [("b",)], ["n"])
    answer, chosen = A.voted_answer([one, two])
    assert chosen == 0 and _rows(answer) == (["n", "m"], [("a", "a")])
    assert A.voted_answer([]) == (None, None)


def test_best_sample_counts_equal_columns_once(spark):
    sigs = spark.createDataFrame([(0, 0, "a"), (0, 1, "x"), (0, 2, "y"), (1, 0, "a"), (1, 1, "z"), (1, 2, "z"), (1, 3, "z")], "sample_id int, col_idx int, signature string")
    assert tuple(A.best_sample(sigs, spark.createDataFrame([("a",)], "signature string")).first()) == (1, 1, 1)


def test_intersection_keeps_what_is_agreed_or_all(spark):
    one = _df(spark, [("a", "1"), ("b", "2")], ["n", "k"])
    assert _rows(A.intersected_answer(one, [_df(spark, [("2",), ("1",)], ["p"])])) == (["k"], [("1",), ("2",)])
    assert _rows(A.intersected_answer(one, [_df(spark, [("7",)], ["p"])])) == _rows(one)
    assert _rows(A.intersected_answer(one, [], agreement=1)) == _rows(one)


def test_columns_without_rows_are_equal(spark):
    empty, full = _df(spark, [], ["a", "b"]), _df(spark, [("1", "2")], ["a", "b"])
    assert A.score_table(empty, empty).first()["matched"] == 2
    assert A.score_table(empty, full).first()["matched"] == 0


def test_stamp_fails_broken_answers(spark):
    good = _df(spark, [("a",)], ["n"])
    assert A.stamped(good, True) == (True, None, [])
    assert A.stamped(None, True) == (False, "invalid_answer: missing_answer", ["missing_answer"])
    assert A.stamped([1], True, "late") == (False, "late | invalid_answer: invalid_answer_type", ["invalid_answer_type"])
    assert A.stamped(good.limit(0), True)[2] == ["no_rows"]
    assert A.stamped(None, False, "late")[:2] == (False, "late")


def test_runs_are_scored_by_folder(spark, tmp_path):
    run, gold = tmp_path / "run", tmp_path / "gold"
    files = {
        "task_1": ("a,b\n1,x\n2,y\n", "q,p\nX,2.0\nY,1\n"),
        "task_10": ("a\n1\n", None),
        "task_2": (None, "a\n1\n"),
        "task_3": ("a,b\n", "a\n"),
        "task_4": ('a\n"u\nv"\n', '﻿a,c\n"u\nv",1\n'),
        "other": ("a\n1\n", "a\n1\n"),
    }
    for name, (g, p) in files.items():
        for root, file, text in ((gold, "gold.csv", g), (run, "prediction.csv", p)):
            (root / name).mkdir(parents=True, exist_ok=True)
            if text is not None:
                (root / name / file).write_text(text, encoding="utf-8")
    assert task_names(spark, str(run)) == ["task_1", "task_10", "task_2", "task_3", "task_4"]
    scores = score_folder(spark, str(run), str(gold))
    got = {r["task_id"]: (r["error"], r["gold_columns"], r["pred_columns"], r["matched"], r["score"]) for r in scores.collect()}
    assert got == {
        "task_1": (None, 2, 2, 2, 1.0),
        "task_10": ("missing_prediction", 1, 0, 0, 0.0),
        "task_2": ("missing_gold", 0, 1, 0, 0.0),
        "task_3": (None, 2, 1, 1, 0.5),
        "task_4": (None, 1, 2, 1, 0.75),
    }
    write_score_summary(spark, scores, str(run))
    summary = json.loads((run / "score_summary.json").read_text())
    assert (summary["tasks"], summary["scored"], summary["mean_score"]) == (5, 3, 0.45)
    assert [t["task_id"] for t in summary["per_task"]] == ["task_1", "task_10", "task_2", "task_3", "task_4"]
    assert score_folder(spark, str(tmp_path / "none"), str(gold)).count() == 0


def test_tables_of_a_statement(spark):
    sql = "WITH c AS (SELECT * FROM main.Orders) SELECT * FROM c JOIN `Part` p ON c.k = p.k WHERE k IN (SELECT k FROM nation) AND t <> 'FROM x'"
    assert tables_of(spark, sql) == ["nation", "orders", "part"]


def test_overrides_change_or_add_filters():
    spec = QuerySpec("t", filters=(Filter("a", "=", 1), Filter("b", ">", 2)))
    changed = with_overrides(spec, [{"field": "a", "new_value": 5}, {"concept": "Size", "value": 9}, {"field": "c", "value": 3, "operator": ">="}, {"field": "d"}], {"size": "b"})
    assert changed.filters == (Filter("a", "=", 5), Filter("b", ">", 9), Filter("c", ">=", 3))


def test_settings_are_coerced(tmp_path):
    got = settings({"scoring": {"tolerance": "0.5"}, "retrieval": {"dense": "Yes", "first": "7"}, "voting": None})
    assert got.scoring.tolerance == 0.5 and got.retrieval.dense is True and got.retrieval.first == 7 and got.voting == Settings().voting
    with pytest.raises(ValueError, match="speed"):
        settings({"speed": 1})
    with pytest.raises(ValueError, match="neither"):
        settings({"retrieval": {"dense": "perhaps"}})
    (tmp_path / "s.json").write_text('{"voting": {"least": 3}}')
    assert read_settings(str(tmp_path / "s.json")).voting.least == 3


def test_tools_have_limits():
    tools = Tools({"read": lambda n: n, "list": lambda: []}, {"read": 2})
    worker = tools.subset(["read"])
    assert worker.call("read", n=1) == 1 and tools.call("read", n=2) == 2
    with pytest.raises(BudgetExceeded):
        worker.call("read", n=3)
    with pytest.raises(KeyError):
        worker.call("list")


def test_calls_are_retried():
    class Busy(Exception):
        status = 429

    class Wrong(Exception):
        status = 400

    fails, slept = [Busy(), ConnectionError()], []

    def call():
        if fails:
            raise fails.pop(0)
        return "done"

    assert retried(call, sleep=slept.append, draw=lambda: 1.0) == "done" and slept == [0.5, 1.0]
    fails[:] = [Wrong()]
    with pytest.raises(Wrong):
        retried(call, sleep=slept.append)
    fails[:] = [Busy()] * 4
    with pytest.raises(Busy):
        retried(call, attempts=2, sleep=lambda s: None)


def test_reports_and_events(spark):
    assert Report("done").table(spark) is None
    assert _rows(Report("done", ("a", "a"), ((1, None),)).table(spark)) == (["a", "a"], [("1", None)])
    for bad in (lambda: Report(" "), lambda: Report("x", (), ((1,),)), lambda: Report("x", ("a",), ((1, 2),))):
        with pytest.raises(ValueError):
            bad()
    lines, times = [], iter([1.0, 3.5])
    Events(lines.append, "zh", lambda: next(times)).emit("score", value=0.5)
    assert json.loads(lines[0]) == {"at": 2.5, "kind": "score", "title": "得分", "value": 0.5}
