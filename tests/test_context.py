"""Contexts: budgets, schemas, replies and routes."""

import pytest

from tablesense.operators import context as X


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('```json\n{"a": 1}\n```', '{"a":1}'),
        ('Sure! {"a": [1, 2', '{"a":[1,2]}'),
        ('{"a": "x\ny", "b": {"c": "open', '{"a":"x\\ny","b":{"c":"open"}}'),
        ('{"a": 1} and more {', '{"a":1}'),
        ("[1, 2] tail", "[1,2]"),
        ("no json", None),
        ('{"a": 1]', None),
        ("", None),
        (None, None),
    ],
)
def test_repaired_json(reply, want):
    assert X.repaired_json(reply) == want


def test_blocks_give_way_to_stubs_and_later_ones_fit(spark):
    rows = [("d", 1, "a" * 50, "one"), ("d", 2, "b" * 500, "two"), ("d", 3, "c" * 20, "three")]
    df = spark.createDataFrame(rows, "k string, pos long, t string, name string")
    text = X.rendered(df, "k", "pos", "t", "name", 120).first()["text"]
    assert text == "a" * 50 + "## two\n_(omitted to stay within budget)_\n" + "c" * 20


def test_routes_and_memo():
    with pytest.raises(ValueError):
        X.route("document_qa", {"a": {"kind": "react"}}, visited=["a"])
    assert X.route("document_qa", {"a": {"kind": "react"}}) == ("a", "first_available")
    memo, calls = X.Memo(), []
    tool = lambda **k: calls.append(k) or len(calls)
    assert [memo.call("t", tool, a=1, b=2), memo.call("t", tool, b=2, a=1), memo.call("t", tool, a=2)] == [1, 1, 2] and memo.hits == 1
    assert X.rate_per_minute(0, 5) == 0.0 and X.rate_per_minute(3, 60) == 3.0
