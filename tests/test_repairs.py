"""Joins that are mended or left out, and answers without empty columns."""

import pytest

from tablesense.plans.checks import check, mended_answer, repaired, run_spec
from tablesense.plans.spec import Filter, Join, QuerySpec


@pytest.fixture
def sources(spark):
    return {
        "results": spark.createDataFrame([(1, 10, 5.0), (2, 20, 3.0)], "driver int, RaceID int, points double"),
        "races": spark.createDataFrame([(10, 2020), (20, 2021)], "race_id int, year int"),
        "events": spark.createDataFrame([(1, 7), (2, 8)], "event int, link_to_race int"),
    }


def test_the_one_pair_of_names_is_the_key(sources):
    spec = QuerySpec("results", joins=(Join("races", ("raceKey",), ("id",)),), columns=("driver", "year"))
    fixed, met = repaired(spec, sources)
    assert fixed.joins[0].left_on == ("RaceID",) and fixed.joins[0].right_on == ("race_id",) and [i.code for i in met] == ["bad_join_key"]
    assert sorted(map(tuple, run_spec(spec, sources).collect())) == [(1, 2020), (2, 2021)]


def test_a_link_is_an_id(sources):
    fixed, _ = repaired(QuerySpec("events", joins=(Join("races", ("nothing",), ("race_id",)),)), sources)
    assert (fixed.joins[0].left_on, fixed.joins[0].right_on) == (("link_to_race",), ("race_id",)) and not check(fixed, sources)


def test_two_pairs_are_not_guessed(spark, sources):
    more = sources | {"races": spark.createDataFrame([(10, 2020, 1)], "race_id int, year int, Driver int")}
    fixed, met = repaired(QuerySpec("results", joins=(Join("races", ("x",), ("y",)),)), more)
    assert check(fixed, more) and met[-1].code == "bad_join_key"


def test_unknown_joins_go_if_nothing_needs_them(sources):
    spec = QuerySpec("results", joins=(Join("weather_of_1970", ("driver",), ("driver",)),), filters=(Filter("points", ">", 4),), columns=("driver",))
    assert [tuple(r) for r in run_spec(spec, sources).collect()] == [(1,)]
    needed = QuerySpec("results", joins=spec.joins, columns=("driver", "sunshine"))
    assert [i.code for i in check(repaired(needed, sources)[0], sources)] == ["no_such_table"]


def test_answers_are_mended(spark):
    answer, left = mended_answer(spark.createDataFrame([("1", "", "n/a"), ("2", None, "NULL")], "a string, b string, c string"))
    assert answer.columns == ["a"] and left == []
    only, left = mended_answer(spark.createDataFrame([("",)], "a string"))
    assert only.columns == ["a"] and left == ["empty_column"]
    none, left = mended_answer(spark.createDataFrame([], "a string"))
    assert left == ["no_rows"] and none.columns == ["a"]
