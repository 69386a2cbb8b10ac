"""Joins, merging, sampling and specifications on literals with nulls, ties and odd names."""

import random

import pytest
from pyspark.sql import functions as F

from tablesense.operators import relational as R
from tablesense.plans import checks as C
from tablesense.plans.spec import Filter, Join, Measure, QuerySpec, compile_spec


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_suffixes_and_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, v string")
    m = R.merge(a, b, on=["k"])
    assert m.columns == ["k", "v_x", "v_y"] and got(m) == [(1, "a", "x"), (None, "b", "y")]
    assert got(R.merge(a, b, on=["k"], null_safe=False)) == [(1, "a", "x")]
    assert got(R.merge(a, b, on=["k"], how="outer")) == [(1, "a", "x"), (2, None, "z"), (None, "b", "y")]
    two = R.merge(a, b.withColumnRenamed("k", "k2"), left_on=["k"], right_on=["k2"], suffixes=("_l", "_r"))
    assert two.columns == ["k", "v_l", "k2", "v_r"]
    with pytest.raises(ValueError):
        R.merge(a, b)


def test_merge_normalises_ids(spark):
    a = spark.createDataFrame([("163109.0",), (" 7",)], "id string")
    b = spark.createDataFrame([(163109, "x"), (7, "y")], "key int, v string")
    assert got(R.merge(a, b, left_on=["id"], right_on=["key"], normalise_keys=True)) == [(" 7", 7, "y"), ("163109.0", 163109, "x")]


def test_first_last_and_merged_records(spark):
    df = spark.createDataFrame([(1, 0, "a", None), (1, 1, None, "p"), (2, 2, "c", None), (None, 3, "d", "q"), (1, 4, None, None)], "k int, pos int, x string, y string")
    assert got(R.first_per_key(df.where("k is not null"), ["k"], ["pos"])) == [(1, 0, "a", None), (2, 2, "c", None)]
    assert got(R.last_record(df, "k", "pos")) == [(1, 4, None, None), (2, 2, "c", None)]
    assert got(R.last_values(df, "k", "pos")) == [(1, "a", "p"), (2, "c", None)]
    assert got(R.merged_records(df, "k", "pos")) == [(1, 4, None, None, 0), (2, 2, "c", None, 2)]


@pytest.mark.parametrize(("n", "size"), [(0, 3), (1, 3), (3, 3), (10, 3), (10, 4), (7, 1), (100, 6)])
def test_spread_places(n, size):
    places = R.spread_places(n, size)
    assert len(places) <= size and places == sorted(set(places)) and all(0 <= p < n for p in places)
    assert n <= size and places == list(range(n)) or n > size and (size < 2 or {0, n - 1} <= set(places))


def test_ranked_and_sample_over_many_partitions(spark):
    values = list(range(0, 3000, 3))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert got(R.ranked(df, "v").select("v", "pos")) == sorted(((v, v // 3) for v in values), key=str)
    assert sorted(r["v"] for r in R.diverse_sample(df, 5, "v").collect()) == [3 * p for p in R.spread_places(1000, 5)]


def test_limited_flags(spark):
    df = spark.range(5).select(F.col("id").alias("i"))
    for n, more in ((4, True), (5, False), (9, False)):
        rows, flag = R.limited(df, n, ["i"])
        assert rows.count() == min(n, 5) and flag.first()["truncated"] == more


def test_empty_columns_ragged_rows_and_thresholds(spark):
    df = spark.createDataFrame([("", None, "x"), (" n/a ", "NULL", None)], "a string, b string, c string")
    assert R.drop_empty_columns(df).columns == ["c"]
    assert R.drop_empty_columns(df.select("a", "b")).columns == ["a"]
    rows = spark.createDataFrame([(["1"],), (["1", "2", "3"],), ([],)], "c array<string>")
    assert got(rows.select(R.rectangular(F.col("c"), 2).alias("r"))) == [(["", ""],), (["1", ""],), (["1", "2"],)]
    values = spark.createDataFrame([(1.3,), (1.2,), (None,)], "creatinine double")
    rules = spark.createDataFrame([("It is normal.\nCreatinine values above 1.2 are abnormal",)], "t string")
    assert got(R.above_threshold(values, "creatinine", rules, "t")) == [(1.3,)]
    assert got(R.above_threshold(values, "creatinine", rules.limit(0), "t")) == []


def sources(spark):
    return {
        "results": spark.createDataFrame([("1", "10", "5"), ("2", "10", "7"), ("1", "11", "9")], "driverId string, raceId string, points string"),
        "races": spark.createDataFrame([(10, 2020), (11, 2021)], "raceId int, year int"),
    }


def test_spec_compiles_to_one_plan(spark):
    spec = QuerySpec("results", joins=(Join("races", ("raceId",), ("raceId",)),), filters=(Filter("year", "=", 2020),), derived={"p": "cast(points as int)"}, groups=("driverId",), measures=(Measure("total", "sum", "p"), Measure("n", "count")), order=(("total", True),), limit=1)
    assert got(compile_spec(spec, sources(spark))) == [("2", 7, 1)]


def test_checks_name_the_fault_and_repairs_mend_it(spark):
    have = sources(spark)
    wrong = QuerySpec("result", joins=(Join("races", ("race_id",), ("raceId",)),), columns=("Driver ID", "year"))
    spec, met = C.repaired(wrong, have)
    assert [i.code for i in met] == ["no_such_table", "bad_join_key", "no_such_column"]
    assert not C.check(spec, have) and spec.columns == ("driverId", "year")
    assert C.check(QuerySpec("results", columns=("nothing",)), have)[0].code == "no_such_column"
    assert C.repair_column(wrong, have, C.Issue("no_such_column", "", "zzz")) is None


def test_empty_results_are_tried_loosely(spark):
    have = {"t": spark.createDataFrame([("Yes", "7.0"), ("no", "8.0")], "flag string, id string")}
    assert got(C.run_spec(QuerySpec("t", filters=(Filter("flag", "=", "yes"), Filter("id", "=", 7))), have)) == [("Yes", "7.0")]


WRITES = [
    "drop table x",
    "insert into x values (1)",
    "with a as (select 1) insert into x select * from a",
    "from (select 1 as i) insert into x select i",
    "with a as (select 1) from a insert into x select * insert into y select *",
    "set a=b",
    "create table y as select 1",
    "explain select 1",
    "refresh table x",
    "cache table x",
    "delete from x",
    "select reflect('java.lang.System', 'exit', '1')",
    "select * from (select `java_method` ('java.lang.System', 'gc'))",
    "use other",
]


@pytest.mark.parametrize("bad", WRITES)
def test_sql_is_read_only(spark, bad):
    with pytest.raises(ValueError):
        C.read_only_sql(spark, bad)


def test_a_write_behind_a_with_is_not_run(spark):
    spark.sql("CREATE TABLE kept (i INT) USING parquet")
    with pytest.raises(ValueError):
        C.read_only_sql(spark, "WITH a AS (SELECT 1 AS i) INSERT INTO kept SELECT * FROM a")
    assert spark.table("kept").count() == 0
    spark.sql("DROP TABLE kept")


@pytest.mark.parametrize(
    "good",
    [
        "select id from range(10)",
        "with a as (select id from range(10)) select * from a where id in (select max(id) from a) or exists (select 1)",
        "-- a comment\n(select 'drop table x' as s) union all values ('y'), ('reflect(')",
        "select x, count(*) over (partition by x) from (select explode(array(1, 2)) as x) where x between 1 and 2 group by x having x > 0 order by 1 limit 3",
        "select * from values (1, 'a'), (2, 'b') t(k, v) pivot (max(v) for k in (1, 2))",
        "show tables",
        "from range(3) select id",
    ],
)
def test_queries_of_all_kinds_are_run(spark, good):
    rows, flag = C.read_only_sql(spark, good, 3)
    assert rows.count() <= 3 and flag.count() == 1


def test_statements_that_do_not_parse_and_many_at_once(spark):
    from pyspark.errors import ParseException

    for bad in ("select 1; drop table x", "selec 1", ""):
        with pytest.raises(ParseException):
            C.read_only_sql(spark, bad)


def test_errors_become_issues(spark):
    for sql, code in (("select a from range(1)", "no_such_column"), ("select * from nowhere", "no_such_table"), ("select a b c from range(1)", "sql_syntax")):
        with pytest.raises(Exception) as caught:  # noqa: PT011
            spark.sql(sql).schema  # noqa: B018
        assert C.issue_of(caught.value).code == code
    assert C.issue_of(KeyError("k")).code == "no_such_column"
    assert C.issue_of(FileNotFoundError("f")).code == "no_such_file"


def test_merge_of_many_with_many_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 500)
    a = spark.createDataFrame([(i, None if i % 9 == 0 else i % 3, f"a{i}") for i in range(90)], "i int, k int, v string")
    b = spark.createDataFrame([(i, None if i % 10 == 0 else i % 4, f"b{i}") for i in range(400)], "j int, k long, v string").coalesce(1)
    for null_safe in (True, False):
        plain, dealt = (R.merge(a, b, on=["k"], null_safe=null_safe, many=many) for many in (False, True))
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect())) and dealt.columns == plain.columns
        tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) < sum(tasks) / 4
    monkeypatch.setattr(R, "PAIRS", 10**9)
    assert R.merge(a, b, on=["k"], many=True).count() == R.merge(a, b, on=["k"]).count()


def test_frequent_pairs_meet_in_hash_tables_and_rare_ones_apart(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 400)
    a = spark.createDataFrame([(i, 1 if i < 60 else i, "a") for i in range(90)], "i int, k int, v string")
    b = spark.createDataFrame([(i, 1 if i < 50 else i, "b") for i in range(90)], "j int, k int, v string")
    dealt = R.merge(a, b, on=["k"], many=True)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, R.merge(a, b, on=["k"]).collect())) and dealt.count() == 60 * 50 + 30
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=shuffle_hash") == 1 and "LeftAnti" in plan
