"""Tokens, types, signatures, matching, votes, profiles and links, with property checks of the closed forms."""

import collections

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesense.functions import cells, names, text
from tablesense.operators import answers as A
from tablesense.operators import linking as L
from tablesense.operators import profile as P

TYPES = {"": "empty", "  ": "empty", "Yes": "bool", "f": "bool", "y": "str", "+5": "int", "1_000": "int", " 7 ": "int", "1d": "str", "1e5": "float", ".5": "float", "5.": "float", "nan": "float", "-inf": "float", "1__0": "str", "2020-01-02T03": "date", "2020-1-2": "str", "1/2/20": "date", "1/2/2020 x": "str", "x": "str"}


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_cell_types(spark):
    got = {r["v"]: r["t"] for r in spark.createDataFrame([(v,) for v in TYPES], "v string").select("v", cells.cell_dtype(F.col("v")).alias("t")).collect()}
    assert got == TYPES


@pytest.mark.parametrize(("value", "kind", "want"), [("14.0", "string", "14"), (14.0, "double", "14"), (14, "int", "14"), (" AbC", "string", "abc"), ("", "string", None), (None, "string", None), ("1_0", "string", "10"), ("nan", "string", "nan"), ("12345678901234567890123", "string", "12345678901234567890123")])
def test_join_key(spark, value, kind, want):
    assert one(spark, value, kind, cells.join_key) == want


def test_match_tokens_agree(spark):
    groups = [["1.0", "1", " 1.00 ", "1.004"], ["", "  ", None], ["nan", "NaN "], ["Ab", " ab"], ["0.125", "0.12"], ["0.135", "0.14"], ["-0.001", "0"]]
    rows = [(i, v) for i, g in enumerate(groups) for v in g]
    got = collections.defaultdict(set)
    for r in spark.createDataFrame(rows, "g int, v string").select("g", cells.match_token(F.col("v")).alias("t")).collect():
        got[r["g"]].add(r["t"])
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(groups)


@pytest.mark.parametrize(("value", "want"), [(1.0, "1"), ("2.50", "2.5"), (True, "true"), (None, "__EMPTY__"), ("", "__EMPTY__"), (float("nan"), "__EMPTY__"), ("nan", "nan"), (" X ", "x"), (0.1 + 0.2, "0.3"), ("1e3", "1000")])
def test_shown_tokens(value, want):
    assert cells.show_token(value) == want


def table(spark, columns):
    rows = list(zip(*columns)) if columns else []
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} string" for i in range(len(columns))))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_matching_is_a_largest_one(spark, data):
    column = st.lists(st.sampled_from(["1", "1.0", "a", "", "B"]), min_size=3, max_size=3)
    gold, pred = data.draw(st.lists(column, min_size=1, max_size=4)), data.draw(st.lists(column, min_size=1, max_size=4))
    norm = lambda c: tuple(sorted({"1.0": "1", "B": "b"}.get(v, v) for v in c))
    g, p = collections.Counter(map(norm, gold)), collections.Counter(map(norm, pred))
    pairs = A.match_columns(table(spark, gold), table(spark, pred)).collect()
    assert len(pairs) == sum((g & p).values())
    assert len({r["gold_idx"] for r in pairs}) == len({r["pred_idx"] for r in pairs}) == len(pairs)
    assert all(norm(gold[r["gold_idx"]]) == norm(pred[r["pred_idx"]]) for r in pairs)


def test_score_and_strict(spark):
    gold = table(spark, [["1", "2"], ["x", "y"]])
    same = table(spark, [["Y", "X"], ["2.0", "1.0"]])
    assert A.score_table(gold, same).first()["score"] == 1.0 and A.strict_match(gold, same).first()["correct"]
    extra = table(spark, [["1", "2"], ["q", "q"], ["r", "r"]])
    r = A.score_table(gold, extra).first()
    assert (r["matched"], r["recall"], r["score"]) == (1, 0.5, round(0.5 - 0.5 * 2 / 3, 6))
    assert not A.strict_match(gold, extra).first()["correct"]


def test_validation(spark):
    df = spark.createDataFrame([("1", "n/a", "x"), ("2", None, "5")], "a string, b string, c string").toDF("a", "a", "c")
    assert sorted(tuple(r) for r in A.validation_issues(df).collect()) == [("empty_column", "error", 1), ("mixed_types", "warning", 2)]
    assert [r["code"] for r in A.validation_issues(df.limit(0)).collect()] == ["no_rows"]
    assert [r["code"] for r in A.validation_issues(df.select()).collect()] == ["no_columns"]


def test_votes(spark):
    a, b, c = [["1", "2"], ["x", "y"]], [["y", "x"], ["2", "1"], ["z", "z"]], [["q", "q"]]
    sigs = A.sample_signatures([table(spark, t) for t in (a, b, c)])
    assert A.modal_width(sigs).first()["width"] == 3
    winners = A.vote_winners(sigs)
    assert sorted(r["votes"] for r in winners.collect()) == [2, 2]
    assert tuple(A.best_sample(sigs, winners).first()) == (0, 2, 0)
    assert sorted(r["col_idx"] for r in A.agreed_columns(sigs.where("sample_id = 1"), sigs.where("sample_id <> 1")).collect()) == [0, 1]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "1", "2", "", None]), min_size=1, max_size=25), st.integers(1, 4))
def test_profiles_follow_first_appearance(spark, values, cap):
    df = spark.createDataFrame(list(enumerate(values)), "pos int, v string")
    freq = P.value_frequencies(P.long_form(df, ["v"], "pos"), cap)
    seen: dict = {}
    for v in (v or "" for v in values):
        if v in seen or len(seen) < cap:
            seen[v] = seen.get(v, 0) + 1
    assert {r["value"]: r["cnt"] for r in freq.collect()} == seen
    top = sorted(P.top_values(freq, 2).collect(), key=lambda r: r["rank"])
    assert [r["value"] for r in top] == sorted(seen, key=lambda v: -seen[v])[:2]


def test_profile_rows(spark):
    r = P.profile(spark.createDataFrame([(0, "1"), (1, "x"), (2, "2"), (3, "1")], "pos int, v string"), "t", ["v"], "pos").first()
    assert (r["dtype"], r["cardinality"], r["samples"]) == ("int", 3, ["1", "x", "2"])


def test_links_and_bindings(spark):
    catalog = spark.createDataFrame([("a", "EventID", 3, ["1", "2.0"]), ("b", "event-id", 3, ["1", "2"]), ("c", "link_to_event", 2, ["z"]), ("d", "city", 2, ["Paris", "Rome"])], "source string, col_name string, cardinality long, samples array<string>")
    assert [tuple(r) for r in L.links_by_value(catalog).collect()] == [("a", "EventID", "b", "event-id", 1.0)]
    reasons = {(r["left_source"], r["right_source"]): r["reason"] for r in L.links_by_name(catalog).collect()}
    assert reasons == {("a", "b"): "same_normalized_name", ("a", "c"): "link_to_foreign_key", ("b", "c"): "link_to_foreign_key"}
    best = L.bind_concepts(spark.createDataFrame([("rome",), ("city",)], "concept string"), catalog).where("rank = 1").collect()
    assert {r["concept"]: (r["col_name"], r["score"]) for r in best} == {"rome": ("city", 0.95), "city": ("city", 1.0)}


def test_fuzzy_names():
    assert names.close_names("custmer", ["customer", "order"])[0] == "customer"
    assert names.name_ratio("Driver_ID", "driverid") == 1.0


def test_tokens_and_sentences(spark):
    row = spark.createDataFrame([("The GOT was 1.5 U/L. Café x_1 中文! No more",)], "t string")
    r = row.select(text.index_tokens(F.col("t")).alias("k"), text.sentences(F.col("t")).alias("s"), text.question_concepts(F.col("t")).alias("q"), text.last_match(F.col("t"), r"(\d+)").alias("m"), text.last_match(F.col("t"), "(zz)").alias("n")).first()
    assert r["k"] == ["got", "caf", "x_1", "no", "more", "中", "文"]
    assert r["s"] == ["The GOT was 1.5 U/L", "Café x_1 中文! No more"]
    assert r["q"] == ["got", "caf", "x_1"] and (r["m"], r["n"]) == ("1", None)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([], [1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [r["c"] for r in df.select(text.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
