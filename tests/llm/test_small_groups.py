"""Documents of rare languages, and of small tables, are judged by distance too."""

import numpy as np
import pytest

from tablesense.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(good, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    plain = lambda: " ".join(rng.choice(vocabulary, rng.integers(60, 600)))
    junk = lambda: " ".join(f"{w}##$$%%" for w in rng.choice(vocabulary, 200))
    return [plain() for _ in range(good)], junk, plain


def judged(spark, rows):
    return {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rare_languages_are_judged_by_the_whole_table(spark):
    good, junk, plain = corpus(500)
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(good)]
    rows += [(1000, junk(), "xx", "s0"), (1001, plain(), "xx", "s0"), (1002, junk(), "en", "rare"), (1003, plain(), "en", "rare")]
    got = judged(spark, rows)
    assert all(r["distance"] is not None for r in got.values())
    assert {k: got[k]["kept"] for k in range(1000, 1004)} == {1000: False, 1001: True, 1002: False, 1003: True}
    assert all(got[i]["kept"] for i in range(500))


@pytest.mark.parametrize("n", [1, 12, 40, 150])
def test_small_tables_are_judged(spark, n):
    good, junk, _ = corpus(n)
    got = judged(spark, [(i, t, "en", "s") for i, t in enumerate(good)] + [(1000, junk(), "en", "s")] * (n > 1))
    assert all(r["distance"] is not None for r in got.values()) and all(got[i]["kept"] for i in range(n))
    assert n == 1 or not got[1000]["kept"]


def test_a_group_of_most_rows_is_spread_over_tasks(spark, monkeypatch):
    """States are broadcast though the planner isn't asked to, and beyond the bound the shuffle is salted, with the same verdicts."""
    good, junk, _ = corpus(300)
    rows = [(i, t, "en", "hot" if i % 10 else "rest") for i, t in enumerate(good)] + [(1000, junk(), "en", "hot")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    verdicts = []
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for most in (10_000, 0):
            monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", most)
            found = quality_rules.judge(docs)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == bool(most) and ("__salt" in plan) == (not most)
            verdicts.append(sorted((r["doc_id"], r["kept"], round(r["distance"], 6)) for r in found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert verdicts[0] == verdicts[1] and dict((i, k) for i, k, _ in verdicts[0])[1000] is False
