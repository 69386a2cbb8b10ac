"""The conversation trie against a brute-force one, and running sums that cross partitions."""

import collections
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablesense.llm import conversations as C
from tablesense.llm import queries
from tablesense.llm.running import running_sums

DATA = "/root/testdata/sf0.01"
KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows of the trie by tuples of turns; rows of (conv_id, turn, role, text) with turns of different numbers."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
    digest = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p, m)) for p, m in members.items()]


def same(got, rows):
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found, want = (sorted(map(tuple, r), key=lambda r: (r[0], r[1])) for r in (got.collect(), brute(rows)))
    assert found == want


def test_random_conversations(spark, tmp_path):
    rng, rows = random.Random(1), []
    for c in [*range(60), *range(205, 230), *range(1000, 1040)]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8]) if c != 30 else 500):
            rows.append((c, t if t or rng.random() < 0.7 else None, rng.choice(["user", None, ""]), rng.choice(["a", "bé", None, "xyz"])))
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS i", "2 AS conv", "3 AS depth", "4 AS content", "5 AS chars", "6 AS size").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op12_conversation_trie(spark, str(tmp_path)), rows)


def test_a_hot_conversation_and_thousands_of_copies(spark, tmp_path):
    rows = [(c, t, "user", "same text") for c in range(0, 90_000, 100) for t in range(3)] + [(7, t, None, f"turn {t % 9}") for t in range(2000)]
    rows += [(50, 0, "user", "x" * 1_000_000), (51, 0, "user", "x" * 1_000_000), (None, 0, "user", "no id")]
    spark.createDataFrame(rows, KIND).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op12_conversation_trie(spark, str(tmp_path)), rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_conversation_trie(spark, DATA), rows)


def test_a_tall_tree_of_chains(spark):
    # conversation k begins as all of 0 to k - 1 together: each one hangs on the one before
    rows = [(k, d, str(min(d, 30 - k))) for k in range(12) for d in range(1, 31)]
    turns = spark.createDataFrame(rows, "conv long, depth long, t string").select("conv", "depth", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("content"), F.lit(1).cast("long").alias("chars"))
    got = {(r["conv_id"], r["depth"]): r for r in C.prefix_trie(turns.groupBy("conv").agg(F.max("depth").alias("size")), turns).collect()}
    texts = {k: [t for c, _, t in rows if c == k] for k in range(12)}
    assert len(got) == len({tuple(v[:d]) for v in texts.values() for d in range(31)})
    assert got[0, 0]["n_leaves"] == len({tuple(v) for v in texts.values()}) and got[0, 0]["n_convs"] == 12
    every = [tuple(v[:d]) for v in texts.values() for d in range(1, 31)]
    assert got[0, 0]["saved_tokens"] == len(every) - len(set(every))


def test_repeated_turns_and_no_rows(spark, tmp_path):
    rows = [(1, 5, "user", "a"), (1, 5, "user", "a"), (1, 5, "bot", "b"), (1, None, None, None)]
    turns = C.ordered_turns(spark.createDataFrame(rows, KIND))
    assert [r["i"] for r in turns.orderBy("i").collect()] == [1, 2, 3, 4] and turns.where("i = 1").first()["chars"] == 0
    assert turns.select("content").distinct().count() == 3
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_conversation_trie(spark, str(tmp_path)).count() == 0


def test_running_sums_cross_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b", "b", "c"]), i, rng.randrange(-5, 9), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at long, v long, one long").repartition(7)
    got = {r["at"]: (r["k"], r["v"], r["one"]) for r in running_sums(df, "k", ["at"], ["v", "one"], "sums").collect()}
    sums = collections.defaultdict(lambda: [0, 0])
    for k, i, v, one in rows:
        sums[k][0] += v
        sums[k][1] += one
        assert got[i] == (k, *sums[k])
    assert len(got) == 3000
