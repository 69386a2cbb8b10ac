"""The cache with two writers at once, and folders that appear whole."""

import threading

from pyspark.sql import functions as F

from tablesense.operators import retrieval as R
from tablesense.sources import store
from tablesense.sources.sinks import cached


def requests(spark, ids):
    return spark.createDataFrame([(f"k{i}", i) for i in ids], "key string, n int")


def test_two_writers_at_once(spark, tmp_path):
    folder, barrier, failed = f"file://{tmp_path}/cache", threading.Barrier(2), []
    asked = [list(range(40)), list(range(20, 60))]

    def write(who):
        cache = store.Cache(spark, folder)

        def compute(new):
            barrier.wait(60)  # both have seen an empty cache, and both compute keys 20 to 39
            return new.select("key", (F.col("n") * 10).alias("value"), F.lit(who).alias("who"))

        try:
            got = {r["key"]: r["value"] for r in cache.get(requests(spark, asked[who]), compute).collect()}
            assert got == {f"k{i}": i * 10 for i in asked[who]}
        except BaseException as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    cache = store.Cache(spark, folder)
    rows = cache.read().collect()
    assert len(cache.segments()) == 2 and len(rows) == 60 == len({r["key"] for r in rows})
    assert {r["key"]: r["who"] for r in cache.read().collect()} == {r["key"]: r["who"] for r in rows}
    assert sum(cache.manifest(s)["rows"] for s in cache.segments()) == 80


def test_a_failed_writer_leaves_nothing_that_readers_see(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    broken = F.udf(lambda n: 1 // (n - 3), "int")
    try:
        cached(spark, requests(spark, range(6)), folder, "key", lambda new: new.select("key", broken("n").alias("v")))
        raise AssertionError("it should fail")
    except Exception as error:  # noqa: BLE001
        assert "division" in str(error)
    assert store.Cache(spark, folder).read() is None
    assert cached(spark, requests(spark, range(6)), folder, "key", lambda new: new.select("key", F.col("n").alias("v"))).count() == 6


def test_only_new_keys_are_computed(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/cache", []

    def compute(new):
        seen.append(sorted(r["n"] for r in new.collect()))
        return new.select("key", F.col("n").alias("v"))

    for ids in (range(3), range(5), range(2), [4, 4, 4]):
        assert cached(spark, requests(spark, ids), folder, "key", compute).count() == len(set(ids))
    assert seen == [[0, 1, 2], [3, 4]]
    assert cached(spark, requests(spark, []), f"{folder}2", "key", compute).count() == 0


def test_one_of_two_folders_takes_a_name(spark, tmp_path):
    for k in (1, 2):
        store.write_text(spark, f"file://{tmp_path}/staged{k}/a.txt", str(k))
    assert store.commit(spark, f"file://{tmp_path}/staged1", f"file://{tmp_path}/deep/final")
    assert not store.commit(spark, f"file://{tmp_path}/staged2", f"file://{tmp_path}/deep/final")
    assert store.read_text(spark, f"file://{tmp_path}/deep/final/a.txt") == "1" and not store.exists(spark, f"file://{tmp_path}/staged2")
    assert store.folders_in(spark, f"file://{tmp_path}/deep/final") == []


def test_keys_tell_parts_apart(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a", None), ("a", "-"), (None, "a"), ("", "a")]
    keys = spark.createDataFrame(rows, "a string, b string").select(store.content_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert len({r["k"] for r in keys}) == len(rows) and all(len(r["k"]) == 32 for r in keys)


def test_vectors_are_encoded_once(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "ships and harbours"), (2, "ships and harbours"), (3, "tax law"), (4, None)], "id int, text string")
    calls = []

    def encoder(text):
        calls.append(1)
        return R.hashed_terms(16)(text)

    for _ in range(2):
        got = {r["id"]: r["vector"] for r in R.encoded(chunks, "text", encoder, "hashed-16", f"file://{tmp_path}/vectors").collect()}
        assert got[1] == got[2] != got[3] and sum(got[1]) == 2 and sum(got[4]) == 0
    assert len(calls) == 1
    assert store.Cache(spark, f"file://{tmp_path}/vectors").read().count() == 3
