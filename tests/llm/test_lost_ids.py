"""Stages that filter judge each row by its text: null and repeated ids lose no document."""

import zlib

from pyspark.sql import functions as F
from test_dedup_ops import prose

from tablesense.llm import decontamination, quality_classifier, simhash

SCHEMA = "doc_id long, text string, n int"


def test_near_duplicates_without_ids_or_with_repeated_ones(spark):
    a, b, c, d, e = (prose(i, 80) for i in range(500, 505))
    rows = [(1, a, 0), (None, a, 0), (None, b, 0), (None, b, 1), (None, c, 0), (7, d, 0), (7, e, 0), (7, a, 0), (7, e, 0), (9, e, 0), (None, None, 0), (None, "", 0)]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert kept.columns == ["doc_id", "text", "n"]
    got = sorted(((r["doc_id"], r["text"] or "", r["n"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a, 0), (None, b, 0), (None, c, 0), (7, d, 0), (7, e, 0), (None, "", 0)], key=str)


def test_contaminated_rows_go_alone(spark):
    item = prose(600, 12)
    clean = [prose(i, 40) for i in range(601, 605)]
    bad = f"{clean[0]} {item} {clean[1]}"
    rows = [(None, bad, 0), (None, clean[0], 0), (None, clean[1], 0), (None, None, 0), (5, bad, 0), (5, clean[2], 0), (5, clean[2], 0), (6, clean[3], 0), (8, bad, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((r for r in rows if r[1] != bad), key=str)
    assert decontamination.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def test_documents_are_spread_over_tasks_beyond_the_broadcast(spark):
    """No join deals out the documents' own rows by one key; the result is that of the broadcast."""
    docs = spark.createDataFrame([(i, f"word{i} the items own words stand here {i % 7}") for i in range(400)] + [(None, None), (400, "")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(k, f"the items own words stand here {k}") for k in range(3)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    both = []
    try:
        for most in (0, 16 << 20):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if not most else before)
            found = decontamination.contamination(docs, items, window=5, broadcast_bytes=most)
            both.append(sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()))
            assert most or max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert both[0] == both[1] and len(both[0]) == 402 and any(r[2] for r in both[0])


def test_the_classifier_learns_from_a_bounded_sample(spark, monkeypatch):
    """Repeated ids bring no more rows, and texts that don't fit aren't learned from, nor cut."""
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(learned[0], f"copy {k % 3}") for k in range(200)] + [(i, "good words " * 5) for i in learned[1:9]] + [(learned[9], "x" * 100_000)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learned[:10])], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality_classifier, "fit", lambda bags, y, weight: seen.update(n=len(bags), passages=sum(map(len, bags))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    quality_classifier.train(docs, labels, max_documents=4)
    assert seen["n"] <= 4
    quality_classifier.train(docs, labels, max_documents=100)
    assert seen["n"] == 10 and seen["passages"] > 10
    quality_classifier.train(docs, labels, max_documents=100, max_bytes=1000)
    assert seen["n"] == 9 == seen["passages"]
