"""Very long texts, empty tables, lost and repeated ids and clashing columns, for every operator and every stage of the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tablesense.llm import decontamination, licenses, packing, quality_classifier, quality_rules, sharding, simhash, substrings, tokens, warc
from tablesense.llm.queries import tokenizer_path

CLASH = ["id", "key", "group", "text_crc32", "tie", "part", "row", "sid", "content", "wid", "tkey", "fp", "size", "slot", "digest", "label", "score", "distance", "kept", "start"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASH) for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def no_model(spark):
    return quality_classifier.train(table(spark, []), labels(spark, []))


OPERATORS = {
    "classifier": lambda spark, docs: quality_classifier.score_documents(docs, no_model(spark)),
    "packing": lambda spark, docs: packing.pack_documents(docs, tokenizer_path()).where("piece = 0"),
    "simhash": lambda spark, docs: simhash.near_duplicates(docs),
    "tokens": lambda spark, docs: tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path(), end_id=2)),
    "rules": lambda spark, docs: quality_rules.judge(docs),
    "decontamination": lambda spark, docs: decontamination.contamination(docs, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")),
    "substrings": lambda spark, docs: substrings.deduplicate_substrings(docs),
    "licenses": lambda spark, docs: licenses.scan(docs),
    "sharding": lambda spark, docs: sharding.assign_shards(docs),
    "warc": lambda spark, docs: warc.read_warc(spark, *warc.write_warc(docs, id_col="doc_id", url_col="lang", html_col="text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_come_back_once_each(spark, name):
    """Null ids, repeated ids and rows, null, empty and blank texts, beside columns of all the names used inside."""
    rows = [(1, "some words that are all alike here"), (1, "other words"), (None, "other words"), (None, None), (2, ""), (3, " \n "), (4, "x"), (4, "x"), (5, "\u0000퟿\U0010ffff é")]
    got = OPERATORS[name](spark, table(spark, rows)).collect()
    key = "page_id" if name == "warc" else "doc_id"
    assert collections.Counter(r[key] for r in got) == collections.Counter(i for i, _ in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(4)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(450_000))  # about 3 MB


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts_are_taken_whole(spark, name, long_text):
    docs = table(spark, [(1, long_text), (2, long_text[:-1] + "!"), (3, "short")])
    got = {r["page_id" if name == "warc" else "doc_id"]: r for r in OPERATORS[name](spark, docs).collect()}
    words = len(long_text.split())
    whole = {
        "rules": lambda r: r["n_words"] == words,
        "decontamination": lambda r: r["n_words"] == words,
        "simhash": lambda r: r["fp"] % (1 << 64) == simhash.fingerprint(long_text.encode()),
        "substrings": lambda r: (r["n_bytes"], r["n_removed"]) == (len(long_text), len(long_text) - 1),
        "sharding": lambda r: (r["size"], r["text_crc32"]) == (len(long_text) + 1, zlib.crc32(long_text.encode())),
        "warc": lambda r: r["payload_bytes"] == len(long_text),
        "licenses": lambda r: r["digest"] == hashlib.sha256(long_text.encode()).hexdigest(),
    }
    assert set(got) == {1, 2, 3} and whole.get(name, lambda r: True)(got[1])


def test_repeats_over_the_edges_of_pieces(spark):
    """A text is hashed in pieces of 2 MB; a passage that lies over an edge, and one of a single letter, are found to the byte."""
    r = np.random.default_rng(6)
    noise = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    passage = "<" + noise(600) + ">"
    edge = substrings._PIECE
    text = noise(edge - 300) + "1" + passage + "2" + noise(edge) + "3" + "a" * 5000 + "4"
    docs = spark.createDataFrame([(1, text), (2, "5" + passage + "6" + noise(50)), (3, noise(900))], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in substrings.deduplicate_substrings(docs).collect()}
    assert got == {1: (602 + 5000, 2), 2: (602, 1), 3: (0, 0)}


def pipeline_tables(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, int("good" in (t or "")), 0) for i, t in rows if i is not None]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, pipeline_tables(spark, tmp_path, [])).count() == 0


def test_the_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(i, f"good words number {i} and {i * i} and some more") for i in range(40)] + [(None, "good lost one"), (None, None), (7, "good again 7"), (7, "good again 7"), (50, "")]
    sf = pipeline_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, sf)
        assert docs.schema.names == before.schema.names, name
        assert docs.count() <= before.count()
    assert corpus_pipeline.run(spark, sf).count() >= 1


def brute_shard(key, weights):
    def score(j):
        draw = (int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -weights[j] / math.log(draw), j

    return max(map(score, range(len(weights))))[1]


@pytest.mark.parametrize("weights", [(1.0,) * 8, (1.0, 2.5, 0.5), (3.0,)])
def test_each_key_goes_to_the_shard_of_the_highest_draw(spark, weights):
    keys = spark.range(500).select("id", sharding.rendezvous_shard(sharding.F.col("id"), weights).alias("shard"))
    assert {r["id"]: r["shard"] for r in keys.collect()} == {i: brute_shard(i, weights) for i in range(500)}


def brute_score(model, x):
    """The score of one bag of encoded passages, passage by passage."""
    p = model.layers
    hidden, weights = [], []
    for row in (x - model.mean) / model.scale:
        h = np.array([math.tanh(sum(row[i] * p["E"][i, k] for i in range(len(row))) + p["e"][k]) for k in range(len(p["e"]))])
        gate = [math.tanh(float(h @ p["V"][:, a])) / (1 + math.exp(-float(h @ p["U"][:, a]))) for a in range(len(p["w"]))]
        hidden.append(h)
        weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
    mean = sum(w * h for w, h in zip(weights, hidden)) / sum(weights)
    return 1 / (1 + math.exp(-float(mean @ p["c"] + p["b"][0])))


def test_scores_are_those_of_gated_attention_by_hand(spark):
    rng = np.random.default_rng(8)
    texts = ["Some good words. " * int(rng.integers(1, 60)) for _ in range(12)] + ["$$$ BUY!! " * int(rng.integers(1, 90)) for _ in range(12)] + [None, ""]
    docs = table(spark, list(enumerate(texts)))
    model = quality_classifier.train(docs, labels(spark, [(i, int(i < 12), 0) for i in range(24)]))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(docs, model).collect()}
    for i, t in enumerate(texts):
        x, _ = quality_classifier.encode_passages([(t or "").encode()])
        assert abs(got[i] - brute_score(model, x.astype(float))) < 1e-5
    assert len({round(s, 6) for s in got.values()}) > 5


def test_neighbours_are_both_spelt_anew(spark):
    texts = ["licence licence LICENCE", "the copyright holder copyright holders", "sub licence sub licence"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.normalised(licenses.F.col("t"))).collect()]
    assert got == ["license license license", "the copyright owner copyright owners", "sublicense sublicense"]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_archives_of_text_ids_have_a_name_for_each_record(spark, kind):
    from tablesense.llm.warc import records

    value = (lambda i: f"page {i}:é!") if kind == "string" else (lambda i: i)
    rows = [(value(i % 5), f"u{i}", f"payload {i % 3}") for i in range(20)] + [(None, None, "payload 0"), (None, None, "payload 0"), (None, "u", "alone")]
    rows += [("", "u", "empty id")] if kind == "string" else []
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
    folder, files = warc.write_warc(pages, roll_bytes=2000)
    names = [h["warc-record-id"] for f in files for h, _ in records(f"{folder}/{f['name']}")]
    refers = {h["warc-refers-to"] for f in files for h, _ in records(f"{folder}/{f['name']}") if "warc-refers-to" in h}
    assert len(names) == len(set(names)) == len(rows) and refers <= set(names)
    got = warc.read_warc(spark, folder, files, kind).collect()
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(i for i, _, _ in rows)
    responses = collections.Counter(r["payload"].decode() for r in got if r["record_type"] == "response")
    assert responses == collections.Counter({t: 1 for _, _, t in rows})
    first = {t: min((i for i, _, x in rows if x == t and i is not None), default=None) for _, _, t in rows}
    assert all(r["refers_to"] in first.values() for r in got if r["record_type"] == "revisit")
