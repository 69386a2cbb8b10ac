"""Language identification: the folded network against plain convolution, held-out accuracy, odd rows."""

import os

import numpy as np
import pytest

from tablesense.llm import language_id as L
from tablesense.llm import queries

DATA = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, source string"


def plain(network, text):
    """Mean log-probabilities of a text by direct convolution, a byte at a time."""
    symbols = [int(L._SYMBOL[b]) for b in text]
    total, weight = np.zeros(len(network.languages)), 0
    for lo in range(0, max(1, len(symbols)), L.WINDOW):
        seen = symbols[lo : lo + L.WINDOW + L._AHEAD]
        seen = seen + [0] * (L.WINDOW + L._AHEAD - len(seen))
        answers = []
        for w in network.filters:
            places = [sum(network.embedding[seen[p + k]] @ w[k] for k in range(len(w))) for p in range(L.WINDOW)]
            answers.append(np.max(places, axis=0))
        z = np.maximum(np.concatenate(answers) + network.thresholds, 0) @ network.out + network.bias
        size = min(L.WINDOW, len(symbols) - lo)
        total += size * (z - np.log(np.exp(z).sum()))
        weight += size
    share = np.exp(total / weight)
    return share / share.sum()


def learned(seed=3, classes=3):
    rng = np.random.default_rng(seed)
    words = [["the", "of", "and", "ship"], ["der", "und", "schön", "Straße"], ["les", "été", "être", "où"]][:classes]
    samples = [(" ".join(rng.choice(words[k], 60)).encode(), k) for k in range(classes) for _ in range(40)]
    return L.fit([s for s, _ in samples], np.array([k for _, k in samples]), [f"l{k}" for k in range(classes)], epochs=3)


def test_the_folded_network_is_plain_convolution():
    network = learned()
    texts = [b"a", b"the ship of the", "schön und Straße ".encode() * 40, bytes(range(1, 256)) * 3, b"x" * 251, b"y" * 256, b"z" * 257]
    best, score = network.predict(texts, network.table())
    for text, k, p in zip(texts, best, score, strict=True):
        want = plain(network, text)
        assert k == want.argmax() and abs(p - want[k]) < 1e-4
    # what stands beside a text in a batch doesn't matter
    assert abs(network.predict([texts[2]], network.table())[1][0] - score[2]) < 1e-6


def test_languages_are_told_apart():
    network = learned()
    best, _ = network.predict(["the and of the ship".encode(), "der und schön".encode(), "où être les été".encode()], network.table())
    assert best.tolist() == [0, 1, 2]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_held_out_accuracy(spark):
    got = queries.op11_language_id(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert len(rows) > 250 and sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)


def test_odd_rows(spark):
    texts = ["the ship and the house of the river", "der Fluss und die Straße sind schön"]
    rows = [(i, texts[i % 2] * 20, ("en", "de")[i % 2], "s") for i in range(60)]
    rows += [(500, None, "en", None), (501, "", None, "s"), (504, "12 ;; 34", "xx", "s"), (None, texts[1], None, "s"), (None, texts[0] * 9, "en", "s"), (7, texts[0], "en", "s"), (7, texts[0], "en", "s"), (503, texts[1] * 30_000, None, None)]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS h", "2 AS id", "3 AS score", "4 AS letters", "5 AS t", "6 AS held_out").repartition(3)
    network = L.train(docs)
    assert network.languages == ["de", "en", "xx"]
    got = L.identify(docs, network).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got}
    assert [of[k]["lang_pred"] for k in (500, 501, 504)] == ["und"] * 3 and of[504]["score"] == 0
    assert of[0]["lang_pred"] == "en" and of[1]["lang_pred"] == "de" and of[503]["lang_pred"] == "de"
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None) == ["de", "en"] and sum(r["doc_id"] == 7 for r in got) == 3
    assert all(0 <= r["score"] <= 1 for r in got)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "words", None, "s")], KIND)
    assert [tuple(r) for r in L.identify(docs, L.train(docs)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert L.identify(docs.limit(0), L.train(docs.limit(0))).count() == 0
    one = spark.createDataFrame([(0, "words here", "en", "s")], KIND)
    assert L.identify(one, L.train(one)).first()["lang_pred"] == "en"


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = [(0, "a b c " * 50_000, "en", "s")] * 300 + [(i, "d e f", "de", "s") for i in range(30)]
    seen = {}
    monkeypatch.setattr(L, "fit", lambda samples, y, languages: seen.update(n=len(samples), bytes=sum(map(len, samples)), y=y.tolist()))
    L.train(spark.createDataFrame(rows, KIND).repartition(4), max_documents=10, max_windows=3)
    assert seen["n"] <= 30 and seen["bytes"] <= 30 * (L.WINDOW + L._AHEAD) and set(seen["y"]) == {0, 1}
