"""The corpus pipeline on a small corpus, each stage against brute force on its own input."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_dedup_ops import brute_components, brute_fingerprint, prose
from test_text_ops import brute_words

from tablesense.llm import quality_classifier
from tablesense.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    item = prose(900, 14)
    passage = prose(901, 60)
    texts = [prose(i, 150) + "." for i in range(40)]
    texts += [f"{texts[0]} end", texts[1], texts[1]]
    texts += [f"{prose(60 + i, 40)} {passage} {prose(70 + i, 40)}" for i in range(3)]
    texts += [f"{prose(80, 60)} {item.upper()} {prose(81, 60)}", item]
    texts += ["WIN!! $$$ " * (20 + i) for i in range(40)]
    texts += ["", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not (texts[i] or "").startswith("WIN")), 0) for i in range(len(texts) - 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, item, passage


def test_stages_against_brute_force(spark, corpus, tmp_path):
    folder, texts, item, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        step(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
            kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality classifier":
            model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), max_documents=6000)
            assert set(kept) == {i for i, t in before.items() if model.score([(t or "").encode()])[0] >= 0.3}
            assert not any((t or "").startswith("WIN") for t in kept.values()) and set(range(48)) <= set(kept)
        elif name == "SimHash near-dedup":
            group = brute_components({i: brute_fingerprint(t) for i, t in before.items()})
            assert set(kept) == set(group.values()) and all(kept[i] == before[i] for i in kept)
        elif name == "suffix-array dedup":
            data = {i: (t or "").encode() for i, t in before.items()}
            seen = collections.Counter(x[j : j + 200] for x in data.values() for j in range(len(x) - 199))
            for i, x in data.items():
                gone = np.zeros(len(x), bool)
                for j in range(len(x) - 199):
                    if seen[x[j : j + 200]] > 1:
                        gone[j : j + 200] = True
                assert (kept[i] or "") == bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")
            assert not any(passage in (t or "") for t in kept.values())
        elif name == "benchmark decontamination":
            w = brute_words(item)
            windows = {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
            clean = {i for i, t in before.items() if not any(tuple(brute_words(t)[j : j + 10]) in windows for j in range(len(brute_words(t)) - 9))}
            assert set(kept) == clean and len(clean) < len(before)
        else:
            from tokenizers import Tokenizer

            library, want = Tokenizer.from_file(tokenizer_path()), collections.Counter()
            for i, t in before.items():
                ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
                for j in range(0, len(ids), 2048):
                    want[(i, j // 2048, j, len(ids[j : j + 2048]), zlib.crc32(ids[j : j + 2048].tobytes()))] += 1
            got = after.collect()
            assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        docs = after


def test_run_is_all_stages(spark, corpus):
    folder, *_ = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 30
