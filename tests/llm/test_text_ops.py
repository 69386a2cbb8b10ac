"""Tokens, packing, decontamination, quality rules and classifier, licences, shards and archives on small fixtures."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tablesense.llm import decontamination, licenses, packing, quality_classifier, quality_rules, sharding, tokens, warc
from tablesense.llm.files import read_bytes
from tablesense.llm.queries import tokenizer_path

TEXTS = [None, "", "  ", "Hello, world! It's 2024.", "Hello, world! It's 2024.", "ΑΣ Σ ß İ ½² x_y", "é\x85y\x1cz", "a<|endoftext|>b", "word " * 3000, "日本語 text", "x" * 300]
IDS = [5, 1, 2, 3, None, 8, 9, 9, 4, 7, 6]
DOCS = "doc_id long, text string, lang string, source string, ids string, start int, part int, shard int, size int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, "x", 1, 2, 3, 4) for i, t in zip(IDS, TEXTS)], DOCS)


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_encoder_is_the_library(library):
    got = tokens.WordEncoder(tokenizer_path()).encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_token_files_round_trip(spark, docs, library):
    files = tokens.write_tokens(docs, tokenizer_path(), end_id=2)
    got = tokens.read_tokens(spark, files).collect()
    assert len(got) == len(TEXTS)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted(IDS, key=lambda i: (i is not None, i))
    at = 0
    for r in order:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    want = collections.Counter((i, ids_of(library, t, 2).tobytes()) for i, t in zip(IDS, TEXTS))
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert b'"tokens": %d' % at in read_bytes(f"{files.folder}/manifest.json")
    empty = tokens.write_tokens(docs.limit(0), tokenizer_path(), end_id=2)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_packing_against_the_library(spark, docs, library):
    got = packing.pack_documents(docs, tokenizer_path(), capacity=64).collect()
    pieces = collections.Counter()
    for i, t in zip(IDS, TEXTS):
        x = ids_of(library, t, 0)
        for k in range(0, len(x), 64):
            pieces[(i, k // 64, k, len(x[k : k + 64]), zlib.crc32(x[k : k + 64].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in by_sequence.values():
        ends = [0, *np.cumsum([n for _, n in sorted(slots)])]
        assert [o for o, _ in sorted(slots)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_packed_sequences_hold_the_ids(spark, docs, library):
    written = packing.written_pieces(docs, tokenizer_path(), capacity=64)
    placed = packing.place_pieces(written.drop("ids", "ids_crc32"), 64)
    got = packing.packed_ids(placed, written).collect()
    assert sum(len(r["ids"]) for r in got) == 4 * sum(len(ids_of(library, t, 0)) for t in TEXTS)
    assert max(len(r["ids"]) for r in got) <= 256


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("broadcast_bytes", [0, 16 << 20])
def test_decontamination_against_brute_force(spark, broadcast_bytes):
    item = "One two three, four FIVE six seven eight nine ten eleven twelve"
    items = [(1, item, 0), (2, "É uno dos", 0), (3, "single", 0), (4, None, 0), (5, "...", 0), (10, item, 0), (None, "null item words", 0)]
    texts = [None, "", item.upper(), "zero " + item.replace(",", " ;") + " one two three", "one two three four five six seven eight nine", "É UNO dos tres", "é uno dos", "singles", "a single single b", "null ITEM words", item + " " + item, "w " * 20_000 + item]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "single", 1, 2), (3, "clean", 1, 2)], "doc_id long, text string, item int, w int")
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string, n int"), broadcast_bytes=broadcast_bytes).collect()
    want = collections.Counter()
    for i, t in [*enumerate(texts), (None, "single"), (3, "clean")]:
        words, hit, named = brute_words(t), set(), set()
        for k, text, _ in items:
            w = brute_words(text)
            n = min(10, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == w[a : a + n]:
                        hit.update(range(b, b + n))
                        named.add("" if k is None else str(k))
        want[(i, len(words), len(hit), tuple(sorted(named)))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    none = decontamination.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(texts) + 2 and none.where("n_hit > 0").isEmpty()
    kept = decontamination.drop_contaminated(docs.where("doc_id < 3 or doc_id = 7"), spark.createDataFrame(items, "item_id long, text string, n int"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 7]


def test_native_operators_have_no_python_in_their_plans(spark, docs):
    plans = [
        decontamination.contamination(docs, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")),
        licenses.scan(docs),
        sharding.assign_shards(docs),
    ]
    for df in plans:
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, inside = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            inside.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(inside)


@pytest.mark.parametrize("text", [*TEXTS, "a b c d e a b c d e f", "a a a a a a a", "x\n\n x\nx\nx \n", "#$ é|<ü>&*%", "a b c d e f a b c d f a b c d e"])
def test_text_stats(text):
    assert quality_rules.text_stats(text and text.encode()) == brute_stats(text)


def test_quality_rules_reject_outliers_only(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(60, 600))), "en", f"s{i % 2}", 0.0) for i in range(500)]
    rows += [(1000 + i, " ".join(f"{w}##$$" for w in rng.choice(vocabulary, 200)), "en", "s0", 0.0) for i in range(10)]
    rows += [(2000, "too few", "en", "s0", 0.0), (2001, None, None, None, None), (None, "only one of its kind and language but long enough to be judged", "xx", None, 0.0), (2003, "again and again " * 50, "en", "s1", 0.0)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance double")).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(500)) and not any(got[1000 + i]["kept"] or got[1000 + i]["base_failed"] for i in range(10))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and got[2003]["base_failed"] and got[None]["kept"]
    few = quality_rules.judge(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string, distance double"))
    assert few.where("kept").count() == 20
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_chi2():
    assert abs(quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.95, 5), 5) - 0.95) < 1e-9
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_classifier_learns_and_scores_whole_texts(spark):
    rng = np.random.default_rng(2)
    good = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(rng.integers(20, 300))) + "." for _ in range(150)]
    bad = ["BUY " * int(rng.integers(5, 300)) + "!!! $$$" for _ in range(150)]
    rows = [(i, t, i, 0.0) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (900, None, 0, 0.0), (901, "", 0, 0.0), (None, " \n ", 0, 0.0), (902, good[0] + "x" * 100_000, 0, 0.0)], "doc_id long, text string, y int, score double")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300)] + [(0, None, None), (5000, 1, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels, max_documents=200)
    got = {r["doc_id"]: r for r in quality_classifier.score_documents(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(300)) and len(got) == 304
    assert np.mean([got[i]["predicted"] == (i < 150) for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = quality_classifier.keep_accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    empty = quality_classifier.train(docs, labels.limit(0))
    assert quality_classifier.score_documents(docs, empty).where("score = 0.5").count() == 304


def test_classifier_gradient():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality_classifier.FEATURES)).astype(np.float32) for n in (1, 3, 2)]
    x, bag, y, w = np.concatenate(bags).astype(float), np.array([0, 1, 1, 1, 2, 2]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    model = quality_classifier.fit(bags, y, w, epochs=1)
    loss = lambda: float(np.sum(w / w.sum() * np.logaddexp(0, np.where(y == 1, -1, 1) * model.bags(x, bag, 3)[0])))
    grad = quality_classifier._gradient(model, x, bag, y, w, 0.0)
    for name, p in model.layers.items():
        at = tuple(0 for _ in p.shape)
        old, step = p[at], 1e-5
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-6, name


def test_encoding_does_not_depend_on_neighbours():
    texts = [t.encode() for t in ("One two.", "", "x" * 9000, "a b\n" * 500)]
    x, bag = quality_classifier.encode_passages(texts)
    for k, t in enumerate(texts):
        alone, _ = quality_classifier.encode_passages([t])
        assert np.array_equal(x[bag == k], alone)


def test_licenses(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    texts = {1: mit, 2: "MIT License\n" + mit, 3: "/* Copyright (c) 2020 Someone */\n" + mit.upper().replace(",", " ;"), 4: mit.replace("COPYRIGHT HOLDERS", "copyright owners"), 5: None, 6: "", 7: "© 1999 X\n", 8: mit + " and more", 9: "Released under the MIT licence!"}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, v, "d") for k, v in texts.items()], "doc_id long, text string, digest string")).collect()}
    assert {k: r["license_id"] for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: None, 7: None, 8: None, 9: "MIT notice"}
    assert got[5]["digest"] == got[6]["digest"] == got[7]["digest"] == hashlib.sha256(b"").hexdigest()


def test_sharding(spark, docs):
    got = sharding.assign_shards(docs, (1.0,) * 8, (1.0,) * 9).collect()
    sizes = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(IDS, TEXTS))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 9}) == 1
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_shards_follow_weights(spark):
    keys = spark.range(4000).select("id", sharding.rendezvous_shard(sharding.F.col("id"), (1.0, 3.0)).alias("shard"))
    share = keys.where("shard = 1").count() / 4000
    assert 0.72 < share < 0.78


def test_warc_round_trip(spark):
    html = {7: "<p>é</p>", 3: "<p>é</p>", 9: None, 4: "", 1: "x" * 5000, 12: "x" * 5000, 15: "unique\r\n\r\nwith blank lines"}
    rows = [(k, f"http://example.org/{k} a\n?é", v, 1) for k, v in html.items()] + [(9, None, None, 1), (None, "", "unique too", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder, files = warc.write_warc(pages, roll_bytes=600)
    again, files2 = warc.write_warc(pages, roll_bytes=600)
    assert sorted(f["sha256"] for f in files) == sorted(f["sha256"] for f in files2) and len(files) > 1
    assert all(hashlib.sha256(read_bytes(f"{folder}/{f['name']}")).hexdigest() == f["sha256"] for f in files)
    got = warc.read_warc(spark, folder, files).collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, v, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(v or "", k)
    responses = collections.Counter()
    for r in got:
        text = html[r["page_id"]] or "" if r["page_id"] is not None else "unique too"
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode())
        responses[text] += r["record_type"] == "response"
        assert r["refers_to"] == (None if r["record_type"] == "response" else first[text])
        assert r["record_type"] == "revisit" or (r["page_id"] == first[text] and r["payload"].decode() == text)
    assert set(responses.values()) == {1}
    assert warc.read_warc(spark, *warc.write_warc(pages.limit(0))).count() == 0
