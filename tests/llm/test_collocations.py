"""Collocations against a count of every phrase."""

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tablesense.llm import collocations as C

DATA = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[(lang, *w[i : i + size])] += 1
    kept = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for (lang, *w), a in kept.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= 80 * kept[(lang, *w[i : i + size])]:
                    dropped.add((lang, *w[i : i + size]))
    found = collections.defaultdict(list)
    for (lang, *w), a in kept.items():
        if (lang, *w) not in dropped:
            cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, k = min((2_000_000 * a // (left + right), k) for k, (left, right) in enumerate(cuts))
            found[lang].append((-score, -a, " ".join(w).encode(), cuts[k]))
    return [(lang, rank, p.decode(), -a, *cut, n[lang], -score) for lang, rows in found.items() for rank, (score, a, p, cut) in enumerate(sorted(rows)[:top], 1)]


def same(df, rows, **options):
    got = C.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    options.pop("block_words", None)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, **options))


@pytest.mark.parametrize("block_words", [50, 4_000_000])
def test_random_texts(spark, block_words):
    rng = random.Random(block_words)
    words = ["The", "of", "a", "ship", "naïve", "x y", "É", "z" * 300, "and"]
    blanks = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ;", " "]
    rows = [("".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for _ in range(400)]
    rows += [(None, "en"), ("", "xx"), (" \t\n", "xx"), ("of ship", None)] + [("the same line of text again.", "en")] * 40
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], KIND).withColumns({c: F.lit(1) for c in ("a", "b", "id", "total", "block", "word", "n", "lang_pred", "t")}).repartition(3)
    same(df, rows, block_words=block_words)
    same(df, rows, least=8, top=7, block_words=block_words)


def test_one_very_long_text_is_cut_at_ends_of_pieces(spark):
    text = "one two three four five. " * 20_000 + "no end here " * 30_000
    rows = [(text, "en"), ("one two three four", "en")]
    same(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], KIND), rows, block_words=10_000)
    blocks = C.word_blocks(spark.createDataFrame([(0, text, "en")], KIND), block_words=10_000)
    assert blocks.count() > 5 and blocks.agg(F.sum("n")).first()[0] == 190_000


def test_overlaps_count(spark):
    rows = [("a " * 40, "en")]
    same(spark.createDataFrame([(0, *rows[0])], KIND), rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    same(docs, [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()])


def test_no_rows_and_nothing_frequent(spark):
    empty = spark.createDataFrame([], KIND)
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([(0, "a b c d", "en")], KIND)).count() == 0
    assert C.collocations(spark.createDataFrame([(0, "a. " * 50, "en")], KIND)).count() == 0
