"""SimHash, substrings, components and packing plans against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesense.llm import packing, simhash, substrings
from tablesense.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, fp long, tkey string, copies int"


def rows(texts):
    return [(i, t, "en", 7, "x", 1) for i, t in enumerate(texts)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints):
    group = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    return group


def test_simhash_against_brute_force(spark):
    base = prose(1, 120)
    near = [base.replace(base.split()[k], "zz", 1) for k in range(0, 60, 3)]
    texts = [None, "", " \t ", "Two words", "TWO WORDS", base, base, *near, prose(2, 300), "é" * 50 + " Ä b c d", prose(3, 20_000)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows(texts), DOCS)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), min_size=0, max_size=4))
def test_variants_meet(fp, bits):
    """Fingerprints within four bits share a variant, by the segments' arithmetic."""
    other = fp
    for b in bits:
        other ^= 1 << b

    def variants(x):
        return {(b, (x >> s & (1 << w) - 1) & ~(1 << b - s)) for s, w in simhash.SEGMENTS for b in range(s, s + w)}

    assert variants(fp) & variants(other)


def signed(prints):
    return [(x - (1 << 64) if x >> 63 else x,) for x in prints]


def links_of(spark, prints):
    return [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(spark.createDataFrame(signed(prints), "fp long")).collect()]


def grouped(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_near_links_are_true_and_lose_no_component(spark, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(5)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 9))) for b in base for _ in range(60)})
    got = links_of(spark, prints)
    assert len(got) == len(set(got)) and all(0 < (a ^ b).bit_count() <= 4 for a, b in got)
    all_pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    assert grouped(prints, got) == grouped(prints, all_pairs)


@pytest.mark.parametrize("distance", [4, 5, 2])
def test_buckets_without_a_hub_are_divided(spark, monkeypatch, distance):
    """Fingerprints of one segment and otherwise unlike, with some within reach of each other: the same links as from all pairs."""
    monkeypatch.setattr(simhash, "PAIRS_A_MEMBER", 3)
    r = random.Random(distance)
    start, width = simhash.SEGMENTS[1]
    shared = r.getrandbits(width) << start
    apart = [r.getrandbits(64) & ~(((1 << width) - 1) << start) | shared for _ in range(150)]
    near = [p ^ sum(1 << k for k in r.sample(range(64), r.randint(1, distance + 2))) for p in r.sample(apart, 60) for _ in range(3)]
    prints = sorted({*apart, *near, *(r.getrandbits(64) for _ in range(50))})
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(spark.createDataFrame(signed(prints), "fp long"), distance).collect()]
    all_pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance]
    assert len(got) == len(set(got)) and set(got) <= {p for a, b in all_pairs for p in ((a, b), (b, a))}
    assert grouped(prints, [tuple(sorted(p)) for p in got]) == grouped(prints, all_pairs)


def test_a_dense_group_of_distinct_fingerprints_is_a_star(spark):
    """Every two of 2,017 fingerprints within two bits of one are linked, which is two million pairs; the hubs' links are few."""
    centre = random.Random(9).getrandbits(64)
    prints = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)})
    got = links_of(spark, prints)
    assert len(set(grouped(prints, got).values())) == 1 and len(got) < 50 * len(prints)


def test_the_index_is_never_broadcast(spark):
    """A row of 64 variants looks like one to the planner."""
    prints = spark.range(30_000).select(F.xxhash64("id").alias("fp"))
    plans = []
    write = simhash.stage
    simhash.stage, kept = lambda df, name, *folder: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name, *folder))[1], simhash.stage
    try:
        simhash.near_links(prints)
    finally:
        simhash.stage = kept
    assert plans and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_keep_one_per_group_keeps_columns_and_least_ids(spark):
    df = spark.createDataFrame(rows(["same text here now"] * 3 + ["another text"]) + [(None, "lost id", None, None, None, None)], DOCS)
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 3, None]
    assert simhash.keep_one_per_group(df.limit(0)).count() == 0


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 50)]
    got = dict(connected_components(spark.createDataFrame([*chain, *hub, (5, 5), (7, 6)], "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for x in data:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] += 1
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_against_brute_force(spark):
    p, q, s = prose(11, 60), prose(12, 45), prose(13, 30)
    texts = [None, "", "short", p, p, prose(21, 30) + p[:250] + prose(22, 30), p[100:301], p[100:300], p[99:299] + "!", prose(23, 50) + q + prose(24, 50) + q, q[:199], s + s[:150], "é" * 150, "é" * 99 + "x" + "é" * 150, "a" * 500, "ab" * 300, q + p + q, prose(25, 4000)]
    df = spark.createDataFrame(rows(texts), DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.deduplicate_substrings(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_random_mosaics(spark, seed):
    r = random.Random(seed)
    pool = prose(seed + 50, 400)
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 4)):
            a = r.randint(0, len(pool) - 400)
            parts.append(pool[a : a + r.randint(50, 400)] if r.random() < 0.7 else prose(r.random(), 30))
        texts.append("".join(parts))
    df = spark.createDataFrame(rows(texts), DOCS)
    got = {x["doc_id"]: tuple(x)[1:] for x in substrings.deduplicate_substrings(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts)


def test_remove_substrings_keeps_rows_and_columns(spark):
    p = prose(31, 60)
    df = spark.createDataFrame([(1, f"x {p} y", 9, 5), (2, p, 9, 5), (3, "alone", 9, 5), (None, None, 9, None)], "doc_id long, text string, starts int, n_chars long")
    got = {r["doc_id"]: r for r in substrings.remove_substrings(df).collect()}
    assert list(got[1].asDict()) == df.columns
    assert (got[1]["text"], got[1]["n_chars"], got[2]["text"], got[3]["text"], got[3]["n_chars"], got[None]["text"]) == ("x  y", 4, "", "alone", 5, None)
    assert substrings.deduplicate_substrings(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once_without_gaps(histogram):
    capacity, filled = 64, defaultdict(list)
    for length, rank, n, sequence, each, offset in packing.plan_slots(histogram.items(), capacity):
        for k in range(n):
            filled[sequence + k // each].append((offset + k % each * length, length, rank + k))
    for slots in filled.values():
        at = 0
        for offset, length, _ in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    ranks = defaultdict(list)
    for slots in filled.values():
        for _, length, rank in slots:
            ranks[length].append(rank)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    best = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, room in enumerate(best) if room >= length]
        if fits:
            best[min(fits, key=lambda i: best[i])] -= length
        else:
            best.append(capacity - length)
    assert len(filled) == len(best)
