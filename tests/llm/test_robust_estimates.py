"""Minimum covariance determinants against all subsets of small groups, and what a group of outliers does to them."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tablesense.llm import quality_rules as Q

NAMES = [f"x{i}" for i in range(Q.D)]


def table(spark, groups):
    return spark.createDataFrame([(g, *map(float, x)) for g, rows in groups.items() for x in rows], ", ".join(["group string", *(f"{n} double" for n in NAMES)]))


def logdet(rows, share=0.75):
    """Of the regularised covariance of a subset, as the module's docstring has it."""
    n = len(rows)
    weight = Q.PRIOR_ROWS / (n + Q.PRIOR_ROWS)
    scale = share / Q.chi2_cdf(Q.chi2_quantile(share, Q.D), Q.D + 2)
    cov = (1 - weight) * scale * np.cov(rows.T, bias=True) + weight * np.diag(np.square(Q.SPREAD)) + np.diag(np.square(Q.FLOORS))
    return np.linalg.slogdet(cov)[1]


def test_the_least_determinant_of_all_subsets_is_found(spark):
    groups = {}
    for seed in range(4):
        rng = np.random.default_rng(seed)
        rows = rng.normal(size=(15, Q.D)) @ rng.normal(size=(Q.D, Q.D))
        rows[:3] += rng.normal(size=Q.D) * 25
        groups[f"g{seed}"] = rows
    got = {r["group"]: r for r in Q.mcd_states(table(spark, groups), reweight=0).collect()}
    for g, rows in groups.items():
        h = math.ceil(0.75 * len(rows))
        best = min((logdet(rows[list(some)]), some) for some in itertools.combinations(range(len(rows)), h))
        assert abs(got[g]["logdet"] - best[0]) < 1e-6, g
        assert np.allclose([got[g][f"m{i}"] for i in range(Q.D)], rows[list(best[1])].mean(axis=0)) and not {0, 1, 2} & set(best[1])


def test_a_fifth_of_far_rows_together_does_not_draw_the_estimate(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(Q.D, Q.D))
    clean, far = rng.normal(size=(800, Q.D)) @ mix, rng.normal(size=(200, Q.D)) * 0.3 + 60
    state = Q.mcd_states(table(spark, {"one": np.concatenate([clean, far]), "two": clean})).collect()
    for r in state:
        assert np.allclose([r[f"m{i}"] for i in range(Q.D)], clean.mean(axis=0), atol=0.25)
        precision = np.zeros((Q.D, Q.D))
        for i, j in Q._TRI:
            precision[i, j] = precision[j, i] = r[f"p{i}_{j}"]
        truth = mix.T @ mix + np.diag(np.square(Q.FLOORS))
        ratio = np.linalg.eigvals(np.linalg.inv(precision) @ np.linalg.inv(truth)).real
        assert 0.75 < ratio.min() and ratio.max() < 1.35


def test_each_cell_with_rows_enough_has_its_own_estimate(spark):
    words = lambda k, n: " ".join(f"{'w' * k}{i * 7919 % 997}" for i in range(n))
    rows = [(i, words(3, 60 + i), "en", "a") for i in range(40)] + [(100 + i, words(9, 60 + i), "en", "b") for i in range(40)] + [(200 + i, words(9, 60 + i), "en", "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = Q.stats(docs, "doc_id", "text", "lang", "source")
    from tablesense.llm.shared import temporary

    with temporary(spark) as put:
        judging, helping = Q._groups(stats, 5 * Q.D, put)
        assert {r["source"]: r["group"] for r in judging.collect()} == {"a": '["en","a"]', "b": '["en","b"]', "rare": '["en"]'}
        assert helping.where(F.col("group") == '["en"]').count() == 3
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert all(r["kept"] for r in got.values())


def test_alike_rows_and_single_rows_have_estimates(spark):
    got = {r["group"]: r for r in Q.mcd_states(table(spark, {"same": np.ones((30, Q.D)), "one": np.zeros((1, Q.D))})).collect()}
    assert got["same"]["m0"] == 1 and got["one"]["m0"] == 0 and all(np.isfinite(r["logdet"]) for r in got.values())
    assert Q.mcd_states(table(spark, {"none": np.ones((1, Q.D))}).limit(0)).count() == 0
