"""Quality rules: base limits, and robust multivariate outliers by minimum covariance determinants.

Every document is a vector of transformed counts. For each language and source, the ``share`` of the rows is sought whose
covariance has the least determinant. Concentration steps go towards it: from the estimate at hand, the nearest ``share`` of the
rows give the next one. There are four deterministic starts (median deviations without correlation, with that of
squashed, of signed, and of plain scores); after two steps each, the one of least determinant goes on until a step doesn't lower it
any more. The estimate is then reweighted, by the rows within the 97.5 % ellipsoid, and documents beyond a Mahalanobis distance
are rejected.

The covariance is the subset's, scaled to be consistent for normal data, plus a fixed diagonal: a little for directions in which
nearly all rows are alike, and more where there are few rows. Steps lower the determinant of that sum as they do that of a
plain covariance (the regularised estimator of Boudt, Rousseeuw, Vanduffel and Verdonck, 2020), and it exists for two rows too.

A step is a pass over narrow rows: distances go into a histogram per group, whose cumulative counts give the cutoff, and
the rows within it are summed. No task ever holds a group. A language and source of fewer rows than five for each dimension is
judged by all rows of its language, or if these are fewer too, by all rows of the table, however few.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.shared import discard, stage, temporary

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_BLANK = b"\x20\t\n\r\x0b\x0c"
#: Continuation bytes of UTF-8 and the six blanks: what is left over counts the code points in words.
_NOT_COUNTED = bytes([*range(0x80, 0xC0), *_BLANK])


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    ranks, size = at, 1
    while size < window:  # a run of up to twice the length is a pair of ranks, which are then numbered anew
        step = min(size, window - size)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        _, ranks = np.unique(pairs, return_inverse=True)
        size += step
    often = np.bincount(ranks)[ranks] > 1
    if not often.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    begins = np.flatnonzero(often)
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int]:
    """STATS of a whole text; null: zeros."""
    text = text or b""
    words = text.split()
    chars = len(text.translate(None, _NOT_COUNTED))
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)] if b"\n" in text else ()
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def stats(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("t"))

    def batches(it):
        for b in it:
            texts = b.column(3).cast(pa.binary()).to_numpy(zero_copy_only=False)
            got = np.array([text_stats(t) for t in texts], dtype=np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in got.T)], names=["id", "lang", "source", *STATS])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"id {kind}, lang string, source string, {', '.join(f'{c} long' for c in STATS)}")


#: Words of average length and without faults that a text is measured with, so that a few words of a short one don't count
#: as much as hundreds of a long one.
PRIOR_WORDS, PRIOR_CHARS = 20, 100


def _vector() -> list[Column]:
    """The transformed counts: scale of length, mean word length, and shares of the rest on a log scale."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    more = words + PRIOR_WORDS
    return [F.ln(words), F.ln((F.col("word_chars") + PRIOR_CHARS) / more), *[F.ln(1 + 100 * F.col(c) / more) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]]


#: Least standard deviations of the vector, below which a difference is of no account: most documents have no symbols
#: and repeat nothing, and their spread of nearly nothing would make outliers of all others.
FLOORS = (0.25, 0.05, 0.35, 0.5, 0.6)
D = len(FLOORS)
#: Standard deviations that so many rows more would have: the covariance of a few rows by themselves says little.
SPREAD, PRIOR_ROWS = (1.0, 0.1, 0.7, 1.0, 1.2), 2 * (D + 1)
_BINS, _PER_DOUBLING = 4096, 64


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    term = total = 1.0 / a
    for k in range(1, 2000):
        term *= x / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_cdf(x: float, d: int) -> float:
    return _gamma_share(d / 2, x / 2)


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, d) < p and hi < 1e4:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return hi


def _estimate(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, inverse covariances (upper triangles) and logarithms of their determinants, from counts, sums and sums of products."""
    mu = sums / n[:, None]
    cov = np.zeros((len(n), D, D))
    rows, cols = np.triu_indices(D)
    cov[:, rows, cols] = squares / n[:, None] - mu[:, rows] * mu[:, cols]
    cov = cov + np.triu(cov, 1).transpose(0, 2, 1)
    weight = (PRIOR_ROWS / (n + PRIOR_ROWS))[:, None, None]
    cov = (1 - weight) * scale * cov + weight * np.diag(np.square(SPREAD))
    # a covariance with more spread added is still one; directions below the floor are lifted to about it
    cov[:, range(D), range(D)] = np.maximum(cov[:, range(D), range(D)], 0) + np.square(FLOORS)
    return mu, np.linalg.inv(cov)[:, rows, cols], np.linalg.slogdet(cov)[1]


_TRI = [(i, j) for i in range(D) for j in range(i, D)]
_STATE = [f"m{i}" for i in range(D)] + [f"p{i}_{j}" for i, j in _TRI]
_XS = [f"x{i}" for i in range(D)]
_STATES = ", ".join(["group string", "start int", "size long", *(f"{k} double" for k in [*_STATE, "logdet"])])
_STARTS = ("diagonal", "squashed", "signed", "plain")


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the group's state."""
    total = F.lit(0.0)
    for i, j in _TRI:
        total = total + (1 if i == j else 2) * F.col(f"p{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.greatest(total, F.lit(0.0))


#: Groups whose states, of a few hundred bytes each and four starts, are broadcast; more are joined by a shuffle of salted keys.
BROADCAST_GROUPS = 10_000
_SALTS = 32


def _few(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _attached(rows: DataFrame, states: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Rows joined with what is known of their group, so that a group of any share of all rows is spread over tasks."""
    if few:
        return rows.join(F.broadcast(states), keys, how)
    salted = states.withColumn("__salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "__salt"], how).drop("__salt")


def _groups(rows: DataFrame, least: int, put: Callable) -> tuple[DataFrame, DataFrame]:
    """Of each language and source: the group that judges it, which is its own, or its language, or all, the first of them
    with ``least`` rows, or else all; and the groups that it helps to estimate, which is every one of those three that judges any."""
    counts = put(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "counts")
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    own, lang, every = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]")
    judging = put(counts.join(by_lang, "lang").select("lang", "source", F.when(F.col("n") >= least, own).when(F.col("whole") >= least, lang).otherwise(every).alias("group")), "groups")
    helping = counts.select("lang", "source", F.explode(F.array(own, lang, every)).alias("group")).join(judging.select("group").distinct(), "group", "left_semi")
    return judging, put(helping, "helping")


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in names], axis=1).astype(float)


def _starts(rows: DataFrame, put: Callable) -> tuple[DataFrame, bool]:
    """A state per group and start: medians, and covariances of median deviations with four kinds of correlation. And whether groups are few."""
    medians = put(rows.groupBy("group").agg(F.count("*").alias("size"), *[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in _XS]), "medians")
    few = _few(medians)
    off = put(_attached(rows, medians, ["group"], few).groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"s_{x}") for x in _XS]).join(medians, "group"), "deviations")
    wide = [F.sqrt(F.pow(1.4826 * F.col(f"s_{x}"), 2) + FLOORS[i] ** 2) for i, x in enumerate(_XS)]
    z = _attached(rows, off, ["group"], few).select("group", "size", *[F.col(f"m_{x}").alias(f"m{i}") for i, x in enumerate(_XS)], *[w.alias(f"s{i}") for i, w in enumerate(wide)], *[((F.col(x) - F.col(f"m_{x}")) / w).alias(f"z{i}") for i, (x, w) in enumerate(zip(_XS, wide))])
    length = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0))), F.lit(1e-9))
    kinds = {"squashed": lambda c: F.tanh(c), "signed": lambda c: c / length, "plain": lambda c: c}
    products = [F.sum(f(F.col(f"z{i}")) * f(F.col(f"z{j}"))).alias(f"{k}{i}_{j}") for k, f in kinds.items() for i, j in _TRI]
    summed = z.groupBy("group", "size", *[f"{c}{i}" for c in "ms" for i in range(D)]).agg(*products)

    def begin(it):
        r, c = np.triu_indices(D)
        for b in it:
            m, s, n = _columns(b, [f"m{i}" for i in range(D)]), _columns(b, [f"s{i}" for i in range(D)]), b.num_rows
            for k, kind in enumerate(_STARTS):
                corr = np.tile(np.eye(D), (n, 1, 1))
                if kind != "diagonal":
                    corr[:, r, c] = corr[:, c, r] = _columns(b, [f"{kind}{i}_{j}" for i, j in _TRI])
                    size = np.sqrt(np.maximum(np.einsum("nii->ni", corr), 1e-12))
                    corr = 0.9 * corr / (size[:, :, None] * size[:, None, :]) + 0.1 * np.eye(D)
                cov = corr * s[:, :, None] * s[:, None, :]
                values = np.concatenate([m, np.linalg.inv(cov)[:, r, c], np.linalg.slogdet(cov)[1][:, None]], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(np.full(n, k, np.int32)), b.column("size"), *(pa.array(v) for v in values.T.copy())], names=["group", "start", "size", *_STATE, "logdet"])

    return put(summed.mapInArrow(begin, _STATES), "starts"), few


def _estimated(within: DataFrame, scale: float) -> DataFrame:
    """States from the rows that are within each group's and start's cutoff."""
    sums = within.groupBy("group", "start", "size").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(_XS)], *[F.sum(F.col(_XS[i]) * F.col(_XS[j])).alias(f"q{i}_{j}") for i, j in _TRI])

    def estimate(it):
        for b in it:
            mu, inverse, logdet = _estimate(b.column("n").to_numpy().astype(float), _columns(b, [f"t{i}" for i in range(D)]), _columns(b, [f"q{i}_{j}" for i, j in _TRI]), scale)
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("start"), b.column("size"), *(pa.array(c) for c in np.concatenate([mu, inverse, logdet[:, None]], axis=1).T.copy())], names=["group", "start", "size", *_STATE, "logdet"])

    return sums.mapInArrow(estimate, _STATES)


def _step(rows: DataFrame, state: DataFrame, share: float, few: bool, put: Callable) -> DataFrame:
    """One concentration step of every group and start of ``state``: the rows up to the bin that completes ``share`` of them."""
    near = _attached(rows, state, ["group"], few).select("group", "start", "size", *_XS, F.least(F.floor(F.log2(1 + _distance()) * _PER_DOUBLING), F.lit(_BINS - 1)).alias("bin"))
    counts = near.groupBy("group", "start", "size", "bin").agg(F.count("*").alias("c"))
    so_far = F.sum("c").over(Window.partitionBy("group", "start").orderBy("bin"))
    cutoff = counts.withColumn("cum", so_far).where(F.col("cum") >= F.ceil(F.col("size") * share)).groupBy("group", "start").agg(F.min("bin").alias("cut"))
    within = _attached(near, put(cutoff, "cutoffs"), ["group", "start"], few).where("bin <= cut")
    return put(_estimated(within, share / chi2_cdf(chi2_quantile(share, D), D + 2)), "states")


def mcd_states(rows: DataFrame, share: float = 0.75, reweight: float = 0.975, least_gain: float = 1e-6) -> DataFrame:
    """group, start, size, the state columns and logdet (of the subset's covariance; after reweighting, of that of the rows within
    the ``reweight`` ellipsoid, or of 0: of the subset) of each group of ``rows`` (columns group, x0..), a written table.

    Steps go on while they lower a group's logdet by ``least_gain`` or more, so they end."""
    with temporary(rows.sparkSession) as put:
        every, few = _starts(rows, put)
        for _ in range(2):
            every = _step(rows, every, share, few, put)
        best = put(every.groupBy("group").agg(F.min_by(F.struct(*every.columns), F.struct("logdet", "start")).alias("s")).select("s.*").withColumn("open", F.lit(True)), "best")
        while not (open_ := best.where("open")).isEmpty():
            moved = _step(rows, open_.drop("open"), share, few, put)
            after = moved.select("group", F.struct(*moved.columns).alias("after"))
            gain = F.col("open") & F.coalesce(F.col("logdet") - F.col("after.logdet") > least_gain, F.lit(False))
            kept = [F.when(gain, F.col(f"after.{c}")).otherwise(F.col(c)).alias(c) for c in moved.columns if c != "group"]
            best = put(best.join(after, "group", "left").select("group", *kept, gain.alias("open")), "best")
        final = best.drop("open")
        if reweight:
            inside = _attached(rows, final, ["group"], few).where(_distance() <= chi2_quantile(reweight, D)).select("group", "start", "size", *_XS)
            final = _estimated(inside, reweight / chi2_cdf(chi2_quantile(reweight, D), D + 2))
        return stage(final, "robust-states")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, tail: float = 1e-9, least: int = 5 * D) -> DataFrame:
    """One row per row of ``docs``: id_col, STATS, base_failed, distance (squared; null where base_failed), kept.

    base_failed: fewer than 10 words, or over 20 of 100 words inside repeated windows. Other rows are kept unless their
    squared distance is beyond the chi-squared quantile of ``1 - tail``. Rows that fail the base limits are in no
    estimate. Null texts have no words; null languages and sources are groups of their own, as '' is. Groups below
    ``least`` rows (five for each dimension) are judged by all rows of their language, or where these are fewer too by all of the
    table, of whatever size. Rows with null or repeated ids are judged like all others. Texts may be of any length, an empty
    table gives no rows, and no other column of ``docs``, whatever its name, is read.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stage(stats(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed), "stats")
    base = rows.where("not base_failed")
    with temporary(docs.sparkSession) as put:
        judging, helping = _groups(base, least, put)
        measured = put(_attached(base, helping, ["lang", "source"], _few(helping)).select("group", *[x.alias(f"x{i}") for i, x in enumerate(_vector())]), "vectors")
        states = mcd_states(measured, share)
        named = stage(judging.join(states, "group"), "named-states")
    discard(states)
    vectors = rows.select("*", *[x.alias(f"x{i}") for i, x in enumerate(_vector())])
    far = F.when(~F.col("base_failed"), _distance())
    judged = _attached(vectors, named, ["lang", "source"], _few(named), "left").withColumn("distance", far)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, D), F.lit(True))
    return judged.select(F.col("id").alias(id_col), *STATS, "base_failed", "distance", kept.alias("kept"))
