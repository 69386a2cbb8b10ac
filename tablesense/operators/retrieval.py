"""Retrieval of chunks for queries: BM25, TF-IDF, dense vectors, rank fusion, and what fits a budget.

Term indexes are postings, a row per chunk and token. Only postings of the queries' tokens are joined; statistics of the
corpus come from all of them. Chunks without a score are added for full rankings only where a fusion needs them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.functions.text import STOPWORDS, bm25_idf, cosine, index_tokens, tfidf_idf
from tablesense.sources.store import Cache, content_key, written

FIRST_STAGE, FINAL, RRF_K = 30, 6, 60
#: Scores are rounded, so that equal texts tie whatever order their parts are summed in.
DIGITS = 6


class Encoder(Protocol):
    """Vectors of texts. The default hashes token counts; a model goes in its place."""

    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, ranking: DataFrame) -> DataFrame: ...


def hashed_terms(size: int = 256) -> Callable[[Column], Column]:
    """Token counts, hashed into ``size`` places."""

    def encode(text: Column) -> Column:
        places = F.transform(index_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))

    return encode


def encoded(chunks: DataFrame, text_col: str, encoder: Encoder, name: str, folder: str) -> DataFrame:
    """``chunks`` with vector. Vectors are kept in a cache by encoder's name and text: each distinct text is encoded once, whatever runs share the
    folder; a null text counts as ''."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = chunks.withColumn("__key", content_key(F.lit(name), text))
    texts = keyed.select(F.col("__key").alias("key"), text.alias("text"))
    vectors = Cache(chunks.sparkSession, folder).get(texts, lambda new: new.select("key", encoder(F.col("text")).alias("vector")))
    return keyed.join(vectors, F.col("__key") == F.col("key")).drop("__key", "key")


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, token, tf."""
    tokens = chunks.select(id_col, F.explode(index_tokens(F.col(text_col))).alias("token"))
    return tokens.groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def counted(chunks: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """id_col, others, len, top (the most frequent term's count), terms (term, tf) of each chunk: ``index_tokens``, counted within the row,
    so that no row of a chunk and a token is shuffled."""
    types = dict(chunks.dtypes)
    kept, stop = [id_col, *others], frozenset(STOPWORDS)

    def count(batches):
        words, signs = re.compile("[a-z0-9_]{2,}").findall, re.compile("[\u4e00-\u9fff]").findall
        for batch in batches:
            terms, tfs, lengths, tops, ends = [], [], [], [], [0]
            for text in batch.column(len(kept)).to_pylist():
                found = Counter(words(text))
                if not text.isascii():
                    found.update(signs(text))
                for w in found.keys() & stop:
                    del found[w]
                terms.extend(found)
                tfs.extend(found.values())
                ends.append(len(terms))
                lengths.append(found.total())
                tops.append(max(found.values(), default=None))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lengths, pa.int32()), pa.array(tops, pa.int32()), lists], names=[*kept, "len", "top", "terms"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", len int, top int, terms array<struct<term:string,tf:int>>"
    return chunks.select(*kept, F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).mapInArrow(count, schema)


#: Rows of a table that are sent to all tasks, at most; tables beyond are joined by a shuffle.
BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows, which are counted: it should be cheap to compute."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def term_stats(posted: DataFrame) -> DataFrame:
    """token, df."""
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def chunk_term_stats(chunks: DataFrame, text_col: str) -> DataFrame:
    """token, df, from one grouped count: a chunk's tokens are made distinct in its row."""
    return chunks.select(F.explode(F.array_distinct(index_tokens(F.col(text_col)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def query_tokens(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """query_id, token: each token once."""
    return queries.select(query_id, F.explode(F.array_distinct(index_tokens(F.col(query_text)))).alias("token"))


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id_col, score of all chunks that share a token with a query."""
    rows = written(counted(chunks, id_col, text_col), "term-counts")
    corpus = rows.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    wanted = written(query_tokens(queries, query_id, query_text), "query-tokens")
    terms = small(wanted.select("token").distinct())
    df = term_stats(rows.select(F.explode("terms.term").alias("token")).join(terms, "token", "left_semi"))
    asked = written(wanted.join(df, "token").crossJoin(F.broadcast(corpus)), "query-terms")
    # a chunk's terms stay in its task, so that sums over them need no shuffle
    each = rows.repartition(id_col).select(id_col, "len", F.explode("terms").alias("t")).select(id_col, "len", F.col("t.term").alias("token"), F.col("t.tf").alias("tf"))
    hits = each.join(small(asked), "token")
    norm = 1 - b + b * F.greatest(F.col("len"), F.lit(1)) / F.col("avg_len")
    part = bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return hits.groupBy(query_id, id_col).agg(F.round(F.sum(part), DIGITS).alias("score"))


def tfidf(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> DataFrame:
    """query_id, id_col, score: cosine of weights tf / max tf times idf, for all chunks that share a token with a query."""
    posted = postings(chunks, id_col, text_col)
    asked = queries.select(query_id, F.explode(index_tokens(F.col(query_text))).alias("token")).groupBy(query_id, "token").agg(F.count("*").alias("tf"))
    n = chunks.agg(F.count("*").alias("n"))
    df = term_stats(posted).crossJoin(F.broadcast(n)).select("token", tfidf_idf(F.col("n"), F.col("df")).alias("idf"))
    unseen = asked.select("token").distinct().crossJoin(F.broadcast(n)).join(df, "token", "left").select("token", F.coalesce("idf", tfidf_idf(F.col("n"), F.lit(0))).alias("idf"))

    def weights(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
        top = rows.groupBy(key).agg(F.max("tf").alias("top"))
        return rows.join(top, key).join(idf, "token").select(key, "token", (F.col("tf") / F.col("top") * F.col("idf")).alias("w"))

    w, q = weights(posted, id_col, df), weights(asked, query_id, unseen)
    length = lambda rows, key: rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"norm_{key}"))
    dots = w.select(id_col, "token", F.col("w").alias("a")).join(q.select(query_id, "token", F.col("w").alias("b")), "token").groupBy(query_id, id_col).agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    joined = dots.join(length(w, id_col), id_col).join(length(q, query_id), query_id)
    return joined.select(query_id, id_col, F.round(F.coalesce(F.try_divide("dot", F.col(f"norm_{id_col}") * F.col(f"norm_{query_id}")), F.lit(0.0)), DIGITS).alias("score"))


def dense(items: DataFrame, queries: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str) -> DataFrame:
    """query_id, id_col, score: cosines of each of a few queries with every item. The queries are broadcast if they are small,
    which Spark checks; each item's vector stays where it is."""
    q = queries.select(query_id, F.col(query_vector).alias("__q"))
    return items.select(id_col, F.col(vector).alias("__v")).join(q, F.lit(True), "inner").select(query_id, id_col, cosine(F.col("__q"), F.col("__v")).alias("score"))


def top_k(scores: DataFrame, query_id: str, id_col: str, k: int = FIRST_STAGE) -> DataFrame:
    """With rank, from 1; ties by id."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


#: Rows of a block; what is held at once is a pair of blocks.
_ITEMS, _QUERIES = 1024, 512


def _blocks(rows: DataFrame, id_col: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Blocks of up to ``size`` rows: their ids, the width and, as bytes of doubles, their vectors at length 1 and padded with zeros."""
    kind = rows.schema[id_col].dataType.simpleString()

    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                vectors = [np.array([v or 0.0 for v in x or ()], dtype=np.float64) for x in batch.column(1).to_pylist()]
                matrix = np.zeros((len(vectors), max(map(len, vectors))))
                for row, v in zip(matrix, vectors, strict=True):
                    row[: len(v)] = v
                norms = np.sqrt((matrix * matrix).sum(axis=1))[:, None]
                unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms != 0)
                ids = pa.ListArray.from_arrays([0, batch.num_rows], pa.concat_arrays([batch.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.shape[1]]), pa.array([unit.tobytes()])], names=[f"{prefix}_ids", f"{prefix}_width", f"{prefix}_unit"])

    return rows.select(id_col, F.col(vector).cast("array<double>")).mapInArrow(pack, f"{prefix}_ids array<{kind}>, {prefix}_width long, {prefix}_unit binary")


def nearest(items: DataFrame, queries: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str, k: int = FINAL) -> DataFrame:
    """query_id, id_col, score (cosine, rounded), rank: the ``k`` best items of each of many queries; ties by id, of a plain type.

    Every query is scored with every item, a block of queries with a block of items by one product of matrices; only a
    block's best ``k`` leave it. Null and zero vectors score 0, and null elements count as 0."""
    kinds = queries.schema[query_id].dataType.simpleString(), items.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                wanted, ids = batch.column("q_ids")[n].values, batch.column("i_ids")[n].values
                q, x = (np.frombuffer(batch.column(f"{p}_unit")[n].as_py()).reshape(len(of), -1) for p, of in (("q", wanted), ("i", ids)))
                order, width = pc.array_sort_indices(ids, null_placement="at_start").to_numpy(), min(q.shape[1], x.shape[1])
                cosines = q[:, :width] @ x[order, :width].T
                whole = np.rint(np.where(np.isnan(cosines), 2.0, cosines) * 10**DIGITS).astype(np.int64)
                keys = whole * len(ids) - np.arange(len(ids))  # all different: best score first, then least id
                top = np.argpartition(-keys, min(k, len(ids)) - 1, axis=1)[:, :k]
                scores = np.take_along_axis(whole, top, axis=1) / 10**DIGITS
                scores = np.where(scores > 1.5, np.nan, scores)
                taken = pa.array(np.repeat(np.arange(len(wanted)), top.shape[1]))
                yield pa.RecordBatch.from_arrays([wanted.take(taken), ids.take(pa.array(order[top].ravel())), pa.array(scores.ravel())], names=["q", "i", "score"])

    spread = _blocks(items, id_col, vector, _ITEMS, "i").repartition(items.sparkSession.sparkContext.defaultParallelism)
    asked = written(_blocks(queries, query_id, query_vector, _QUERIES, "q"), "query-blocks")  # not again for every part of the items
    pairs = spread.crossJoin(asked)
    best = pairs.mapInArrow(score, f"q {kinds[0]}, i {kinds[1]}, score double")
    return top_k(best.select(F.col("q").alias(query_id), F.col("i").alias(id_col), "score"), query_id, id_col, k)


def fuse(rankings: list[DataFrame], query_id: str, id_col: str, k: int = RRF_K) -> DataFrame:
    """query_id, id_col, score: reciprocal ranks, summed over the rankings (columns query_id, id_col, rank)."""
    all_ = reduce(DataFrame.unionByName, [r.select(query_id, id_col, "rank") for r in rankings])
    return all_.groupBy(query_id, id_col).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def within_budget(ranking: DataFrame, query_id: str, rank: str, size: Column, budget: int) -> DataFrame:
    """The first of each ranking as long as their sizes sum to the budget at most; the very first always."""
    so_far = F.sum(size).over(Window.partitionBy(query_id).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranking.withColumn("used", so_far).where((F.col(rank) == 1) | (F.col("used") <= budget))


def _asked(queries: DataFrame, query_id: str, query_text: str, expand: Callable[[DataFrame], DataFrame] | None, most: int) -> DataFrame:
    """``queries`` with variants: the question itself first, then what ``expand`` makes of it, each text once and ``most`` of them at most. An
    ``expand`` that can't be applied leaves questions as they are."""
    own = queries.select(query_id, query_text, F.lit(0).alias("__made"))
    asked = own
    if expand:
        try:
            asked = own.unionByName(expand(queries).select(query_id, query_text, F.lit(1).alias("__made")))
        except Exception:  # noqa: BLE001
            asked = own
    texts = asked.where(F.col(query_text).isNotNull()).groupBy(query_id, query_text).agg(F.min("__made").alias("__made"))
    variant = F.row_number().over(Window.partitionBy(query_id).orderBy("__made", query_text))
    numbered = texts.withColumn("__variant", variant).where(F.col("__variant") <= most)
    return numbered.select(query_id, query_text, F.count("*").over(Window.partitionBy(query_id)).alias("__variants"), F.struct(query_id, "__variant").alias("__ask"))


def retrieve(chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, expand: Callable[[DataFrame], DataFrame] | None = None, rerank: Reranker | None = None, encoder: Encoder | None = None, first: int = FIRST_STAGE, final: int = FINAL, budget: int = 12_000, variants: int = 5) -> DataFrame:
    """Expansion, retrieval, fusion, reranking and cut to a budget: query_id, id_col, score, rank, used.

    ``expand`` may give further texts for a query, of which there are ``variants`` at most; a query that has one text keeps its raw scores, the
    rankings of several are fused. With an ``encoder`` dense ranks are fused with BM25's for each text before. A ``rerank`` that can't be
    applied, or changes how many candidates there are, leaves the order of the first stage."""
    asked = _asked(queries, query_id, query_text, expand, variants)
    scores = bm25(chunks, asked, id_col, text_col, "__ask", query_text)
    if encoder:
        vectors, wanted = chunks.withColumn("__v", encoder(F.col(text_col))), asked.withColumn("__w", encoder(F.col(query_text)))
        both = [top_k(s, "__ask", id_col, first) for s in (scores, dense(vectors, wanted, id_col, "__v", "__ask", "__w"))]
        scores = fuse(both, "__ask", id_col)
    ranked = top_k(scores, "__ask", id_col, first).join(asked.select("__ask", "__variants"), "__ask").withColumn(query_id, F.col(f"__ask.{query_id}"))
    several = fuse([ranked.where("__variants > 1")], query_id, id_col)
    best = top_k(ranked.where("__variants = 1").select(query_id, id_col, "score").unionByName(several), query_id, id_col, first)
    final_rank = top_k(_reranked(best, rerank, query_id).drop("rank"), query_id, id_col, final)
    sized = final_rank.join(chunks.select(id_col, F.char_length(text_col).alias("__size")), id_col)
    return within_budget(sized, query_id, "rank", F.col("__size"), budget).select(query_id, id_col, "score", "rank", "used")


def _reranked(best: DataFrame, rerank: Reranker | None, query_id: str) -> DataFrame:
    if not rerank:
        return best
    try:
        other = rerank(best).select(*best.columns)
    except Exception:  # noqa: BLE001
        return best
    sides = other.withColumn("__new", F.lit(1)).unionByName(best.withColumn("__new", F.lit(0)))
    new = F.col("__new") == 1
    whole = F.count_if(new).over(Window.partitionBy(query_id)) == F.count_if(~new).over(Window.partitionBy(query_id))
    return sides.withColumn("__whole", whole).where(F.col("__whole") == new).drop("__new", "__whole")
