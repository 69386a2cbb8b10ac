"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows of consecutive words are the sets to contain; their elements are shingles of up to three words, with
their places. Shingles are ordered by rarity: by how often the whole corpus has them. For full containment one element
is the necessary prefix, the rarest, so a window is looked for where its rarest shingle is. The place of that shingle
bounds where the window begins and ends, within its text. A candidate is verified by all the window's shingles standing at their places;
shingles are compared as strings, so no hash decides. Only the occurrences of the items' own shingles ever leave the
scan, as three numbers each, and texts are never shuffled. Equal texts are one text until the last join.

The items' distinct shingles go to every executor if their measured size is within ``broadcast_bytes``; beyond it, the
shingles of the texts are joined to them by a shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.shared import stage, text_key

#: Characters between words, once A-Z are lower-cased: the ASCII characters that are neither digits nor letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that a broadcast row takes besides its shingle: row header, two numbers and its place in the hash table.
_ROW_BYTES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, of which only A-Z are lower-cased; null: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _shingles(w: Column, size: int) -> Column:
    """pos, shingle of the runs of ``size`` words joined by spaces, which no word has; those of the last ``size - 1`` are null."""

    def at(word: Column, i: Column) -> Column:
        rest = [x for k in range(1, size) for x in (F.lit(" "), F.get(w, i + k))]
        return F.struct(i.alias("pos"), (F.concat(word, *rest) if rest else word).alias("shingle"))

    return F.transform(w, at)


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """wid, n, w, items: the distinct windows, and which items have them. Items without words have none."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice(F.col("w"), i, n))).alias("w"))
    return each.groupBy("w").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("wid"), F.size("w").alias("n"), "w", "items")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """What ``contamination`` returns, with the key of the text as ``__content``."""
    # what is staged here stays, for the result reads it; all of it is narrow
    windows = stage(item_windows(benchmark, window, item_col, item_text_col), "windows")
    width = F.least("n", F.lit(shingle))
    parts = stage(
        windows.select("wid", "n", width.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: F.array_join(F.slice("w", i, width), " "))).alias("at", "shingle")),
        "window-shingles",
    )
    known = stage(parts.select("size", "shingle").distinct().withColumn("sid", F.monotonically_increasing_id()), "shingles")
    measured = known.groupBy("size").agg(F.sum(F.octet_length("shingle") + _ROW_BYTES).alias("bytes")).orderBy("size").collect()  # up to ``shingle`` rows
    sizes = [r["size"] for r in measured]

    nothing = F.array().cast("array<string>")
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("content"), words(F.col(text_col)).alias("w"))
    texts = texts.select("id", "content", "w", F.size("w").cast("long").alias("n_words"))  # before the words are exploded, so that no row carries all of them
    if not sizes:
        return texts.select(F.col("content").alias("__content"), F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), nothing.alias("items"))
    shingles = [_shingles(F.col("w"), n) for n in sizes]
    wanted = known.select("shingle", "sid")
    if sum(r["bytes"] for r in measured) <= broadcast_bytes:
        # one pass over the texts, which no row leaves: a row for the document itself, by a shingle that no text has, and one for each shingle that the items have
        document = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("shingle")))
        each = texts.select("id", "content", "n_words", F.explode(F.concat(document, *shingles)).alias("e")).select("id", "content", "n_words", "e.*")
        wanted = F.broadcast(wanted.union(docs.sparkSession.range(1).select(F.lit("").alias("shingle"), F.lit(-1).cast("long").alias("sid"))))
        met = stage(each.join(wanted, "shingle").select(F.when(F.col("sid") < 0, F.col("id")).alias("id"), "content", "n_words", "pos", "sid"), "occurrences")
        rows = met.where("sid < 0").select("id", "content", "n_words")
    else:  # rows of documents come from a pass of their own: in the join, all of them would have one key
        rows = stage(texts.select("id", "content", "n_words"), "words")
        each = texts.select("content", F.explode(F.concat(*shingles)).alias("e")).select("content", "e.*").where("shingle is not null")
        met = stage(each.join(wanted, "shingle").select("content", "pos", "sid"), "occurrences")
    found = stage(met.where("sid >= 0").select("content", "pos", "sid").distinct(), "found")

    counts = found.groupBy("sid").agg(F.count("*").alias("often"))
    elements = stage(parts.join(known, ["size", "shingle"]).join(counts, "sid", "left").select("wid", "n", "at", "sid", F.coalesce("often", F.lit(0)).alias("often")), "elements")
    rarest = Window.partitionBy("wid").orderBy("often", "sid", "at")
    prefix = elements.withColumn("nth", F.row_number().over(rarest)).where("nth = 1 and often > 0").select("wid", "sid", F.col("at").alias("before"))
    begins = found.join(prefix, "sid").select("content", "wid", (F.col("pos") - F.col("before")).alias("begin")).where("begin >= 0")
    expected = begins.join(elements.select("wid", "n", "at", "sid"), "wid").select("content", "wid", "begin", "n", (F.col("begin") + F.col("at")).alias("pos"), "sid")
    whole = windows.select("wid", "items", (F.col("n") - F.least("n", F.lit(shingle)) + 1).alias("all"))
    verified = expected.join(found, ["content", "pos", "sid"]).groupBy("content", "wid", "begin", "n").agg(F.count("*").alias("there")).join(whole, "wid").where("there = all")

    spans = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("begin", "n")), lambda s: F.sequence(s["begin"], s["begin"] + s["n"] - 1))))
    hits = verified.groupBy("content").agg(F.size(spans).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows.join(hits, "content", "left").select(F.col("content").alias("__content"), F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", nothing).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_hit (words inside an occurrence of a window), items (sorted array
    of the ids, as strings, of items with occurring windows).

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window. Null texts have
    no words. Rows with null or repeated ids are judged like all others; an item without an id counts as ''; items of
    equal text are all named. Empty tables give no rows or no hits. Texts may be of any length; other columns of either table,
    whatever their names, are not read.
    """
    return _judged(docs, benchmark, window, shingle, id_col, text_col, item_col, item_text_col, broadcast_bytes).drop("__content")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that have a word inside a window of an item. All columns stay as they are. Each row is
    judged by its own text, whatever other rows of its id, or without an id, have. An empty table stays empty."""
    bad = _judged(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select(F.col(id_col).alias("__bad"), "__content").distinct()
    return docs.join(bad, (F.col("__content") == text_key(docs[text_col])) & F.col("__bad").eqNullSafe(docs[id_col]), "left_anti")
