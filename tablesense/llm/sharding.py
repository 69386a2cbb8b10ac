"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard draws a number in (0, 1) from the record's key and its own number; the record goes to the shard with the
largest ``-weight / ln(number)``. A shard's share is its weight over all weights. Numbers of other shards don't depend
on how many shards there are, so one more shard takes rows into itself and moves no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.shared import partitions, stage


def _draw(key: Column, shard: int) -> Column:
    """In (0, 1), from 52 bits of an MD5 of key and shard."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key. Null keys go together, as the key '' does; the larger shard number wins a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("there must be a shard, and weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((-float(w) / F.ln(_draw(key, j))).alias("score"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 (null: of no
    bytes), shard, slot and grown_shard (null unless ``grown`` has the weights of a larger set of shards).

    slot numbers a shard's rows from 0 without gaps in ascending order of id, null ids first; rows of equal ids follow
    their CRC and size. Repeated rows get slots of their own. Rows are range-sorted once with ties split, and a
    partition's first slot in a shard is a prefix sum of counts: no task holds a shard. An empty table gives no rows. Texts may be
    of any length; other columns, whatever their names, aren't read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": rendezvous_shard(F.col("id"), weights), "grown_shard": rendezvous_shard(F.col("id"), grown) if grown else F.lit(None).cast("int"), "tie": F.monotonically_increasing_id()})
    order = ["id", "text_crc32", "size", "tie"]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order)
    placed = stage(dealt.withColumn("part", F.spark_partition_id()), "sharded")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy(*order)
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(bases, ["shard", "part"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).alias("slot"), "grown_shard")
