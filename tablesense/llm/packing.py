"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. The plan is made from how many pieces there are of each
length, at most ``capacity`` numbers whatever the corpus: lengths are taken in descending order, and each goes into the
open sequences with the least room that still holds it. Sequences with equal room are one entry of the plan with a
count. A plan row says: pieces of this length with ranks from ``rank`` on, ``n`` of them, go to sequences from
``sequence`` on, ``each`` to a sequence, at ``offset``. Pieces then take their slots by joining on length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.shared import partitions, stage
from tablesense.llm.tokens import encoder, slices


def plan_slots(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank, n, sequence, each, offset) for a histogram of (length, count). Takes time by lengths, not counts.

    >>> plan_slots([(6, 1), (4, 2), (1, 3)], 10)
    [(6, 0, 1, 0, 1, 0), (4, 0, 1, 0, 1, 6), (4, 1, 1, 1, 1, 0), (1, 0, 3, 1, 3, 4)]
    """
    rooms: list[int] = []  # of open sequences, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, count)
    rows, sequences = [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, count))

    for length, count in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit {capacity}")
        rank = 0
        while rank < count:
            left, k = count - rank, bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:  # these sequences get as many as fit
                rows.append((length, rank, full * each, first, each, capacity - room))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:  # what is left goes into one more
                    rows.append((length, rank, left, first + full, left, capacity - room))
                    add(room - left * length, first + full, 1)
                    rank += left
                    add(room, first + full + 1, n - full - 1)
                else:
                    add(room, first + full, n - full)
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids (little-endian unsigned 32-bit): every whole text's ids (null: none) and ``end_id``,
    cut at ``capacity``. ``end_id`` makes every document one token long at least."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(it):
        codes, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in it:
            for part in slices(batch, 1):
                at, piece, start, length, ids = [], [], [], [], []
                for k, x in enumerate(codes.encode(part.column(1).to_numpy(zero_copy_only=False))):
                    x += end
                    for j, lo in enumerate(range(0, len(x), 4 * capacity)):
                        one = x[lo : lo + 4 * capacity]
                        at.append(k), piece.append(j), start.append(lo // 4), length.append(len(one) // 4), ids.append(one)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids binary")


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (columns part, row, length and others, from a written table) with sequence_id and offset.

    The rank of a piece within its length is its place among the pieces of its part, plus a prefix sum over the parts
    before: no task holds a length. The histogram has ``capacity`` rows at most, so the driver may plan on it; a plan
    has a few rows for each length.
    """
    spark = pieces.sparkSession
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = plan_slots([tuple(r) for r in counts.groupBy("length").agg(F.sum("n")).collect()], capacity)
    by_length: dict[int, list] = {}
    for length, *slot in rows:
        by_length.setdefault(length, []).append(tuple(slot))
    slot = "array<struct<first:long,n:long,sequence:long,each:long,offset:long>>"
    plan = spark.createDataFrame(list(by_length.items()), f"length long, slots {slot}")
    within = Window.partitionBy("part", "length").orderBy("row")
    # bases grow with the parts; the pieces are dealt by part and length already, so this join moves them no further
    ranked = pieces.withColumn("own", F.row_number().over(within) - 1).join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("own"))
    taken = ranked.join(F.broadcast(plan), "length").withColumn("slot", F.element_at(F.filter("slots", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["n"])), 1))
    nth = F.col("rank") - F.col("slot.first")
    return taken.withColumn("sequence_id", (F.col("slot.sequence") + F.floor(nth / F.col("slot.each"))).cast("long")).withColumn("offset", (F.col("slot.offset") + F.pmod(nth, F.col("slot.each")) * F.col("length")).cast("long")).drop("own", "base", "rank", "slots", "slot")


def written_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``cut_pieces`` as a written table, with ids_crc32, part and row: a place for each piece that doesn't change any more."""
    cut = cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    cut = cut if keep_ids else cut.drop("ids")
    return stage(cut.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pieces")


def packed_ids(placed: DataFrame, written: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each at most one capacity long."""
    whole = placed.select("part", "row", "sequence_id", "offset").join(written.select("part", "row", "ids"), ["part", "row"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return whole.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, part, row, sequence_id, offset.

    Null and empty texts are ``end_id`` alone. Rows with null or repeated ids are documents of their own. An empty
    table gives an empty result. Texts may be of any length; no other column of ``docs``, whatever its name, is read. Where the
    sequences themselves are wanted, ``packed_ids`` joins the pieces of ``place_pieces`` to those of ``written_pieces``.
    """
    written = written_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids=False)
    return place_pieces(written, capacity).withColumnRenamed("id", id_col)
