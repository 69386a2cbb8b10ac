"""The trie of conversations' prefixes.

A prefix of a conversation is known by a digest: 128 bits of a sum over its turns, each hashed with its place. The conversation of
least id among those that begin with a prefix owns it. Ids only grow along a conversation's prefixes, so what a
conversation owns are its last prefixes, from one depth on, and that depth is found by binary search: in each round every
conversation asks the table of owned prefixes about one depth, by a join on its own id and that depth, which no two ask alike.
What a conversation owns is a chain of nodes; it hangs on the node before its first. The chains form a tree, over which sums go
bottom-up, chains without open children first.

Turns are hashed where they are read; only digests are shuffled. Running sums are taken over ranges of rows, so that one
conversation may have any share of all turns, and a prefix may begin any share of all conversations.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.running import running_sums
from tablesense.llm.shared import delete, discard, new_folder, partitions, stage

#: Halves of a digest, each held as two sums of 32-bit numbers, which 2^31 turns don't carry over 63 bits.
_LANES = ("d0", "d1", "d2", "d3")
_BLOCK = 1 << 16


def crc_of_id(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary"))


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, i (place from 1, by turn, null first), content (128 bits of a SHA-256 of role and text) and chars, as a written table.

    Null roles and texts are empty. Turns of one number go by their content's digest; repeated rows are turns of their own. Rows
    without a conversation's id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), content.alias("content"), F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("i"))
    return running_sums(rows, "conv", [F.col("turn").asc_nulls_first(), "content"], ["i"], "turns").select("conv", "i", "content", "chars")


def branched(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that go on from another's beginning: the first ``taken`` turns (``most`` at most) of conversation ``base``, all of
    them if it has fewer and none if it isn't there, and then the own turns after the first ``taken``. ``base`` and ``taken`` are
    columns of conv. Returns (conv, size) of every conversation of ``turns``, and (conv, depth, content, chars), depth from 1."""
    own = turns.groupBy("conv").agg(F.max("i").alias("own"))
    convs = own.select("conv", "own", base.alias("base"), taken.cast("long").alias("taken"))
    heads = turns.where(F.col("i") <= most).select(F.col("conv").alias("base"), "i", "content", "chars")
    has = heads.groupBy("base").agg(F.max("i").alias("has"))  # of no more than ``most`` interest
    known = convs.join(has, "base", "left").withColumn("lead", F.least("taken", F.coalesce("has", F.lit(0))))
    known = stage(known.select("conv", "own", "base", "taken", "lead"), "branches")
    first = known.join(heads, "base").where(F.col("i") <= F.col("lead")).select("conv", F.col("i").alias("depth"), "content", "chars")
    rest = turns.join(known.select("conv", "taken", "lead"), "conv").where(F.col("i") > F.col("taken")).select("conv", (F.col("i") - F.col("taken") + F.col("lead")).alias("depth"), "content", "chars")
    sizes = known.select("conv", (F.col("lead") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("size"))
    return sizes, first.unionByName(rest)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, depth (from 0), a, b (the digest of the first ``depth`` turns), chars (of the last of them), as a written table."""
    bits = F.sha2(F.concat(F.col("content"), F.col("depth").cast("string").cast("binary")), 256)
    lanes = [F.conv(F.substring(bits, 8 * k + 1, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(_LANES)]
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), *[F.lit(0).cast("long").alias(c) for c in _LANES])
    summed = running_sums(root.unionByName(turns.select("conv", "depth", "chars", *lanes)), "conv", ["depth"], _LANES, "prefixes")
    low = F.lit(0xFFFFFFFF).cast("long")
    half = lambda hi, lo: F.shiftleft(F.col(hi).bitwiseAND(low), 32).bitwiseOR(F.col(lo).bitwiseAND(low))
    return summed.select("conv", "depth", half("d0", "d1").alias("a"), half("d2", "d3").alias("b"), "chars")


def owned_from(convs: DataFrame, owned: DataFrame, deepest: int) -> DataFrame:
    """``convs`` (conv, size) with start: the first depth that a conversation owns, size + 1 if none, by binary search in
    ``owned`` (conv, depth: a row per prefix, with the least conversation that begins with it)."""
    asked = convs.select("conv", "size", F.lit(0).cast("long").alias("lo"), (F.col("size") + 1).alias("hi"))
    minima = owned.select(F.col("conv").alias("__conv"), F.col("depth").alias("__depth"))
    for _ in range((deepest + 1).bit_length()):
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        asked = asked.withColumn("mid", middle)
        found = asked.join(minima, (F.col("conv") == F.col("__conv")) & (F.col("mid") == F.col("__depth")), "left")
        yes, still = F.col("__conv").isNotNull(), F.col("lo") < F.col("hi")
        asked = found.select("conv", "size", F.when(still & ~yes, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"), F.when(still & yes, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return asked.select("conv", "size", F.col("lo").alias("start"))


def _summed_up(chains: DataFrame) -> tuple[DataFrame, list[str]]:
    """A table and the folders that it needs: at_conv, at_depth, leaves, saved of every chain's whole subtree; chains: conv, at_conv, at_depth, leaves, saved (their own).
    Rounds: chains with no open child are done and added to those they hang on; there are as many as the tree of chains is high."""
    spark, folders = chains.sparkSession, []

    def put(df: DataFrame, name: str) -> DataFrame:
        folders.append(new_folder(spark, name))
        return stage(df, name, folders[-1])

    waiting = chains.where("at_conv is not null").groupBy(F.col("at_conv").alias("conv")).agg(F.count("*").alias("waiting"))
    still = put(chains.join(waiting, "conv", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))), "open-chains")
    done = []
    while not still.isEmpty():
        ready = still.where("waiting = 0")
        done.append(ready.select("at_conv", "at_depth", "leaves", "saved"))
        sums = ready.where("at_conv is not null").groupBy(F.col("at_conv").alias("conv")).agg(F.count("*").alias("ended"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = still.where("waiting > 0").join(sums, "conv", "left")
        plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
        still = put(rest.select("conv", "at_conv", "at_depth", plus("leaves", "more_leaves").alias("leaves"), plus("saved", "more_saved").alias("saved"), (F.col("waiting") - F.coalesce("ended", F.lit(0))).alias("waiting")), "open-chains")
    out = reduce(DataFrame.unionByName, done)
    return put(out, "chains"), folders


def end_digests(ends: DataFrame) -> DataFrame:
    """conv, depth, digest: the SHA-256, in hex, of the ids in ``member`` of each (conv, depth), ascending and joined by commas.

    Ids are sorted in ranges and written out in blocks of text, so that a group of any size is split up; a node's blocks then go
    through the hash in order, one at a time, as its definition wants.
    """
    by = ["conv", "depth", "member"]
    dealt = ends.select(*by).repartitionByRange(partitions(ends.sparkSession), *by).sortWithinPartitions(*by)

    def write(it):
        node, first, parts, size = None, None, [], 0
        rows = ([], [], [], [])

        def block():
            for column, value in zip(rows, (*node, first, ",".join(parts)), strict=True):
                column.append(value)

        def batch():
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())], names=["conv", "depth", "first", "ids"])
            for c in rows:
                c.clear()
            return out

        for b in it:
            for *at, member in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != node or size > _BLOCK:
                    if node is not None:
                        block()
                    node, first, parts, size = at, member, [], 0
                parts.append(str(member))
                size += len(parts[-1]) + 1
            if len(rows[0]) > 1000:
                yield batch()
        if node is not None:
            block()
            yield batch()

    blocks = dealt.mapInArrow(write, "conv long, depth long, first long, ids string")

    def digest(it):
        node, h, rows = None, None, ([], [], [])
        for b in it:
            for *at, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if at != node:
                    if node is not None:
                        for column, value in zip(rows, (*node, h.hexdigest()), strict=True):
                            column.append(value)
                    node, h = at, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _digests(rows)
        if node is not None:
            for column, value in zip(rows, (*node, h.hexdigest()), strict=True):
                column.append(value)
            yield _digests(rows)

    return blocks.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(digest, "conv long, depth long, digest string")


def _digests(rows: tuple[list, list, list]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["conv", "depth", "digest"])
    for c in rows:
        c.clear()
    return out


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations: conv_id (the least that begins with it), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the code points of a node's last
    text) and ends_sha256 (of the ids of conversations that end there).

    ``convs`` has every conversation once, as (conv, size), those without turns too; ``turns`` has (conv, depth, content, chars), depth
    1 to size. Without conversations there are no rows, not even the root's.
    """
    convs = stage(convs, "conversations")
    every = stage(prefixes(convs, turns), "prefixes")
    owned = stage(every.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "owned")
    deepest = convs.agg(F.max("size")).first()[0]
    if deepest is None:
        return owned.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), "n_convs", F.col("n_convs").alias("n_children"), F.col("n_convs").alias("n_leaves"), F.col("n_convs").alias("saved_tokens"), F.lit("").alias("ends_sha256"))
    searched = stage(owned_from(convs, owned, deepest), "searched")

    # the node before a conversation's first own one, and who owns it
    last = every.join(searched.where("start > 0").select("conv", (F.col("start") - 1).alias("depth")), ["conv", "depth"]).select("conv", F.col("depth").alias("at_depth"), "a", "b")
    hung = last.join(owned.select("a", "b", F.col("depth").alias("at_depth"), F.col("conv").alias("at_conv")), ["a", "b", "at_depth"])
    placed = stage(searched.join(hung.select("conv", "at_conv", "at_depth"), "conv", "left"), "placed")

    # chains, bottom-up
    chain = placed.where("start <= size")
    hangs = chain.where("at_conv is not null").groupBy("at_conv", "at_depth").agg(F.count("*").alias("hanging"))
    own_saved = owned.groupBy("conv").agg(F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    at_end = hangs.select(F.col("at_conv").alias("conv"), F.col("at_depth").alias("size"), "hanging")
    own = chain.join(own_saved, "conv").join(at_end, ["conv", "size"], "left").select("conv", "at_conv", "at_depth", F.col("hanging").isNull().cast("long").alias("leaves"), "saved")
    totals, folders = _summed_up(own)
    below = totals.where("at_conv is not null").groupBy(F.col("at_conv").alias("conv"), F.col("at_depth").alias("depth")).agg(F.count("*").alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    # nodes: what hangs on them, and sums from a chain's end upwards
    nodes = owned.join(placed.select("conv", "size", "start", "at_conv"), "conv").join(below, ["conv", "depth"], "left")
    hanging = F.coalesce("hanging", F.lit(0))
    is_last = F.col("depth") == F.col("size")
    nodes = nodes.select(
        "conv", "depth", "n_convs", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("start"), F.col("at_conv")).otherwise(F.col("conv")).alias("parent"),
        (hanging + (~is_last).cast("long")).alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + (is_last & (hanging == 0)).cast("long")).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    summed = running_sums(nodes, "conv", [F.col("depth").desc()], ["n_leaves", "saved_tokens"], "nodes")
    ends = end_digests(placed.select(F.when(F.col("start") <= F.col("size"), F.col("conv")).otherwise(F.col("at_conv")).alias("conv"), F.col("size").alias("depth"), F.col("conv").alias("member")))
    done = summed.join(ends, ["conv", "depth"], "left")
    result = stage(done.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "trie")
    discard(convs, every, owned, searched, placed)
    delete(result.sparkSession, *folders)
    return result
