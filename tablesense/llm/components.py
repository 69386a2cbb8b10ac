"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.shared import discard, stage


def _star(edges: DataFrame, keep) -> DataFrame:
    """Links each neighbour that ``keep`` takes, of each node, to the node's least neighbour or itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return edges.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a and b, of one orderable type. Returns a written table of node, root: root is the least node of its component.

    Only nodes with a link to another node are returned. Null ends and self-links are ignored. A hub's links are
    aggregated before they are shuffled, and each round ends in a written table. Rounds go on until nothing changes, which takes of the
    order of the squared logarithm of the nodes.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a")).where("a <> b")
        own = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = own.groupBy("a").agg(F.min("b").alias("m"))
        small = own.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, stage(small.where("a <> b").distinct(), "links")
        discard(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        if state[0] == state[2] and state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = stage(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "components")
    discard(now)
    return found
