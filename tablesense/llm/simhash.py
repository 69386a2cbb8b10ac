"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. Two fingerprints that differ at 4 bits or fewer have a segment
that differs at one bit or none, for 3 segments with two differing bits each would make 6. Every segment is indexed
under each of its variants with one bit taken out; two segments that differ at one bit at most share a variant.
An equality join of the 64 variants brings candidates together, and the bit count of the whole XOR verifies them.

The index holds distinct fingerprints, so a group of copies is one entry, and buckets are reduced to stars around hubs
before pairs are looked for. Links are reduced to a component per
fingerprint by distributed star contraction, and rows get their component by joining on the fingerprint.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.components import connected_components
from tablesense.llm.shared import discard, partitions, stage, temporary, text_key

SEGMENTS = ((0, 22), (22, 21), (43, 21))
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint as an unsigned integer. No words (null, empty, blank): 0. Fewer words than ``shingle``: one shingle of all."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    counts, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    first, last = (starts, ends[shingle - 1 :]) if len(words) >= shingle else ([0], [len(joined)])
    for lo in range(0, len(last), _BLOCK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(first[lo : lo + _BLOCK], last[lo : lo + _BLOCK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id, fp: the fingerprint of every whole text, as a signed long. No other column of ``docs`` is read."""

    def batches(it):
        for b in it:
            texts = b.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False)
            fp = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: which bit is taken out, and what is left of that bit's segment."""
    keys = []
    for start, width in SEGMENTS:
        for bit in range(start, start + width):
            mask = ((1 << width) - 1) << start & ~(1 << bit)
            left = F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), start)
            keys.append(left.bitwiseOR(F.lit(bit << 24).cast("long")))
    return F.array(*keys)


def _meeting_bit(differing: Column) -> Column:
    """The taken-out bit of the first variant that two fingerprints share: so each pair is found once."""
    first = F.lit(None).cast("long")
    for start, width in reversed(SEGMENTS):
        part = F.shiftrightunsigned(differing, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        first = F.when(F.bit_count(part) <= 1, F.when(part == 0, F.lit(start)).otherwise(start + F.bit_count(part - 1)).cast("long")).otherwise(first)
    return first


#: A bucket in which more pairs than this for each member would be compared is divided first.
PAIRS_A_MEMBER = 256


def _chunks(segment: tuple[int, int], distance: int) -> list[int]:
    """Masks of ``distance + 2`` runs of bits that the two other segments are cut into: two fingerprints within ``distance`` bits have two
    runs alike at least."""
    others = [bit for start, width in SEGMENTS if (start, width) != segment for bit in range(start, start + width)]
    cuts = np.array_split(others, distance + 2)
    return [sum(1 << int(b) for b in cut) for cut in cuts]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _codes(fp: Column, key: Column, distance: int) -> Column:
    """Of a fingerprint in a bucket: (which two runs of bits, those bits) for every two runs."""
    out = None
    for start, width in SEGMENTS:
        runs = _chunks((start, width), distance)
        pairs = F.array(*[F.struct(F.lit(i * 16 + j).alias("runs"), fp.bitwiseAND(_signed(runs[i] | runs[j])).alias("bits")) for i in range(len(runs)) for j in range(i + 1, len(runs))])
        own = F.shiftrightunsigned(key, 24).between(start, start + width - 1)
        out = F.when(own, pairs) if out is None else out.when(own, pairs)
    return out


def _first_runs(differing: Column, key: Column, distance: int) -> Column:
    """The first two runs that are alike, by which a pair is found once."""
    out = None
    for start, width in SEGMENTS:
        alike = F.filter(F.array(*[F.when(differing.bitwiseAND(_signed(m)) == 0, F.lit(i)) for i, m in enumerate(_chunks((start, width), distance))]), lambda x: x.isNotNull())
        own = F.shiftrightunsigned(key, 24).between(start, start + width - 1)
        first = F.get(alike, F.lit(0)) * 16 + F.get(alike, F.lit(1))
        out = F.when(own, first) if out is None else out.when(own, first)
    return out


def near_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """a, b (a < b), a written table: links between distinct ``fp`` within ``distance`` bits (up to 5, the bound of the variants).

    Not all pairs: those that a bucket's hub stands between are left out. The hub of a bucket is the member with the most
    copies (column n, where there is one). Members within ``distance`` of it get a link to it, and pairs are looked for only where one
    member isn't. So the components are those of all pairs, but a dense group of distinct fingerprints is a star. A bucket where
    that would still be more than ``PAIRS_A_MEMBER`` pairs for each member, such as of pages of one template whose texts are otherwise
    unlike, is divided by two more runs of bits, of which two members within ``distance`` have some in common.
    """
    if not 0 <= distance <= 2 * len(SEGMENTS) - 1:
        raise ValueError(f"three segments with one-bit variants find up to {2 * len(SEGMENTS) - 1} differing bits")
    spark = prints.sparkSession
    copies = F.col("n") if "n" in prints.columns else F.lit(1)
    # every fingerprint becomes 64 rows, which the planner doesn't count: no join reads the index itself
    spread = prints.select("fp", copies.alias("n")).repartition(partitions(spark), "fp")
    index = spread.select("fp", "n", F.explode(_variants(F.col("fp"))).alias("key"))
    # a bucket has each fingerprint once, and its rows are sorted, with spills, never held
    bucket = Window.partitionBy("key")
    members = index.select("key", "fp", F.count("*").over(bucket).alias("members"), F.max_by("fp", F.struct("n", "fp")).over(bucket).alias("hub"))
    with temporary(spark) as put:
        beside = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= distance
        counted = members.where("members > 1").select("key", "fp", "hub", "members", beside.alias("beside")).withColumn("apart", F.count_if(~F.col("beside")).over(bucket))
        many = F.col("apart") * F.col("members") > PAIRS_A_MEMBER * (F.col("apart") + F.col("members"))
        met = put(counted.select("key", "fp", "hub", "beside", many.alias("many")), "met")
        differing = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
        once = F.col("y.beside") | (F.col("x.fp") < F.col("y.fp"))
        near = (F.col("x.key") == F.col("y.key")) & once & (F.bit_count(differing) <= distance) & (F.shiftrightunsigned("x.key", 24) == _meeting_bit(differing))

        def paired(rows: DataFrame, more: Column | None = None, *columns: str) -> DataFrame:
            x, y = rows.where("not beside").select("key", "fp", *columns).alias("x"), rows.select("key", "fp", "beside", *columns).alias("y")
            return x.hint("merge").join(y.hint("merge"), near if more is None else near & more).select(F.col("x.fp").alias("p"), F.col("y.fp").alias("q"))

        pairs = paired(met.where("not many"))
        if not met.where("many").isEmpty():
            spread_out = met.where("many").repartition(partitions(spark), "fp")
            divided = put(spread_out.select("key", "fp", "beside", F.explode(_codes(F.col("fp"), F.col("key"), distance)).alias("c")).select("key", "fp", "beside", "c.runs", "c.bits"), "divided")
            same = (F.col("x.runs") == F.col("y.runs")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.runs") == _first_runs(differing, F.col("x.key"), distance))
            pairs = pairs.union(paired(divided, same, "runs", "bits"))
        links = pairs.union(met.where("beside and fp <> hub").select("fp", "hub"))
        return stage(links.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: id_col, fp (signed long), component_id (least id reachable over links, itself included).

    Null and blank texts have fingerprint 0 and are linked like any other. A row with a null id belongs to its
    fingerprint's component but never names it; a component of null ids only has a null component_id. Repeated rows
    come back as often as they came. An empty table gives an empty result. Texts may be of any length; other columns of
    ``docs``, whatever their names, are not read.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    with temporary(docs.sparkSession) as put:
        distinct = put(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
        links = near_links(distinct, distance)
        roots = connected_components(links)
        named = put(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
        discard(links, roots)
        least = put(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        component = stage(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(component, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of least id. All columns stay as they are.

    Rows are told apart by id and text: rows without an id, or of one id with other texts, are documents of their own. A row
    with an id goes before those without, then the least id, then the least digest of the text; of rows alike in both, the one
    whose columns come first as JSON.
    """
    content = text_key(F.col(text_col))
    key = F.struct(F.col(id_col).isNull().alias("lost"), F.col(id_col).alias("id"), content.alias("content"))
    found = near_duplicates(docs.select(key.alias("__key"), F.col(text_col)), "__key", text_col, **options)
    first = found.where(F.col("component_id") == F.col("__key")).groupBy("__key").agg((F.count("*") > 1).alias("__again"))
    keep = stage(first.select(F.col("__key.id").alias("__keep"), F.col("__key.content").alias("__content"), "__again"), "kept")
    kept = docs.join(keep, (F.col("__content") == content) & F.col("__keep").eqNullSafe(docs[id_col]), "left_semi")
    if keep.where("__again").isEmpty():
        return kept
    best = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("__row")  # texts move once more only if rows are repeated
    return kept.groupBy(F.col(id_col).alias("__id"), content.alias("__content")).agg(best).select("__row.*")
