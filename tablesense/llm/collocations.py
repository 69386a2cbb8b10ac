"""Phrase collocations by vertical positional inverted lists.

Texts are cut into blocks of one language each, at ends of pieces, which no phrase crosses. A block holds, for each of its
words, the list of places where it stands: that list's length is the word's exact frequency there, and the sum over blocks its
frequency in the corpus. Level by level, the list of a frequent phrase is merged by place with the lists of what follows one
word further on: places p of ``w1 .. wk`` meet places p + 1 of ``w2 .. wk+1``, the postings of the adjacent word kept as those of
the phrase that it ends, since the longer phrase can only be frequent if both are. The meeting places are the longer phrase's
list.

Lists stay in their block. To learn which phrases are frequent, each block deals its phrases and their counts out over buckets, as
arrays of numbers, one row for each bucket; a bucket adds them up and sends each block back the ids of those that are frequent. A
phrase has one count per block at most, so the commonest phrase is no hot key, and there are as many buckets as keep one to
a few million counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.shared import discard, partitions, stage
from tablesense.llm.tokens import slices

#: Words that a task holds before it writes its blocks.
BLOCK_WORDS = 4_000_000
#: Counts that a bucket has, on average, at most.
BUCKET_COUNTS = 4_000_000
LONGEST = 4
_LINE = "\n"
_SPELT = {c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)} | {ord(c): _LINE for c in ".,;:!?\x0a\x0b\x0c\x0d"} | {ord("\t"): " "}
_PIECE_PARTS = re.compile("[^ \n]+|\n")
_LISTS = "block long, ids binary, ends binary, positions binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, lowest first: the upper planes of small numbers are all zeros, which compress to nothing."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _packed_lists(positions: np.ndarray) -> bytes:
    """Places list by list, as differences, which are small within a list."""
    return _packed(np.diff(positions.astype(np.int32), prepend=np.int32(0)))


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(_numbers(packed, np.int32), dtype=np.int32)


class _Block:
    """Words of one language, numbered in order of appearance; the end of a piece is -1."""

    def __init__(self):
        self.known: dict[str, int] = {_LINE: -1}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[str]) -> None:
        known = self.known
        for w in words:
            if w not in known:
                known[w] = len(known) - 1
        self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.array([-1], np.int32))
        self.size += len(words) + 1

    def lists(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, the length of each one's list, and the lists in a row."""
        at = np.concatenate(self.parts)
        order = np.argsort(at, kind="stable").astype(np.int32)
        counts = np.bincount(at[at >= 0], minlength=len(self.known) - 1).astype(np.int32)
        return list(self.known)[1:], counts, order[np.count_nonzero(at < 0) :]


def _pieces(text: str, most: int):
    """Parts of a text of about ``most`` words, cut at ends of pieces only."""
    words = _PIECE_PARTS.findall(text.translate(_SPELT))
    lo = 0
    while lo < len(words):
        hi = lo + most
        if hi < len(words):
            try:
                hi = words.index(_LINE, hi)
            except ValueError:
                hi = len(words)
        yield words[lo:hi]
        lo = hi


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, lang, n (words), words, counts, positions: the lists of the words of blocks, as one written table."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def write(it):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, _Block] = {}

        def flushed():
            nonlocal made
            for lang, block in held.items():
                words, counts, positions = block.lists()
                made += 1
                row = [[task << 32 | made], [lang], [int(counts.sum())], [words], [counts], [_packed_lists(positions)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["block", "lang", "n", "words", "counts", "positions"])
            held.clear()

        for batch in it:
            for part in slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for words in _pieces(text, block_words):
                        held.setdefault(lang, _Block()).add(words)
                        if sum(b.size for b in held.values()) >= block_words:
                            yield from flushed()
        yield from flushed()

    return stage(rows.mapInArrow(write, "block long, lang string, n long, words array<string>, counts array<int>, positions binary"), "word-lists")


def _frequent_words(blocks: DataFrame, least: int) -> DataFrame:
    """block, word_no, lang, word, total, id of words that occur ``least`` times in their language; first is true in one row of each
    id. A written table."""
    rows = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("word_no", "w")).select("block", "lang", "word_no", F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("count"))
    total = F.sum("count").over(Window.partitionBy("lang", "word")).alias("total")
    named = rows.select("block", "lang", "word_no", "word", total).where(F.col("total") >= least)  # rows of one word stand together

    def name(it):
        part, number, last = TaskContext.get().partitionId(), -1, None
        for batch in it:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in (batch.column("lang"), batch.column("word")):
                new[1:] |= np.array(pc.not_equal(c[1:], c[:-1]), bool)
            ends = [(batch.column("lang")[i].as_py(), batch.column("word")[i].as_py()) for i in (0, batch.num_rows - 1)]
            new[0] = ends[0] != last
            last = ends[1]
            ids = number + np.cumsum(new)
            number = int(ids[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((part << 40) + ids), pa.array(new)], names=[*batch.schema.names, "id", "first"])

    return stage(named.mapInArrow(name, "block long, lang string, word_no int, word string, total long, id long, first boolean"), "frequent")


def _frequent_pairs(lists: DataFrame, least: int, buckets: int) -> DataFrame:
    """What of two lists that follow each other ``least`` times: rows of arrays a, b and id for each block, and rows without a block that
    have total too, for each phrase once. A written table."""
    kind = "bucket int, block long, a binary, b binary, n binary"

    def deal(it):
        for batch in it:
            for block, *kept in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                known, _, a, b = _merged(*kept)
                pairs, n = np.unique(a * max(1, len(known)) + b, return_counts=True)
                if not len(pairs):
                    continue
                a, b = (known[x] for x in np.divmod(pairs, len(known)))
                mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                bucket = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                there, first = np.unique(bucket[order], return_index=True)
                parts = [np.split(x[order], first[1:]) for x in (a, b, n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), block)), *[pa.array([_packed(x) for x in p], pa.binary()) for p in parts]], names=["bucket", "block", "a", "b", "n"])

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_pylist()
        parts = [[_numbers(x, np.int64) for x in rows.column(c).to_pylist()] for c in ("a", "b", "n")]
        a, b, n = (np.concatenate(p) for p in parts)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        run = np.cumsum(new) - 1
        ids = np.where(total >= least, np.cumsum(total >= least) - 1, -1)
        of = np.empty(len(order), np.int64)
        of[order] = ids[run]
        bucket = key[0].as_py()
        head = np.flatnonzero(new)[total >= least]
        name = lambda x: x * buckets + bucket
        out = [(None, a[head], b[head], name(ids[total >= least]), total[total >= least])] if len(head) else []
        at = 0
        for block, x, y in zip(blocks, *parts[:2], strict=True):
            own = of[at : at + len(x)]
            at += len(x)
            if (own >= 0).any():
                out.append((block, x[own >= 0], y[own >= 0], name(own[own >= 0]), None))
        columns = [pa.array([r[0] for r in out], pa.int64())] + [pa.array([None if r[i] is None else _packed(r[i]) for r in out], pa.binary()) for i in range(1, 5)]
        return pa.Table.from_arrays(columns, names=["block", "a", "b", "id", "total"])

    dealt = lists.mapInArrow(deal, kind)
    return stage(dealt.groupBy("bucket").applyInArrow(add, "block long, a binary, b binary, id binary, total binary"), "frequent")


def _phrases(named: DataFrame) -> DataFrame:
    """id, total, a, b: a row for each phrase."""

    def rows(it):
        for batch in it:
            for packed in zip(*(batch.column(c).to_pylist() for c in ("id", "total", "a", "b")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(x, np.int64)) for x in packed], names=["id", "total", "a", "b"])

    return stage(named.where("block is null").mapInArrow(rows, "id long, total long, a long, b long"), "phrases")


def _vertical(ids: np.ndarray, positions: np.ndarray) -> list[bytes]:
    """Lists of places, one for each id, of occurrences in order of place."""
    order = np.argsort(ids, kind="stable")
    known, first = np.unique(ids[order], return_index=True)
    ends = np.append(first[1:], len(ids)).astype(np.int32)
    return [_packed(known.astype(np.int64)), _packed(ends), _packed_lists(positions[order])]


def _merged(ids: bytes, ends: bytes, positions: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists' ids, and where one list's place p meets another's p + 1: p, and which lists these are."""
    known, last, place = _numbers(ids, np.int64), _numbers(ends, np.int32), _places(positions)
    of = np.repeat(np.arange(len(known)), np.diff(last, prepend=0))
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    meet = np.flatnonzero(place[1:] == place[:-1] + 1)
    return known, place[meet], of[meet], of[meet + 1]


def _lists_of_words(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """Lists of the frequent words, under their ids."""

    def keep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for counts, positions in zip(left.column("counts"), left.column("positions"), strict=True):
            counts = counts.values.to_numpy()
            of = np.full(len(counts), -1, np.int64)
            of[right.column("word_no").to_numpy()] = right.column("id").to_numpy()
            ids, place = np.repeat(of, counts), _places(positions.as_py())
            kept = ids >= 0
            rows.append(_vertical(ids[kept], place[kept]))
        return _lists_table(key[0].as_py(), rows)

    return stage(blocks.select("block", "counts", "positions").groupBy("block").cogroup(named.select("block", "word_no", "id").groupBy("block")).applyInArrow(keep, _LISTS), "phrase-lists")


def _lists_of_longer(lists: DataFrame, named: DataFrame) -> DataFrame:
    """Lists of the frequent phrases that are one word longer than those of ``lists``."""

    def keep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        wanted = [np.concatenate([np.zeros(0, np.int64), *(_numbers(x, np.int64) for x in right.column(c).to_pylist())]) for c in ("a", "b", "id")]
        for kept in zip(*(left.column(c).to_pylist() for c in ("ids", "ends", "positions")), strict=True):
            known, place, a, b = _merged(*kept)
            if not len(wanted[0]) or not len(place):
                continue
            codes = np.searchsorted(known, wanted[0]) * len(known) + np.searchsorted(known, wanted[1])
            order = np.argsort(codes)
            codes, ids = codes[order], wanted[2][order]
            pair = a * len(known) + b
            at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
            found = codes[at] == pair
            rows.append(_vertical(ids[at[found]], place[found]))
        return _lists_table(key[0].as_py(), rows)

    return stage(lists.groupBy("block").cogroup(named.where("block is not null").select("block", "a", "b", "id").groupBy("block")).applyInArrow(keep, _LISTS), "phrase-lists")


def _lists_table(block: int, rows: list[list[bytes]]) -> pa.Table:
    columns = [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
    return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int64()), *columns], names=["block", "ids", "ends", "positions"])


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of every language with a word, and for each length from 1 to 4 a written table of the phrases that occur
    ``least`` times or more in their language: id, total; of words also lang and word, of longer ones the ids of the phrase
    without its last word (a) and without its first (b)."""
    blocks = word_blocks(docs, text_col, lang_col, block_words)
    sizes = stage(blocks.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    named = _frequent_words(blocks, least)
    lists = _lists_of_words(blocks, named)
    discard(blocks)
    found = [stage(named.where("first").select("id", "total", "lang", "word"), "phrases")]
    discard(named)
    n = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-n // BUCKET_COUNTS))
    for size in range(2, LONGEST + 1):
        named = _frequent_pairs(lists, least, buckets)
        found.append(_phrases(named))
        if size < LONGEST:  # nothing is built on the longest
            before, lists = lists, _lists_of_longer(lists, named)
            discard(before)
        discard(named)
    discard(lists)
    return sizes, found


def _weakest(cuts: list[tuple[str, str]]) -> Column:
    """(score, place, l, r) of the cut of least score, the first of equal ones. Exact: a decimal product, whole division."""
    scored = [F.struct(F.expr(f"cast((2000000 * cast(total as decimal(28, 0))) div cast({left} + {right} as decimal(20, 0)) as bigint)").alias("score"), F.lit(k).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)]
    return F.least(*scored) if len(scored) > 1 else scored[0]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language (a null one is 'und').

    Words are runs of characters other than blanks and tabs, within pieces that end at ``.,;:!?`` and line ends; A to Z are
    lower-cased. Phrases of two to four words that occur ``least`` times are scored by their weakest cut and left out if a
    longer one takes up four fifths of them: that longer one may be taken to have one word more, since what is longer still
    contains such a phrase of no lower frequency. Null, empty and blank texts have no words; repeated rows count each time; ties
    go by frequency and then by the phrase's bytes. An empty table gives no rows. A text may be of any length: it is cut into
    several blocks where pieces end. Other columns, whatever their names, aren't read.
    """
    sizes, (words, pairs, triples, quads) = frequent_phrases(docs, text_col, lang_col, least, block_words)

    def renamed(df: DataFrame, key: str, **columns: str) -> DataFrame:
        return df.select(F.col("id").alias(key), *[F.col(old).alias(new) for new, old in columns.items()])

    w2 = pairs.join(renamed(words, "a", lang="lang", w1="word", first="total"), "a").join(renamed(words, "b", w2="word", last="total"), "b")
    two = stage(w2.select("id", "total", "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("w2").alias("tail"), "first", "last"), "pairs")
    w3 = triples.join(renamed(two, "a", lang="lang", head="phrase", first="first", head2="total"), "a").join(renamed(two, "b", tail="tail", last="last", tail2="total"), "b")
    three = stage(w3.select("id", "total", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "first", "last", "head2", "tail2", "a", "b"), "triples")
    w4 = quads.join(renamed(three, "a", lang="lang", head="phrase", first="first", head2="head2", head3="total"), "a").join(renamed(three, "b", tail="tail", last="last", tail2="tail2", tail3="total"), "b")
    four = stage(w4.select("total", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "first", "last", "head2", "tail2", "head3", "tail3", "a", "b"), "quads")

    def kept(df: DataFrame, longer: DataFrame) -> DataFrame:
        most = longer.select(F.explode(F.array("a", "b")).alias("id"), "total").groupBy("id").agg(F.max("total").alias("most"))
        return df.join(most, "id", "left").where("most is null or 100 * cast(most as decimal(28, 0)) < 80 * cast(total as decimal(28, 0))")

    scored = [
        kept(two, three).select("lang", "phrase", "total", _weakest([("first", "last")]).alias("s")),
        kept(three, four).select("lang", "phrase", "total", _weakest([("first", "tail2"), ("head2", "last")]).alias("s")),
        four.select("lang", "phrase", "total", _weakest([("first", "tail3"), ("head2", "tail2"), ("head3", "last")]).alias("s")),
    ]
    every = scored[0].unionByName(scored[1]).unionByName(scored[2]).select("lang", "phrase", F.col("total").alias("a"), "s.l", "s.r", "s.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = every.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(F.broadcast(sizes) if _few(sizes) else sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _few(sizes: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has at most ``most`` rows, of which no more are read."""
    return sizes.limit(most + 1).count() <= most
