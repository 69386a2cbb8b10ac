"""Exact substring deduplication on a sparse suffix array, by refinement of q-gram buckets.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. The suffixes that are
kept are those at anchors: in every string of ``length`` bytes, the leftmost of its q-grams with the least hash. Equal
strings have their anchor at the same place, so a string can repeat only if its anchor's bucket, the suffixes that
begin with the same q-gram, has two members.

Buckets are refined, and members that are alone dropped, in rounds:

1. q-gram buckets of all anchors; the rest of the corpus is done with here.
2. Buckets refined by identifiers of all that strings with this anchor can cover, at later and earlier offsets of each suffix. This
   settles the inside of repeated passages. Of suffixes that agree, one stands for all from here on.
3. Those and the others refined by the two halves that bound which of an anchor's strings can repeat.
4. What is left, strings with a byte that nothing found so far covers, is judged string by string, together with those of the
   same distance in the same bucket. The bounds of the round before carry over.

An identifier is the BLAKE2b digest of 128 bits of the string itself, so equal identifiers are equal strings to the same
certainty as equal SHA-256 digests are equal texts; 64-bit hashes only say where anchors are and which are alone for certain. Numbers for buckets, as
bucket-pointer refinement has them, would need every suffix of the repeated text as a row; the README says what that costs.

Rows hold identifiers and places, never text. Equal texts are kept once, in a table bucketed by content, so that each
round joins to the texts without moving them. Hot buckets are counted with partial aggregates and joined as rows
to written tables of what was counted, so that a skewed join can be split. Texts are worked through in pieces of bounded size.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.shared import delete, discard, free_shuffles, new_folder, partitions, stage, temporary, text_key
from tablesense.llm.tokens import slices

Q = 64
_BLOCK = 256 << 10
#: So much of a text is hashed at a time.
_PIECE = 2 << 20
#: Strings are counted in so many slices of their identifiers, one after the other, so that a fraction of them is shuffled at a time.
_SLICES = 4


def _codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = _codes()
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * _A
    x += (b ^ (b >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(31))


def grams(data: np.ndarray, size: int = Q) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes, a power of two, that begin at each place; of rows, if ``data`` has them."""
    h, done = _CODES[data], 1
    while done < size:
        h = _pair(h[..., :-done], h[..., done:])
        done *= 2
    return h


def grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``grams`` at some places only."""
    if not len(at):
        return np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(data, Q)
    return np.concatenate([grams(windows[at[k : k + 8192]])[:, 0] for k in range(0, len(at), 8192)])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], for each i with a whole window."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of several texts, one after the other in ``data``, and the q-grams' hashes there.

    Where q-grams of a string tie, all of them are anchors; more than need be do no harm. Windows of a long text are looked
    at in pieces that overlap by a string."""
    width = length - Q + 1
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, max(0, len(data) - length + 1), _PIECE):
        part = data[lo : lo + _PIECE + length - 1]
        h = grams(part)
        least = _slide(h, width, np.minimum)
        inside = np.zeros(len(part) + 1, np.int32)
        first, last = np.maximum(starts - lo, 0), np.minimum(ends - length + 1 - lo, len(part) - length + 1)
        whole = last > first
        np.add.at(inside, first[whole], 1)
        np.add.at(inside, last[whole], -1)
        least = np.where(np.cumsum(inside[: len(least)]) > 0, least, 0)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        at = np.flatnonzero(_slide(padded, width, np.maximum)[: len(h)] == h)
        found[0].append(at + lo)
        found[1].append(h[at])
    at, first = np.unique(np.concatenate(found[0]), return_index=True)
    return at, np.concatenate(found[1])[first]


def reach(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings of a text whose anchor is at each of ``at`` (ascending); last < first: none."""
    width, size = length - Q + 1, len(data)
    lo, hi = np.maximum(0, at - width + 1), np.minimum(at, size - length)
    back = np.arange(1, width)
    for begin in range(0, size, _PIECE):
        own = slice(*np.searchsorted(at, [begin, begin + _PIECE]))
        if own.start == own.stop:
            continue
        from_ = max(0, begin - width)
        h = grams(data[from_ : begin + _PIECE + width + Q])
        most = np.full(width, np.iinfo(np.uint64).max)
        padded = np.concatenate([most, h, most])
        for k in range(own.start, own.stop, 4096):
            some = slice(k, min(k + 4096, own.stop))
            a = at[some]
            here = a - from_ + width
            value = padded[here][:, None]
            before = padded[here[:, None] - back] <= value  # the nearest tie or less to the left
            lo[some] = np.maximum(lo[some], np.where(before.any(axis=1), a - back[before.argmax(axis=1)] + 1, 0))
            after = padded[here[:, None] + back] < value
            hi[some] = np.minimum(hi[some], np.where(after.any(axis=1), a + back[after.argmax(axis=1)] - width, size))
    return lo, hi


def _text_rows(batch: pa.RecordBatch, column: int):
    for k in range(batch.num_rows):
        yield k, np.frombuffer(batch.column(column)[k].as_buffer(), np.uint8)


def _list(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False)


def _anchor_rows(length: int):
    def run(it):
        for batch in it:
            for part in slices(batch, 1, _BLOCK):
                texts = [x.as_buffer() for x in part.column(1)]
                ends = np.cumsum([len(x) for x in texts])
                starts = np.concatenate([[0], ends[:-1]])
                at, ids = anchors(np.frombuffer(b"".join(texts), np.uint8), starts, ends, length)
                which = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(at - starts[which]), pa.array(ids.view(np.int64))], names=["tkey", "at", "bucket"])

    return run


def _digests(data: memoryview, starts: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Identifiers of the strings of ``size`` bytes that begin at each of ``starts``, as pairs of 64-bit integers. ``kind`` keeps
    strings apart that aren't to be compared."""
    blake, mark = hashlib.blake2b, bytes([kind])
    out = b"".join([blake(data[s : s + size], digest_size=16, person=mark).digest() for s in starts.tolist()])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


#: What is judged at an anchor: the halves that all strings share which begin within ``near`` bytes before it (0), and further
#: before it (1); all that strings with this anchor can cover (2). Of equal ones of the last kind one is marked (3) to stand for all.
_NEAR, _FAR, _FULL, _FIRST = range(4)
_KINDS = 4


def _probe_places(at: np.ndarray, size: int, length: int, halves: bool):
    """For each kind of a round: which anchors have it, where it starts, and its size."""
    near = (length - Q) // 2
    if halves:
        yield _NEAR, at + length - near <= size, at, length - near
        yield _FAR, at - near >= 0, at - near, near + Q
    else:
        yield _FULL, (at - (length - Q) >= 0) & (at + length <= size), at - (length - Q), 2 * length - Q


def _batches(key: pa.Array, found: Iterator[tuple[int, list[np.ndarray]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of several texts, with each text's key, in batches of some 64,000."""
    which, columns, n = [], [], 0

    def out():
        took = key.take(pa.array(np.concatenate(which)))
        return pa.RecordBatch.from_arrays([took, *(pa.array(np.concatenate(c)) for c in zip(*columns))], names=["tkey", *names])

    for k, values in found:
        which.append(np.full(len(values[0]), k))
        columns.append(values)
        n += len(values[0])
        if n >= 1 << 16:
            yield out()
            which, columns, n = [], [], 0
    if n:
        yield out()


def _probe_rows(length: int, halves: bool):
    """What is judged of the anchors of each text; the halves, of those only that no other stands for."""

    def probes(batch):
        for k, data in _text_rows(batch, 1):
            at, view = np.sort(_list(batch, "at", k)), memoryview(data)
            if halves and batch.column("full")[k].is_valid:
                seen, kind = np.divmod(_list(batch, "full", k), _KINDS)
                at = np.setdiff1d(at, seen[kind == _FULL])
            for kind, has, start, size in _probe_places(at, len(data), length, halves):
                for j in range(0, int(has.sum()), 1 << 16):
                    some = slice(j, j + (1 << 16))
                    ids = _digests(view, start[has][some], size, kind)
                    yield k, [_KINDS * at[has][some] + kind, ids[:, 0].copy(), ids[:, 1].copy()]

    def run(it):
        for batch in it:
            yield from _batches(batch.column("tkey"), probes(batch), ["probe", "x", "y"])

    return run


def covered_bytes(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks[:-1], dtype=np.int32) > 0


def _found(seen: np.ndarray, length: int) -> np.ndarray:
    """Starts of strings that the second round has settled: two that cover all that an anchor's strings can."""
    at, kind = np.divmod(seen, _KINDS)
    full = at[kind >= _FULL]
    return np.concatenate([full - (length - Q), full])


class _Judged:
    """A text after the third round: places of anchors that have halves which repeat and that no other stands for, and
    how many bytes before each place of the text nothing found covers."""

    def __init__(self, batch: pa.RecordBatch, k: int, data: np.ndarray, length: int):
        seen = _list(batch, "seen", k)
        at, kind = np.divmod(seen, _KINDS)
        self.data, self.length = data, length
        self.near, self.far = at[kind == _NEAR], at[kind == _FAR]
        self.places = np.setdiff1d(np.union1d(self.near, self.far), at[kind == _FULL])
        missing = ~covered_bytes(len(data), _found(seen, length), length)
        self.missing = np.concatenate([[0], np.cumsum(missing, dtype=np.int32)])

    def in_doubt(self) -> np.ndarray:
        """Places with a string that may have a byte which isn't covered."""
        lo, hi = np.maximum(self.places - (self.length - Q), 0), np.minimum(self.places + self.length, len(self.data))
        return self.places[self.missing[hi] > self.missing[lo]]

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the places' strings, as far as the halves that repeat leave them possible."""
        lo, hi = reach(self.data, places, self.length)
        half = (self.length - Q) // 2
        lo = np.where(np.isin(places, self.far), lo, np.maximum(lo, places - half))
        return lo, np.where(np.isin(places, self.near), hi, np.minimum(hi, places - half))

    def is_open(self, start: np.ndarray) -> np.ndarray:
        """Which strings have a byte that no string found covers."""
        return self.missing[start + self.length] > self.missing[start]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from lo to hi, bounds by bounds, and which bounds each is of."""
    n = np.maximum(hi - lo + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def _words(length: int) -> list[str]:
    """Columns of 64 bits each, with a bit for each distance from a string's start to its anchor."""
    return [f"m{i}" for i in range((length - Q) // 64 + 1)]


def _open_rows(length: int):
    """Buckets of the anchors with strings that aren't inside what was found, and at which distances before the anchor those begin."""

    def run(it):
        for batch in it:
            buckets, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k, data in _text_rows(batch, 1):
                text = _Judged(batch, k, data, length)
                doubt = text.in_doubt()
                for j in range(0, len(doubt), 1 << 14):
                    places = doubt[j : j + (1 << 14)]
                    which, start = _spread(*text.bounds(places))
                    some = text.is_open(start)
                    buckets.append(grams_at(data, places)[which[some]])
                    before.append(places[which[some]] - start[some])
            own, row = np.unique(np.concatenate(buckets), return_inverse=True)
            bits = np.zeros((len(own), 64 * len(_words(length))), bool)
            bits[row, np.concatenate(before)] = True
            masks = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *(pa.array(m) for m in masks.T.copy())], names=["bucket", *_words(length)])

    return run


def _string_rows(length: int):
    """The strings of the anchors in open buckets that begin as far before them as open ones do: the string's identifier, and
    whether it is open itself."""

    def strings(batch):
        for k, data in _text_rows(batch, 1):
            text, wanted = _Judged(batch, k, data, length), batch.column("open")[k].values
            bucket, *masks = (wanted.field(n).to_numpy(zero_copy_only=False) for n in ("bucket", *_words(length)))
            order = np.argsort(bucket.view(np.uint64))
            bucket, masks = bucket.view(np.uint64)[order], np.stack(masks, axis=1)[order]
            for j in range(0, len(text.places), 1 << 12):
                places = text.places[j : j + (1 << 12)]
                own = grams_at(data, places)
                row = np.minimum(np.searchsorted(bucket, own), len(bucket) - 1)
                take = bucket[row] == own
                places, row = places[take], row[take]
                which, start = _spread(*text.bounds(places))
                asked = np.unpackbits(masks[row].view(np.uint8), axis=1, bitorder="little")
                start = start[asked[which, places[which] - start] > 0]
                if len(start):
                    ids = _digests(memoryview(data), start, length, _KINDS)
                    yield k, [start.astype(np.int64), ids[:, 0].copy(), ids[:, 1].copy(), text.is_open(start)]

    def run(it):
        for batch in it:
            yield from _batches(batch.column("tkey"), strings(batch), ["start", "x", "y", "open"])

    return run


def _cut_rows(length: int, keep_text: bool):
    def run(it):
        for batch in it:
            size, removed, spans, digests, kept = [], [], [], [], []
            for k, data in _text_rows(batch, 1):
                if batch.column("copies")[k].as_py() > 1 and len(data) >= length:
                    gone = np.ones(len(data), bool)
                else:
                    seen, starts = (_list(batch, n, k) if batch.column(n)[k].is_valid else np.zeros(0, np.int64) for n in ("seen", "starts"))
                    gone = covered_bytes(len(data), np.concatenate([_found(seen, length), starts]), length)
                left = data[~gone].tobytes()
                size.append(len(data)), removed.append(int(gone.sum())), digests.append(hashlib.sha256(left).hexdigest())
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                kept.append(left.decode("utf-8", "ignore") if keep_text and gone.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["tkey", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


@contextlib.contextmanager
def _bucketed_texts(docs: DataFrame, text_col: str) -> Iterator[DataFrame]:
    """tkey, text (bytes), copies: each distinct text once, in a table bucketed by tkey in the shared folder, for as long as the
    block lasts."""
    spark, name = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
    folder = new_folder(spark, name)
    rows = docs.select(text_key(F.col(text_col)).alias("tkey"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    once = rows.groupBy("tkey").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    try:
        once.write.bucketBy(partitions(spark), "tkey").option("path", folder).option("compression", "zstd").saveAsTable(name)
        free_shuffles(spark)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, folder)


def substring_cuts(docs: DataFrame, text_col: str = "text", length: int = 200, keep_text: bool = False) -> DataFrame:
    """A written table with one row per distinct text: tkey (128 bits of the SHA-256 of its UTF-8 bytes; null: of none), n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, if ``keep_text``, kept_text (bytes that removal leaves without their character are
    left out; null where nothing was removed).

    Strings never reach over the end of a text. Texts shorter than ``length`` lose nothing. A text that occurs more than
    once loses all. ``length`` is 2 * Q at least. Texts may be of any length; an empty table gives no rows.
    """
    if length < 2 * Q:
        raise ValueError(f"strings of {2 * Q} bytes at least are found")
    spark = docs.sparkSession
    with _bucketed_texts(docs, text_col) as texts, temporary(spark) as kept:
        plain = texts.select("tkey", "text")
        with temporary(spark) as soon:
            every = soon(plain.mapInArrow(_anchor_rows(length), "tkey binary, at long, bucket long"), "anchors")
            shared = soon(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared-buckets")
            near = kept(every.join(shared.hint("shuffle_hash"), "bucket").select("tkey", "at", "bucket"), "shared-anchors")
        free_shuffles(spark)
        with temporary(spark) as put:
            own = put(near.groupBy("tkey").agg(F.collect_list("at").alias("at")), "anchors-of-texts")
            judged, member = "tkey binary, probe long, x long, y long", F.xxhash64("tkey", "probe")
            with temporary(spark) as soon:
                probes = soon(plain.join(own.hint("shuffle_hash"), "tkey").mapInArrow(_probe_rows(length, False), judged), "surroundings")
                often = soon(probes.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1").select("x", "y", "first"), "repeated-surroundings")
                marked = probes.join(often.hint("shuffle_hash"), ["x", "y"]).select("tkey", (F.col("probe") + F.when(member == F.col("first"), _FIRST - _FULL).otherwise(0)).alias("probe"))
                full = put(marked.groupBy("tkey").agg(F.collect_list("probe").alias("full")), "full")
            free_shuffles(spark)
            with temporary(spark) as soon:
                left = plain.join(own.hint("shuffle_hash"), "tkey").join(full.hint("shuffle_hash"), "tkey", "left")
                probes = soon(left.mapInArrow(_probe_rows(length, True), judged), "halves")
                often = soon(probes.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), "repeated-halves")
                half = probes.join(often.hint("shuffle_hash"), ["x", "y"]).groupBy("tkey").agg(F.collect_list("probe").alias("half"))
                both = full.join(half, "tkey", "full")
                nothing = F.array().cast("array<long>")
                seen = kept(both.select("tkey", F.concat(F.coalesce("full", nothing), F.coalesce("half", nothing)).alias("seen")), "seen")
        free_shuffles(spark)

        masks = _words(length)
        open_ = plain.join(seen.hint("shuffle_hash"), "tkey").mapInArrow(_open_rows(length), ", ".join(f"{c} long" for c in ["bucket", *masks]))
        with temporary(spark) as put:
            open_buckets = put(open_.groupBy("bucket").agg(*[F.bit_or(m).alias(m) for m in masks]), "open-buckets")
            listed = near.join(open_buckets.hint("shuffle_hash"), "bucket").groupBy("tkey").agg(F.collect_set(F.struct("bucket", *masks)).alias("open"))
            to_list = plain.join(seen.hint("shuffle_hash"), "tkey").join(listed.hint("shuffle_hash"), "tkey")
            strings = put(to_list.mapInArrow(_string_rows(length), "tkey binary, start long, x long, y long, open boolean"), "strings")
            discard(near)
            free_shuffles(spark)
            found = []
            for k in range(_SLICES):
                own = strings.where(F.pmod("x", F.lit(_SLICES)) == k)
                counted = own.groupBy("x", "y").agg(F.count("*").alias("n"), F.max("open").alias("open"))
                twice = put(counted.where("n > 1 and open").select("x", "y"), "repeated-strings")
                free_shuffles(spark)
                found.append(put(own.where("open").join(twice.hint("shuffle_hash"), ["x", "y"]).select("tkey", "start"), "found"))
                free_shuffles(spark)
            starts = kept(reduce(DataFrame.union, found).groupBy("tkey").agg(F.collect_list("start").alias("starts")), "starts")
        free_shuffles(spark)
        cut = texts.join(seen.hint("shuffle_hash"), "tkey", "left").join(starts.hint("shuffle_hash"), "tkey", "left").select("tkey", "text", "copies", "seen", "starts")
        cuts = stage(cut.mapInArrow(_cut_rows(length, keep_text), "tkey binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"), "cuts")
    free_shuffles(spark)
    return cuts


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept_sha256. Null texts are empty. Rows with null or
    repeated ids are texts like all others; an empty table gives an empty result."""
    cuts = substring_cuts(docs, text_col, length).drop("kept_text")
    return docs.select(F.col(id_col), text_key(F.col(text_col)).alias("tkey")).join(cuts, "tkey").drop("tkey")


def remove_substrings(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", length: int = 200) -> DataFrame:
    """``docs`` with what is left of each text; ``length_col``, where there is one, is its new length in characters. Null
    texts stay null. All other columns stay as they are."""
    cuts = substring_cuts(docs, text_col, length, keep_text=True).where("n_removed > 0").select(F.col("tkey").alias("__tkey"), F.col("kept_text").alias("__kept"))
    found = docs.join(cuts, text_key(docs[text_col]) == F.col("__tkey"), "left")
    changed = F.col("__kept").isNotNull()
    out = {text_col: F.when(changed, F.col("__kept")).otherwise(docs[text_col])}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(changed, F.char_length("__kept").cast(docs.schema[length_col].dataType)).otherwise(docs[length_col])
    return found.withColumns(out).select(*docs.columns)
