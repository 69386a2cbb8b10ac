"""Token ids by a public tokenizer, and a flat binary format for them.

A token file is a run of little-endian unsigned integers with nothing between documents (16 bits where every id fits,
else 32); its index is a run of little-endian unsigned 64-bit offsets, in tokens, one per document and one at the end. Both are
memory-mapped by readers. A manifest lists the files in order, with each one's first document and first token in the
whole corpus, which are prefix sums over the files before it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm.files import local_path, move, open_for_writing, read_bytes
from tablesense.llm.shared import new_folder, partitions

#: Texts of these characters only: lower-casing, composition and character classes are alike in all Unicode versions.
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-˿]")
_LOW = [chr(c) for c in range(0x300)]
_LETTERS = re.escape("".join(c for c in _LOW if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LOW if unicodedata.category(c)[0] == "N"))
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: The only split rule for which the word cache below holds, as the tokenizer's file has it.
_SPLIT_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_CACHED_WORDS, _CACHED_CHARS = 400_000, 64


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself, or from U+0100 on those without a glyph."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """Ids of words, as bytes, by the library's model. It is emptied when full, so memory is bounded."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of what stands between blanks: words, numbers and signs."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join([self.words[w] for w in _PIECES.findall(chunk)])
        if len(chunk) <= _CACHED_CHARS:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


class WordEncoder:
    """Encodes texts with the ``tokenizers`` library, keeping the ids of words it has seen.

    A tokenizer that drops white space and splits by ``_SPLIT_RULE`` encodes each word by itself, so a text's ids are
    its words' ids in a row: texts are split here, and each new word goes to the model that the library loaded. Texts
    with characters that ``_UNSAFE`` finds, and all texts where the tokenizer's file has other rules, are encoded whole
    by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        steps = [x.get("type") for x in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [(x.get("type"), x.get("pattern", {}).get("Regex")) for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        added = [x["content"] for x in rules["added_tokens"]]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and splits == [("Split", _SPLIT_RULE), ("ByteLevel", None)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.chunks = _Chunks(_Words(self.library.model))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null: none."""
        out: list[bytes] = []
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.by_word or _UNSAFE.search(text) or (self.added and self.added.search(text)):
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                out.append(b"".join(map(self.chunks.__getitem__, text.lower().split())))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20):
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    size = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


@dataclass(frozen=True)
class TokenFiles:
    """What ``write_tokens`` has written: the folder, and for each file its name, width, documents, tokens, and those before it."""

    folder: str
    files: list[dict]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> TokenFiles:
    """Writes every whole text's ids (null: none), each followed by ``end_id``, in ascending order of id (null ids
    first; equal ids by their text's hash). Repeated rows are documents of their own; an empty table gives no files.

    Each range of ids is one pair of files, written under a temporary name and then renamed: a task that runs again
    writes the same bytes. Only one manifest row per file reaches the driver.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    order = ["id", F.xxhash64("t"), F.monotonically_increasing_id()]
    ranged = rows.select("id", "t", order[1].alias("h"), order[2].alias("m")).repartitionByRange(partitions(spark), "id", "h", "m").sortWithinPartitions("id", "h", "m")

    def write(it):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        codes = encoder(tokenizer)
        wide = codes.library.get_vocab_size() > 1 << 16 or (end_id or 0) >= 1 << 16
        kind = "<u4" if wide else "<u2"
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        name, at, ids, offsets = f"tokens-{part:06d}", 0, [], [0]
        temporary = f"{folder}/_temporary-{attempt}-{name}"
        first, out = True, None
        for batch in it:
            for rows in slices(batch, 1):
                for x in codes.encode(rows.column(1).to_numpy(zero_copy_only=False)):
                    got = np.frombuffer(x + end, "<u4").astype(kind)
                    if first:
                        out, first = open_for_writing(f"{temporary}.bin"), False
                    out.write(got.tobytes())
                    at += len(got)
                    offsets.append(at)
                ids.append(rows.column(0))
        if first:
            return
        out.close()
        with open_for_writing(f"{temporary}.idx") as f:
            f.write(np.array(offsets, "<u8").tobytes())
        with open_for_writing(f"{temporary}.ids") as f, pa.ipc.new_stream(f, pa.schema([("id", ids[0].type)])) as w:
            for x in ids:
                w.write_batch(pa.RecordBatch.from_arrays([x], names=["id"]))
        for kind_of in ("bin", "idx", "ids"):
            move(f"{temporary}.{kind_of}", f"{folder}/{name}.{kind_of}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "dtype": [kind], "documents": [len(offsets) - 1], "tokens": [at]})

    found = ranged.select("id", "t").mapInArrow(write, "part int, name string, dtype string, documents long, tokens long").collect()
    files, documents, tokens = [], 0, 0
    for r in sorted(found, key=lambda r: r["part"]):
        files.append(r.asDict() | {"first_document": documents, "first_token": tokens})
        documents, tokens = documents + r["documents"], tokens + r["tokens"]
    with open_for_writing(f"{folder}/_manifest.tmp") as f:
        f.write(json.dumps({"files": files, "documents": documents, "tokens": tokens}).encode())
    move(f"{folder}/_manifest.tmp", f"{folder}/manifest.json")
    return TokenFiles(folder, files)


def map_tokens(folder: str, file: dict) -> tuple[np.ndarray, np.ndarray]:
    """A file's ids and offsets, memory-mapped where the folder is a path of this machine."""
    both = []
    for kind, dtype in (("bin", file["dtype"]), ("idx", "<u8")):
        path = f"{folder}/{file['name']}.{kind}"
        local = local_path(path)
        if local is not None and not (kind == "bin" and not file["tokens"]):
            both.append(np.memmap(local, dtype=dtype, mode="r"))
        else:
            both.append(np.frombuffer(read_bytes(path), dtype=dtype))
    return both[0], both[1]


def read_tokens(spark: SparkSession, files: TokenFiles, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id_col, start (tokens before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    folder = files.folder
    schema = f"id {id_type}, start long, n_tokens long, ids binary"
    if not files.files:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    listed = spark.createDataFrame([(json.dumps(f),) for f in files.files], "file string").repartition(len(files.files))

    def read(it):
        for batch in it:
            for text in batch.column(0).to_pylist():
                file = json.loads(text)
                ids, offsets = map_tokens(folder, file)
                keys = pa.ipc.open_stream(read_bytes(f"{folder}/{file['name']}.ids")).read_all().column(0)
                lo = 0
                while lo < len(offsets) - 1:
                    hi = max(lo + 1, min(lo + 2000, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), side="right")) - 1))
                    own = [ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() for k in range(lo, hi)]
                    start = offsets[lo:hi].astype(np.int64) + file["first_token"]
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).combine_chunks(), pa.array(start), pa.array(np.diff(offsets[lo : hi + 1]).astype(np.int64)), pa.array(own, pa.binary())], names=["id", "start", "n_tokens", "ids"])
                    lo = hi

    return listed.mapInArrow(read, schema).withColumnRenamed("id", id_col)
