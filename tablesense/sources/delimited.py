"""Delimited files with ragged rows and quoted line ends, read in splits.

Spark's text source deals a file out in splits of whole lines. Whether a line begins a record depends on all quotes before it, so each
split is first summed up as a function: from "outside of quotes" or "inside" at its beginning to the same at its end, and how many
records end in it in either case. Functions of consecutive splits compose, which gives the state and the number of records at the
beginning of each split: one row per split reaches the driver. The second pass then knows where records begin. A record that lies
in several splits comes as fragments, which are put together by its number; all others never leave their task.
"""

from __future__ import annotations

import csv
import io
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOM = b"\xef\xbb\xbf"


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside of one or not. A quote opens a field only as its first
    character, and two in a row inside of one are a quote of its text."""
    at, opened, first = 0, inside, not inside
    while True:
        if opened:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            at, opened, first = at + 1, False, False
        elif first and line[at : at + 1] == b'"':
            at, opened = at + 1, True
        else:
            next_ones = [k for k in (line.find(sep, at), line.find(b"\r", at)) if k >= 0]
            if not next_ones:
                return False
            at, first = min(next_ones) + 1, True


def parse_record(text: bytes, sep: str) -> list[list[str]]:
    """Rows of a record's text: one, or several where a bare carriage return ends rows. Bytes that aren't UTF-8 are replaced; a line without
    anything is a row without cells."""
    csv.field_size_limit(sys.maxsize)
    rows = list(csv.reader(io.StringIO(text.decode("utf-8", "replace"), newline=""), delimiter=sep))
    return rows or [[]]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _split_states(lines: DataFrame, sep: str) -> DataFrame:
    """file, block, and for either state at the beginning whether the end is inside and how many records end in the split."""

    def sum_up(batches):
        cut, key, state, ended = sep.encode(), None, [False, True], [0, 0]

        def told():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, *state, *ended), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["file", "block", "inside0", "inside1", "ended0", "ended1"])

        for batch in batches:
            for *own, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != key:
                    if key is not None:
                        yield told()
                    key, state, ended = own, [False, True], [0, 0]
                if b'"' in line:
                    state = [ends_inside(line, s, cut) for s in state]
                for k in (0, 1):
                    ended[k] += not state[k]
        if key is not None:
            yield told()

    return lines.mapInArrow(sum_up, "file string, block long, inside0 boolean, inside1 boolean, ended0 long, ended1 long")


def scan_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """file, record_no (from 0 in each file), row_no (0 but for rows that a bare carriage return ends), cells: all rows as they are, short and long
    ones, rows without cells for empty lines, and a header like any other. What a quote that nothing closes opens goes on to the end of
    its file, as one cell. Memory is that of a record, not of a file."""
    lines = _lines(spark, path)
    told = sorted(map(tuple, _split_states(lines, sep).collect()))  # a row per split
    starts, file, inside, records = [], None, False, 0
    for name, block, *ends in told:
        if name != file:
            file, inside, records = name, False, 0
        starts.append((name, block, inside, records))
        inside, records = ends[inside], records + ends[2 + inside]
    known = spark.createDataFrame(starts, "of string, at long, inside boolean, first long")
    joined = lines.join(F.broadcast(known), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at"))).select("file", "block", "inside", "first", "line")

    def records_of(batches):
        cut, key, opened, held, number, whole = sep.encode(), None, False, [], 0, True
        out: list[tuple] = []

        def batch_of():
            columns = zip(*out, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["file", "record_no", "block", "whole", "text"])
            out.clear()
            return made

        for batch in batches:
            for name, block, inside, first, line in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (name, block) != key:
                    if held:
                        out.append((*key[:1], number, key[1], False, b"\n".join(held)))
                    # a split that begins inside of quotes begins with the rest of a record
                    key, opened, held, number, whole = (name, block), inside, [], first, not inside
                    if block == 0 and line.startswith(_BOM):
                        line = line[len(_BOM) :]
                held.append(line)
                if b'"' in line:
                    opened = ends_inside(line, opened, cut)
                if not opened:
                    out.append((name, number, block, whole, b"\n".join(held)))
                    held, number, whole = [], number + 1, True
            if out:
                yield batch_of()
        if held:
            out.append((*key[:1], number, key[1], False, b"\n".join(held)))
        if out:
            yield batch_of()

    found = joined.mapInArrow(records_of, "file string, record_no long, block long, whole boolean, text binary")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", F.hex("text").alias("text")))), lambda p: p["text"])
    mended = found.where("not whole").groupBy("file", "record_no").agg(F.unhex(F.array_join(parts, "0A")).alias("text"))
    texts = found.where("whole").select("file", "record_no", "text").unionByName(mended)

    def cells(batches):
        for batch in batches:
            rows = [(f, n, k, row) for f, n, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for k, row in enumerate(parse_record(t, sep))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["file", "record_no", "row_no", "cells"])

    return texts.mapInArrow(cells, "file string, record_no long, row_no int, cells array<string>")


def preview_delimited(spark: SparkSession, path: str, rows: int = 20, sep: str = ",") -> DataFrame:
    """columns (the first row's cells), rows (the next ones, as long or short as they are) and row_count (all rows but the first) of one file, in
    one row and from one job over it."""
    place = F.struct("record_no", "row_no", "cells")
    found = scan_delimited(spark, path, sep).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("record_no") <= rows, place))).alias("head"))
    cells: Column = F.transform("head", lambda x: x["cells"])
    return found.select(F.coalesce(F.try_element_at(cells, F.lit(1)), F.array().cast("array<string>")).alias("columns"), F.slice(cells, 2, rows).alias("rows"), F.greatest(F.col("n") - 1, F.lit(0)).alias("row_count"))


def ragged_table(spark: SparkSession, path: str, sep: str = ",", pad: str | None = "") -> DataFrame:
    """A file's rows under its header, all cells as text: short rows are filled up with ``pad``, long ones keep what the header doesn't name in
    the column __rest, an array. The header is read first; its names may repeat. Rows without cells are left out."""
    rows = scan_delimited(spark, path, sep)
    header = rows.where("record_no = 0 and row_no = 0").select("cells").first()
    names = header["cells"] if header else []
    body = rows.where("(record_no > 0 or row_no > 0) and size(cells) > 0")
    own = [F.coalesce(F.get("cells", F.lit(i)), F.lit(pad)).alias(n) for i, n in enumerate(names)]
    return body.select(*own, F.slice("cells", len(names) + 1, F.greatest(F.size("cells") - len(names), F.lit(0))).alias("__rest"))
