"""A deterministic sharded WARC/1.1 writer and its reader.

Records are range-sorted by page id. A task writes its range into gzip files, one member per record, and begins a new
file once one has reached the size given. Files are written under a temporary name and renamed when whole; a manifest
lists them with their sizes and SHA-256, and is itself renamed into place last. Headers, digests and record ids depend
on the rows alone, so a task that runs again writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm.files import move, open_for_reading, open_for_writing
from tablesense.llm.shared import new_folder, partitions, stage

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


#: Stands for a null id, which no quoted id is.
_NO_ID = "!"


def _record_id(page_id, own: str) -> str:
    """A record's id: the page's, and what tells it from other records of that page."""
    return f"<urn:page:{_NO_ID if page_id is None else quote(str(page_id), safe='')}:{own}>"


def _page_id(record_id: str, kind: type):
    text = record_id[len("<urn:page:") :].rpartition(":")[0]
    return None if text == _NO_ID else kind(unquote(text))


def _record(page_id, url: str | None, payload: bytes, original, is_first: bool, is_revisit: bool, place: str, date: str) -> bytes:
    """A record's bytes. A revisit has no payload; its length and digest are in the headers all the same. The record that
    revisits refer to is named by its page and payload, all others by page and ``place``, so no two names are the same."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest if is_first else place)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=":/?#[]@!$&'()*+,;=%~")}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {_record_id(original, digest)}", f"WARC-Profile: {_PROFILE}"] if is_revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """id, url, payload, digest, tie, original, first, revisit. Of rows with equal payloads of ``least_bytes`` or more, the one of
    smallest id is the first; all others are revisits of it. Null ids come after all others. Of rows that are alike in id and
    payload one is the first: only where there are such is the table written once more, so that places in it tell them apart."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("tie", F.lit(0).cast("long"))

    def equal(rows: DataFrame) -> DataFrame:
        place = F.struct(F.col("id").isNull().alias("last"), "id", "tie", "alike")
        alike = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest", "id", "tie").agg(F.count("*").alias("alike"))
        groups = alike.groupBy("digest").agg(F.min(place).alias("first"), F.sum("alike").alias("n")).where("n > 1")
        return stage(groups, "equal-payloads")  # its size is known then: payloads stay where they are if it is small

    groups = equal(rows)
    if not groups.where("first.alike > 1").isEmpty():
        rows = stage(rows.drop("tie"), "pages").withColumn("tie", F.monotonically_increasing_id())
        groups = equal(rows)
    found = rows.join(groups.select("digest", F.col("first").alias("of")), "digest", "left")
    first = F.col("of").isNotNull() & (F.col("of.tie") == F.col("tie")) & F.col("of.id").eqNullSafe(F.col("id"))
    return found.select("id", "url", "payload", "digest", "tie", F.col("of.id").alias("original"), first.alias("first"), (F.col("of").isNotNull() & ~first).alias("revisit"))


def write_warc(pages: DataFrame, folder: str | None = None, roll_bytes: int = 256 << 20, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = 6) -> tuple[str, list[dict]]:
    """Writes a record per row (null html: an empty payload) and returns the folder and the manifest's files.

    A file ends with the record that takes it to ``roll_bytes``. One manifest row per file reaches the driver. An empty
    table gives a manifest without files. Ids may be numbers or text, null or repeated; payloads may be of any length that a
    row can have; no other column of ``pages``, whatever its name, is read.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = with_originals(pages, id_col, url_col, html_col, least_bytes)
    order = [F.col("id").asc_nulls_last(), "digest", "tie", "url"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "url", "payload", "original", "first", "revisit")

    def write(it):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out, done, number = None, [], 0

        def close():
            out.close()
            move(temporary, f"{folder}/{name}")
            done.append((part, number, name, records, size, digest.hexdigest()))

        for batch in it:
            columns = [c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(3), batch.column(4), batch.column(5))]
            for k, (page_id, url, original, is_first, is_revisit) in enumerate(zip(*columns)):
                if out is None:
                    name, records, size, digest = f"part-{part:06d}-{number:04d}.warc.gz", 0, 0, hashlib.sha256()
                    temporary = f"{folder}/_temporary-{attempt}-{name}"
                    out = open_for_writing(temporary)
                data = _gzip(_record(page_id, url, batch.column(2)[k].as_py(), original, is_first, is_revisit, f"{part}-{number}-{records}", date), level)
                out.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["part", "number", "name", "records", "bytes", "sha256"])

    made = sorted(ranged.mapInArrow(write, "part long, number long, name string, records long, bytes long, sha256 string").collect())
    files = [r.asDict() for r in made]
    with open_for_writing(f"{folder}/_manifest.tmp") as f:
        f.write(json.dumps({"files": files}).encode())
    move(f"{folder}/_manifest.tmp", f"{folder}/manifest.json")
    return folder, files


def records(path: str):
    """Headers (by lower-case name) and block of each record of a gzipped WARC file, read as a stream."""
    with open_for_reading(path) as f:
        one, data, rest = zlib.decompressobj(31), bytearray(), f.read(_READ)
        while rest:
            data += one.decompress(rest)
            rest = one.unused_data if one.eof else f.read(_READ)
            if one.eof:
                head, _, block = bytes(data).partition(b"\r\n\r\n")
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                headers = {k.lower(): v for k, v in headers.items()}
                yield headers, block[: int(headers["content-length"])]
                one, data, rest = zlib.decompressobj(31), bytearray(), rest or f.read(_READ)
        if data:
            raise ValueError(f"{path} ends within a record")


def read_warc(spark: SparkSession, folder: str, files: list[dict], id_type: str = "bigint") -> DataFrame:
    """page_id (of ``id_type``, an integer or string type), url, record_type, refers_to, payload_bytes, payload_digest (bare base32 SHA-1) and payload (null for
    revisits) of each record in the files listed. Block digests, and the payload's of responses, are verified."""
    numbers = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}
    id_kind, id_arrow = (int, numbers[id_type]) if id_type in numbers else (str, pa.string())
    schema = f"page_id {id_type}, url string, record_type string, refers_to {id_type}, payload_bytes long, payload_digest string, payload binary"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["name"],) for f in files], "name string").repartition(len(files))

    def row(headers, block, name):
        kind = headers["warc-type"]
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"{name}: a block doesn't have its digest")
        payload, digest = block.partition(b"\r\n\r\n")[2], headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(headers["warc-payload-length"])):
            raise ValueError(f"{name}: a payload doesn't have its digest")
        refers = headers.get("warc-refers-to")
        return _page_id(headers["warc-record-id"], id_kind), headers.get("warc-target-uri"), kind, refers and _page_id(refers, id_kind), int(headers["warc-payload-length"]), digest, payload if kind == "response" else None

    def read(it):
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [id_arrow, pa.string(), pa.string(), id_arrow, pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for b in it:
            for name in b.column(0).to_pylist():
                some, size = [], 0
                for headers, block in records(f"{folder}/{name}"):
                    some.append(row(headers, block, name))
                    size += len(block)
                    if size >= 4 << 20 or len(some) >= 2000:
                        yield batch(some)
                        some, size = [], 0
                if some:
                    yield batch(some)

    return listed.mapInArrow(read, schema)
