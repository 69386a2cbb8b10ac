"""Folders that appear whole or not at all, and a cache of computed rows that many writers share.

Whatever is written goes to a folder of its own first and takes its place by one rename, in whatever file system it is.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder named by ``spark.checkpoint.dir``; where that is unset (tests), in one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if "root" not in _own:
            _own["root"] = tempfile.mkdtemp(prefix="tablesense-")
            atexit.register(shutil.rmtree, _own["root"], ignore_errors=True)
        root = "file://" + _own["root"]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a work folder, for what several plans read: it is computed once, and its lineage ends here."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return fs.exists(where)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where it isn't there."""
    where, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _place(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _place(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a manifest."""
    where, fs = _place(spark, path)
    read = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(read)).decode()
    finally:
        read.close()


def commit(spark: SparkSession, staged: str, final: str) -> bool:
    """Gives a whole folder its name; False, and the folder is deleted, if another one has it already. Of two writers that name
    their folders alike one wins, and readers see its folder only."""
    (source, fs), (target, _) = _place(spark, staged), _place(spark, final)
    if not fs.exists(target):
        fs.mkdirs(target.getParent())
        if fs.rename(source, target):
            inside, _ = _place(spark, f"{final}/{staged.rstrip('/').rsplit('/', 1)[-1]}")
            if not fs.exists(inside):
                return True
            fs.delete(inside, True)  # the name was taken in between, and some file systems move into it
            return False
    fs.delete(source, True)
    return False


def content_key(*parts: Column, digits: int = 32) -> Column:
    """A key of a request's contents: equal for equal texts only, as far as SHA-256 goes; a null part isn't an empty one."""
    told = [F.coalesce(F.concat(F.char_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(",", *told).cast("binary"), 256), 1, digits)


class Cache:
    """Rows by a content key, in a folder of segments. A segment is one writer's rows: Parquet and a manifest, written aside and renamed
    into ``segments``, so that readers see it whole or not at all and no writer waits for another. A key that two writers computed at the
    same time is in two segments; the segment that sorts first is read."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "key"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def segments(self) -> list[str]:
        return folders_in(self.spark, f"{self.folder}/segments")

    def manifest(self, segment: str) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/segments/{segment}/manifest.json"))

    def read(self) -> DataFrame | None:
        """All rows, one of each key; None for a cache without segments. Segments must have the same columns."""
        names = self.segments()
        if not names:
            return None
        schema = StructType.fromJson(self.manifest(names[0])["schema"])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/segments/{n}/rows" for n in names])
        if len(names) == 1:
            return rows
        whole = F.min_by(F.struct(*schema.names), F.col("_metadata.file_path")).alias("__row")
        return rows.groupBy(F.col(self.key).alias("__key")).agg(whole).select("__row.*")

    def put(self, rows: DataFrame) -> str:
        """Adds rows (one of each key) as a segment and returns its name."""
        name = uuid.uuid4().hex
        staged = f"{self.folder}/_staged-{name}"
        rows.write.parquet(f"{staged}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{staged}/rows").count()
        write_text(self.spark, f"{staged}/manifest.json", json.dumps({"segment": name, "key": self.key, "rows": written, "schema": rows.schema.jsonValue()}))
        if not written:
            delete(self.spark, staged)
        elif not commit(self.spark, staged, f"{self.folder}/segments/{name}"):
            raise FileExistsError(name)
        return name

    def get(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of the requests' keys. ``compute`` is given the requests of keys that aren't there yet, one of each, and returns a row of each."""
        have = self.read()
        new = requests.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        if have is not None:
            new = new.join(have.select(self.key), self.key, "left_anti")
        if not new.isEmpty():
            self.put(compute(new))
        have = self.read()
        if have is None:
            return compute(new)
        return have.join(requests.select(self.key).distinct(), self.key, "left_semi")
