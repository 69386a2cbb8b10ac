"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests), one temporary folder per process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="tablesense-")
        atexit.register(shutil.rmtree, _own["root"], ignore_errors=True)
    return "file://" + _own["root"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it isn't created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a written Parquet table: its lineage ends here, and a lost executor costs no more than a reread."""
    path = folder or new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *folders: str) -> None:
    """Deletes folders that no later plan reads, in whatever file system they are."""
    jvm = spark._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stage`` whose tables go when the block ends, by failure too. What the block returns mustn't read them."""
    folders: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        folders.append(new_folder(spark, name))
        return stage(df, name, folders[-1])

    try:
        yield put
    finally:
        delete(spark, *folders)


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in staged:
        delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more; it notices those on JVM collection only."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text's UTF-8 bytes; null: of none. Texts of one key are taken to be equal."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
