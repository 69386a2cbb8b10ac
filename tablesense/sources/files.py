"""Files of a context folder as DataFrames: listing, kinds, tables, JSON records, texts and documents."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tablesense.functions.cells import strip

TABLE_KINDS = ("csv", "tsv", "json", "jsonl", "db", "sqlite", "sqlite3")
TEXT_KINDS = ("md", "txt", "docx", "pdf")
#: Names that answers are written under, which are no sources; and the file of rules.
RESERVED = ("answer.csv", "prediction.csv", "operator_codegen_answer.csv", "operator_local_repair_answer.csv", "operator_retry_answer.csv", "repaired_answer.csv")
RULE_FILE = "knowledge.md"


def resolve(root: str, relative: str) -> str:
    """The path of a file inside ``root``; one that leads out of it, or to nothing, is refused."""
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{relative} leads out of the context")
    if not path.exists():
        raise FileNotFoundError(relative)
    return str(path)


def kind_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def listing(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """path (under root), name, kind, length, role: files that aren't hidden nor reserved. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = "^.*?" + re.escape(str(root).replace("file://", "").rstrip("/")) + "/"
    rows = found.select(F.regexp_replace("path", base, "").alias("path"), "length").withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.") & ~F.lower("name").isin(*RESERVED))
    if depth is not None:
        rows = rows.where(F.size(F.split("path", "/")) <= depth)
    role = F.when(F.lower("name") == RULE_FILE, "semantic_rule").otherwise("data")
    return rows.select("path", "name", kind_of(F.col("path")).alias("kind"), "length", role.alias("role"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All cells as text; quoted line ends stay; short rows are padded with '', long ones cut."""
    df = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, mode="PERMISSIVE").csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A file by its kind: csv, tsv, parquet, json, jsonl."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_delimited(spark, path)
    if kind in ("tsv", "tab"):
        return read_delimited(spark, path, "\t")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        return read_records(spark, path)
    raise ValueError(f"no table reader for {kind}")


def record_field(schema: StructType) -> str | None:
    """Which field of a JSON object holds its records: 'records', else the first list of objects that isn't its description."""
    lists = [f.name for f in schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    return "records" if "records" in lists else next((n for n in lists if n not in ("table", "schema", "metadata")), None)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: those of a list, or of the list that an object wraps; an object without one is a record."""
    df = spark.read.option("multiLine", True).json(path)
    name = record_field(df.schema)
    return df.select(F.inline(name)) if name else df


def json_profile(df: DataFrame) -> DataFrame:
    """Only the scalar fields of records: nested ones aren't profiled."""
    return df.select(*[c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def preview(text: Column, most: int = 4000) -> tuple[Column, Column]:
    """The beginning of a text, and whether it is all."""
    return F.substring(text, 1, most), F.char_length(text) > most


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with ' | ' between cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [words(p) for p in body.findall(f"{_W}p")]
    lines += [" | ".join(words(c) for c in row.findall(f"{_W}tc")) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    return "\n".join(x for x in lines if x.strip())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of .md, .txt and .docx files; other kinds are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("kind", kind_of(F.col("path")))

    @F.pandas_udf("string")
    def decoded(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        def one(data: bytes, kind: str) -> str:
            if kind == "docx":
                return docx_text(data)
            if kind in ("md", "txt"):
                return data.decode("utf-8", "replace")
            raise ValueError(f"documents of kind {kind} can't be read")

        return pd.Series([one(d, k) for d, k in zip(contents, kinds)], dtype=object)

    return files.select("path", decoded("content", "kind").alias("text"))


def tasks(spark: SparkSession, root: str, ids: list[str] | None = None, difficulties: list[str] | None = None) -> DataFrame:
    """task_id, difficulty, question of a folder of tasks, in the order of their numbers. A task file holds these three and
    nothing else, and names its own folder."""
    raw = spark.read.text(f"{root}/task_*/task.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"/(task_\d+)/task\.json$", 1).alias("folder"), F.from_json("value", "map<string,string>").alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    good = (keys == F.array(*map(F.lit, ("difficulty", "question", "task_id")))) & (F.col("m")["task_id"] == F.col("folder"))
    checked = raw.withColumn("m", F.when(good, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("not a task: "), "folder")).cast("map<string,string>")))
    rows = checked.select(*[F.col("m")[k].alias(k) for k in ("task_id", "difficulty", "question")])
    if ids:
        rows = rows.where(F.col("task_id").isin(ids))
    if difficulties:
        rows = rows.where(F.lower("difficulty").isin([d.lower() for d in difficulties]))
    return rows.orderBy(F.element_at(F.split("task_id", "_"), -1).cast("int"))


def rule_text(texts: DataFrame) -> DataFrame:
    """One row: the texts of rule files, one after the other."""
    rules = texts.where(F.lower(F.element_at(F.split("path", "/"), -1)) == RULE_FILE)
    return rules.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: strip(x["text"])), "\n\n").alias("rules"))
