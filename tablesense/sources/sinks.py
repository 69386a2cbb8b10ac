"""Answers, traces and derived tables as files."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablesense.sources.store import Cache, write_text


def write_answer(df: DataFrame, path: str, single_file: bool = True) -> None:
    """CSV with a header. An answer is a small table: one file by default."""
    check_answer(df)
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def check_answer(df: DataFrame) -> None:
    if not df.columns or not all(isinstance(c, str) and c.strip() for c in df.columns):
        raise ValueError("an answer has columns, and each has a name")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, sep="\t").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_trace(spark: SparkSession, trace: Mapping, path: str) -> None:
    write_text(spark, path, json.dumps(trace, indent=2, ensure_ascii=False, default=str))


def synthesised_name(path: str) -> str:
    """What the table extracted from a document is called."""
    return path.removesuffix(".md").replace("/", "__") + ".synth.csv"


def to_table(spark: SparkSession, result: object) -> DataFrame:
    """A result as a table: a DataFrame as it is, a list of records by their fields, other lists and scalars as column value."""
    if isinstance(result, DataFrame):
        return result
    if isinstance(result, Mapping):
        result = [result]
    if isinstance(result, list) and result and all(isinstance(r, Mapping) for r in result):
        return spark.createDataFrame([dict(r) for r in result])
    values = result if isinstance(result, list | tuple) else [result]
    return spark.createDataFrame([(None if v is None else str(v),) for v in values], "value string")


def finding_preview(df: DataFrame, most: int = 20) -> tuple[DataFrame, bool]:
    """The first rows, and whether there are more."""
    return df.limit(most), df.limit(most + 1).count() > most


def cached(spark: SparkSession, requests: DataFrame, path: str, key: str, compute) -> DataFrame:
    """Results of ``compute`` for the requests, kept in a folder by key: only new keys are computed, by any number of writers."""
    return Cache(spark, path, key).get(requests, compute)
