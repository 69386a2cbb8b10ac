"""Folders of runs: the answers of many tasks, scored at once against their gold tables."""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.functions.cells import match_token
from tablesense.operators.answers import run_summary, score_run, signed

_CELLS = "task_id string, col_idx int, value string, there boolean"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def task_names(spark: SparkSession, run_dir: str) -> list[str]:
    """Names of a run's task folders (``task_*``), sorted as text; none where there is no such run."""
    where, fs = _folder(spark, run_dir)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("task_"))


def _cell_rows(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")))
            width = len(rows[0]) if rows else 0
            task, places = path.split("/")[-2], range(width)
            # A row of the wrong width is cut, or filled up with nulls. A place of -1 is a table without columns.
            cells = [(i, row[i] if i < len(row) else None, True) for row in rows[1:] for i in places]
            cells += [(i, None, False) for i in places] or [(-1, None, False)]
            idx, values, there = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(cells)), pa.array(idx, pa.int32()), pa.array(values, pa.string()), pa.array(there)], names=["task_id", "col_idx", "value", "there"])


def file_signatures(spark: SparkSession, root: str, name: str, tolerance: float = 1e-2) -> DataFrame:
    """task_id, col_idx, signature of the files ``root/task_*/name`` (CSV with a header). One file is one row until it is read: an answer is a
    small table. Files that aren't there have no rows."""
    where, fs = _folder(spark, root)
    if not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, f"task_*/{name}")):
        return spark.createDataFrame([], "task_id string, col_idx int, signature string")
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/task_*/{name}").select("path", "content")
    token = F.when(F.col("there"), match_token(F.col("value"), tolerance))
    return signed(found.mapInArrow(_cell_rows, _CELLS).select("task_id", "col_idx", token.alias("token")), "task_id", "col_idx")


def score_folder(spark: SparkSession, run_dir: str, gold_root: str, penalty: float = 0.5, tolerance: float = 1e-2) -> DataFrame:
    """Scores of all tasks of a run, ``run_dir/task_*/prediction.csv`` against ``gold_root/task_*/gold.csv``: a row per task folder."""
    tasks = spark.createDataFrame([(t,) for t in task_names(spark, run_dir)], "task_id string")
    gold, own = file_signatures(spark, gold_root, "gold.csv", tolerance), file_signatures(spark, run_dir, "prediction.csv", tolerance)
    return score_run(tasks, gold, own, penalty)


def write_score_summary(spark: SparkSession, scores: DataFrame, run_dir: str) -> str:
    """``score_summary.json`` in the run's folder: the means, and a record per task in order of names. Returns its path."""
    summary = run_summary(scores).first().asDict() | {"run_dir": run_dir, "per_task": [r.asDict() for r in scores.orderBy("task_id").collect()]}
    where, fs = _folder(spark, f"{run_dir.rstrip('/')}/score_summary.json")
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(summary, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    return where.toString()
