"""The corpus pipeline: five stages, each one operator over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesense.llm import decontamination, packing, quality_classifier, simhash, substrings
from tablesense.llm.queries import tokenizer_path
from tablesense.llm.shared import discard, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_col="quality", max_documents=6000)
    return quality_classifier.keep_accepted(docs, model, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id."""
    return simhash.keep_one_per_group(docs, distance=4, shingle=4, seed=42)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once; n_chars is the new length."""
    return substrings.remove_substrings(docs, length=200)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window of 10 words."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences, at most 2048 tokens each."""
    placed = packing.pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Learned scores, fingerprints and tokens aren't expressible in SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if read is not None:
            discard(read)  # what the last stage has written is all that the next one reads
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
