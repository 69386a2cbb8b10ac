"""Column profiles: counts, frequent values, types and cardinalities, in one pass over a table in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.functions.cells import cell_dtype

DISTINCT_CAP = 60


def long_form(df: DataFrame, columns: Sequence[str] | None = None, pos: str | None = None) -> DataFrame:
    """pos, col_name, value: a row per cell, as text. One generator makes all columns' cells from one scan."""
    columns = list(columns or [c for c in df.columns if c != pos])
    place = F.col(pos) if pos else F.monotonically_increasing_id()
    cells = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(place.alias("pos"), F.explode(cells).alias("cell")).select("pos", "cell.col_name", "cell.value")


def value_frequencies(cells: DataFrame, cap: int | None = DISTINCT_CAP) -> DataFrame:
    """col_name, value, cnt, first_pos: with ``cap``, of the first so many distinct values by first appearance. Null counts as ''."""
    seen = cells.groupBy("col_name", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    if cap is None:
        return seen
    nth = F.row_number().over(Window.partitionBy("col_name").orderBy("first_pos", "value"))
    return seen.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def top_values(frequencies: DataFrame, k: int = 5) -> DataFrame:
    """col_name, value, cnt, rank: the most frequent values, ties by first appearance."""
    rank = F.row_number().over(Window.partitionBy("col_name").orderBy(F.desc("cnt"), "first_pos", "value"))
    return frequencies.withColumn("rank", rank).where(F.col("rank") <= k).select("col_name", "value", "cnt", "rank")


def cardinalities(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("col_name").agg(F.count("*").alias("cardinality"))


def dtype_votes(cells: DataFrame) -> DataFrame:
    """col_name, dtype: the type most cells have, empty ones voting too; a tie goes to the type seen first."""
    votes = cells.groupBy("col_name", cell_dtype(F.col("value")).alias("dtype")).agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    return votes.groupBy("col_name").agg(F.max_by("dtype", F.struct("cnt", -F.col("first_pos"))).alias("dtype"))


def profile(df: DataFrame, source: str, columns: Sequence[str] | None = None, pos: str | None = None) -> DataFrame:
    """The catalog's row of each column: source, col_name, dtype, cardinality (at most the cap), samples (the five most frequent)."""
    cells = long_form(df, columns, pos)
    frequencies = value_frequencies(cells)
    best = top_values(frequencies).groupBy("col_name").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t")).select("col_name", F.transform("t", lambda t: t["value"]).alias("samples"))
    return dtype_votes(cells).join(cardinalities(frequencies), "col_name").join(best, "col_name").select(F.lit(source).alias("source"), "col_name", "dtype", "cardinality", "samples")


def exact_profile(df: DataFrame, column: str, k: int = 5, cap: int = DISTINCT_CAP) -> DataFrame:
    """A database column's profile: exact cardinality without nulls; samples only if it is at most ``cap``; nulls may be samples."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    total = counts.agg(F.count("value").alias("cardinality"))
    best = counts.orderBy(F.desc("cnt"), F.col("value").asc_nulls_first()).limit(k)
    return best.crossJoin(F.broadcast(total)).where(F.col("cardinality") <= cap)


def field_order(df: DataFrame, record: str, pos: str) -> DataFrame:
    """field, first_pos, first_at: the fields of map records, in the order in which they are first seen."""
    each = df.select(pos, F.posexplode(F.map_keys(record)).alias("at", "field"))
    return each.groupBy("field").agg(F.min(F.struct(F.col(pos).alias("first_pos"), F.col("at").alias("first_at"))).alias("m")).select("field", "m.first_pos", "m.first_at")


def size_totals(files: DataFrame) -> DataFrame:
    """Of a file listing (path, kind, length): files, kinds, bytes, and bytes of documents and of tables."""
    docs, tables = F.col("kind").isin("md", "txt", "docx", "pdf", "record_text"), F.col("kind").isin("csv", "tsv", "json", "jsonl", "db", "sqlite", "sqlite3")
    return files.agg(
        F.count("*").alias("file_count"),
        F.count_distinct("kind").alias("kind_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(docs, F.col("length"))), F.lit(0)).alias("document_bytes"),
        F.coalesce(F.sum(F.when(tables, F.col("length"))), F.lit(0)).alias("table_bytes"),
    )
