"""Profiles of JSON fields at any depth: which values a path has, how often, and how many different ones.

Documents are variants. Their containers are exploded some levels at a time in one pass, whose scalars are written without their
documents; what is nested deeper than that goes through another pass, until nothing is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesense.operators.profile import DISTINCT_CAP
from tablesense.sources import store

#: Levels of nesting that one pass explodes.
LEVELS = 5


def value_class(v: Column) -> tuple[Column, Column]:
    """(class, shown) of a scalar variant. true, 1 and 1.0 are of one class, as are false and 0; the text '1' is of another, and null of its own."""
    kind, text = F.schema_of_variant(v), v.cast("string")
    number = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    number = F.when(number == "-0", "0").otherwise(number)
    own = (
        F.when(kind == "VOID", "null")
        .when(kind == "STRING", F.concat(F.lit("s:"), text))
        .when(kind == "BOOLEAN", F.when(text == "true", "n:1").otherwise("n:0"))
        .otherwise(F.concat(F.lit("n:"), number))
    )
    return own, F.coalesce(text, F.lit("null"))


def json_scalars(df: DataFrame, pos: str, json_col: str) -> DataFrame:
    """pos, path, at, class, shown: a row per scalar of each document. A path is ``$`` with ``.key`` for each object and ``[]`` for each array on
    the way; at has the places in them, by which scalars of one document are ordered (an object's keys are in alphabetical order).
    Texts that aren't JSON, and null ones, have none; empty objects and arrays have none."""
    spark = df.sparkSession
    variant = F.col(json_col) if dict(df.dtypes)[json_col] == "variant" else F.try_parse_json(F.col(json_col).cast("string"))
    level = df.select(F.col(pos).alias("pos"), F.lit("$").alias("path"), F.array().cast("array<int>").alias("at"), variant.alias("v")).where("v is not null")
    level, parts = level.withColumn("nested", _is_container(F.col("v"))), []
    own, shown = value_class(F.col("v"))
    while True:
        for _ in range(LEVELS):
            level = _exploded(spark, level)
        scalar = [F.when(~F.col("nested"), c).alias(name) for name, c in (("class", own), ("shown", shown))]
        written = store.written(level.select("pos", "path", "at", *scalar, F.when(F.col("nested"), F.col("v")).alias("v")), "json-scalars")
        parts.append(written.where("class is not null").drop("v"))
        deeper = written.where("v is not null")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        level = deeper.select("pos", "path", "at", "v", F.lit(True).alias("nested"))


def _exploded(spark: SparkSession, level: DataFrame) -> DataFrame:
    """What is in the containers, and the scalars as they are; empty containers are gone."""
    each = level.alias("t").lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("t.nested").outer(), F.col("t.v").outer())).alias("e"))
    nested = F.col("t.nested")
    path = F.concat(F.col("t.path"), F.coalesce(F.concat(F.lit("."), F.col("e.key")), F.lit("[]")))
    value = F.when(nested, F.col("e.value")).otherwise(F.col("t.v"))
    inside = F.when(nested, _is_container(F.col("e.value"))).otherwise(False)
    columns = F.col("t.pos").alias("pos"), F.when(nested, path).otherwise(F.col("t.path")).alias("path"), F.when(nested, F.concat(F.col("t.at"), F.array("e.pos"))).otherwise(F.col("t.at")).alias("at")
    return each.select(*columns, value.alias("v"), inside.alias("nested")).where("v is not null")


def _is_container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<")


def json_field_profile(df: DataFrame, pos: str, json_col: str, k: int = 5, cap: int | None = DISTINCT_CAP) -> DataFrame:
    """path, rank, value, cnt, cardinality, n: of each path its ``k`` most frequent values, ties by first appearance; how many different values there
    are, with ``cap`` no more than it: then only the first so many different values by appearance count; and how many scalars the path has.
    A value is shown as its class was seen first."""
    # numbers only are kept while all scalars are counted, which needs no sort; of texts and places there are then as many as differ
    counts = json_scalars(df, pos, json_col).groupBy("path", "class", "shown", "at").agg(F.count("*").alias("c"), F.min("pos").alias("pos"))
    place = F.struct("pos", "at")
    seen = counts.groupBy("path", "class").agg(F.sum("c").alias("cnt"), F.min(place).alias("first"), F.min_by("shown", place).alias("value"))
    totals = seen.groupBy("path").agg(F.sum("cnt").alias("n"), F.count("*").alias("different"))
    if cap is not None:
        nth = F.row_number().over(Window.partitionBy("path").orderBy("first"))
        seen = seen.withColumn("nth", nth).where(F.col("nth") <= cap)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("cnt"), "first"))
    best = seen.withColumn("rank", rank).where(F.col("rank") <= k)
    limit = F.col("different") if cap is None else F.least("different", F.lit(cap))
    return best.join(totals, "path").select("path", F.col("rank").cast("long").alias("rank"), "value", "cnt", limit.cast("long").alias("cardinality"), "n")
