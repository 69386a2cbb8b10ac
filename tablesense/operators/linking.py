"""Which columns can be joined, and which columns a question's words mean. Inputs are catalogs, a row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.functions.cells import join_key
from tablesense.functions.names import binding_score, norm_name


def links_by_value(catalog: DataFrame, least: float = 0.15, most: int = 8) -> DataFrame:
    """left_source, left_column, right_source, right_column, jaccard: pairs of columns whose samples overlap, by an
    equality join on the values' key forms. Each pair comes once, in the order of source and column."""
    keys = F.array_distinct(F.filter(F.transform("samples", lambda v: join_key(v)), lambda v: v.isNotNull()))
    columns = catalog.select("source", "col_name", keys.alias("keys")).where(F.size("keys") > 0)
    values = columns.select("source", "col_name", F.size("keys").alias("n"), F.explode("keys").alias("v"))
    a, b = values.alias("a"), values.alias("b")
    before = (F.col("a.source") < F.col("b.source")) | ((F.col("a.source") == F.col("b.source")) & (F.col("a.col_name") < F.col("b.col_name")))
    pairs = a.join(b, (F.col("a.v") == F.col("b.v")) & before)
    ends = [F.col("a.source").alias("left_source"), F.col("a.col_name").alias("left_column"), F.col("b.source").alias("right_source"), F.col("b.col_name").alias("right_column")]
    met = pairs.groupBy(*ends, F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("met"))
    scored = met.withColumn("jaccard", F.round(F.col("met") / (F.col("na") + F.col("nb") - F.col("met")), 3)).where(F.col("jaccard") >= least)
    return scored.drop("na", "nb", "met").orderBy(F.desc("jaccard"), "left_source", "left_column", "right_source", "right_column").limit(most)


def links_by_name(catalog: DataFrame, most: int = 40) -> DataFrame:
    """left_source, left_column, right_source, right_column, reason: columns of different sources that have the same
    normalised name (same_normalized_name), or are linkto<x> and <x>id (link_to_foreign_key), or, where two sources share no
    name, are ids one of whose stems is in the other (related_id_name)."""
    names = catalog.select("source", "col_name", norm_name(F.col("col_name")).alias("name"))
    names = names.withColumn("stem", F.when(F.col("name").endswith("id") & (F.length("name") > 2), F.expr("substring(name, 1, length(name) - 2)")))
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, F.col("a.source") < F.col("b.source"))
    false = F.lit(False)
    same = F.col("a.name") == F.col("b.name")
    stems = F.coalesce(F.contains(F.col("a.stem"), F.col("b.stem")) | F.contains(F.col("b.stem"), F.col("a.stem")), false)
    link = F.coalesce(F.col("a.name") == F.concat(F.lit("linkto"), F.col("b.stem")), false) | F.coalesce(F.col("b.name") == F.concat(F.lit("linkto"), F.col("a.stem")), false)
    shares = F.max(same).over(Window.partitionBy("a.source", "b.source"))
    reason = F.when(same, "same_normalized_name").when(link, "link_to_foreign_key").when(stems & ~shares, "related_id_name")
    out = pairs.withColumn("reason", reason).where("reason is not null")
    out = out.select(F.col("a.source").alias("left_source"), F.col("a.col_name").alias("left_column"), F.col("b.source").alias("right_source"), F.col("b.col_name").alias("right_column"), "reason")
    return out.orderBy("left_source", "right_source", "reason", "left_column", "right_column").limit(most)


def bind_concepts(concepts: DataFrame, catalog: DataFrame, least: float = 0.4, most: int = 3) -> DataFrame:
    """concept, source, col_name, score, rank: the columns that each concept may mean, best first."""
    scored = concepts.crossJoin(catalog).withColumn("score", F.round(binding_score(F.col("concept"), F.col("col_name"), F.col("samples"), F.col("cardinality")), 4))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("score"), "source", "col_name"))
    return scored.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most).select("concept", "source", "col_name", "score", "rank")


def closest_path(files: DataFrame, wanted: str) -> DataFrame:
    """The listed path with the wanted one's suffix that is fewest edits away."""
    suffix = wanted.rsplit(".", 1)[-1].lower()
    alike = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)) == suffix)
    return alike.agg(F.min_by("path", F.struct(F.levenshtein(F.col("path"), F.lit(wanted)), "path")).alias("path")).where("path is not null")
