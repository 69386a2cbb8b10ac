"""Profiles of tasks: what is known of every column of every source of every task, from one job over all of their cells.

All sources of all tasks become cells of one shape, tagged by task, source and column. Cells are counted by their value, and all
statistics are sums over these counts, so they merge whatever way the sources are split.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.functions.cells import cell_dtype
from tablesense.operators.profile import DISTINCT_CAP
from tablesense.plans import routing as G
from tablesense.operators.context import route
from tablesense.sources.files import RULE_FILE, TABLE_KINDS, TEXT_KINDS

_COLUMN = ("task_id", "source", "col_no", "col_name")
#: Samples and columns that a view of a source shows.
VIEW_SAMPLES, VIEW_COLUMNS = 5, 80
_IMAGES = ("png", "jpg", "jpeg", "webp")
#: The types of tasks, and the columns of a route audit.
TASK_TYPES = ("record_text_with_semantic_rule", "table_with_semantic_rule", "mixed_context", "document_qa", "table_computation", "image_understanding", "pure_reasoning")
AUDIT_COLUMNS = (
    "task_id",
    "difficulty",
    "task_type",
    "answer_type",
    "budget",
    "llm_budget",
    "tool_budget",
    "route",
    "route_reason",
    "kind",
    "model",
    "primary_tool",
    "auxiliary_tools",
    "modalities",
    "operations",
    "source_kinds",
    "sources",
    "flags",
)


def tagged_cells(sources: Mapping[tuple[str, str], tuple[DataFrame, str | None]]) -> DataFrame:
    """task_id, source, col_no, col_name, pos, value of the sources, by (task, name of the source); each comes with the column that orders its
    rows, or None for their order as they are read. Names of columns may repeat."""
    parts = []
    for (task, source), (df, pos) in sources.items():
        place = F.col(pos).cast("long") if pos else F.monotonically_increasing_id()
        names = df.columns
        plain = df.withColumn("__pos", place)
        plain = plain.toDF(*[f"c{i}" for i in range(len(names))], "__pos")
        cells = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(n).alias("col_name"), F.coalesce(F.col(f"c{i}").cast("string"), F.lit("")).alias("value")) for i, n in enumerate(names)])
        parts.append(plain.select(F.lit(task).alias("task_id"), F.lit(source).alias("source"), F.col("__pos").alias("pos"), F.explode(cells).alias("c")).select("task_id", "source", "c.col_no", "c.col_name", "pos", "c.value"))
    return reduce(DataFrame.unionByName, parts)


def column_profiles(cells: DataFrame, samples: int = VIEW_SAMPLES, cap: int = DISTINCT_CAP) -> DataFrame:
    """A row per column: row_count, n_empty, dtype (the type of most cells, a tie to the first seen), cardinality (at most ``cap``) and
    samples (value, cnt: the most frequent of the first ``cap`` values)."""
    seen = cells.groupBy(*_COLUMN, "value").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    votes = seen.groupBy(*_COLUMN, cell_dtype(F.col("value")).alias("dtype")).agg(F.sum("cnt").alias("cells"), F.min("first_pos").alias("first_pos"), F.count("*").alias("different"))
    whole = votes.groupBy(*_COLUMN).agg(
        F.sum("cells").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("dtype") == "empty", F.col("cells"))), F.lit(0)).alias("n_empty"),
        F.max_by("dtype", F.struct("cells", -F.col("first_pos"))).alias("dtype"),
        F.least(F.sum("different"), F.lit(cap)).cast("long").alias("cardinality"),
    )
    own = Window.partitionBy(*_COLUMN)
    capped = seen.withColumn("nth", F.row_number().over(own.orderBy("first_pos", "value"))).where(F.col("nth") <= cap)
    best = capped.withColumn("rank", F.row_number().over(own.orderBy(F.desc("cnt"), "first_pos", "value"))).where(F.col("rank") <= samples)
    listed = best.groupBy(*_COLUMN).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))), lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("cnt"))).alias("samples"))
    return whole.join(listed, list(_COLUMN))


def task_profiles(tasks: DataFrame, sources: Mapping[tuple[str, str], tuple[DataFrame, str | None]], files: DataFrame) -> DataFrame:
    """One nested row per task. tasks: task_id, difficulty, question; files: task_id, source, kind, length of all its sources, those that aren't
    tables too. Returns task_id, question, answer_shape, operations, task_type, primary_tool, difficulty (as estimated), stated_difficulty,
    auxiliary_tools, modalities, flags, budget_level, model_calls, tool_calls, and sources: an array, by name, of source, kind, role, length, row_count and columns (name, dtype,
    cardinality, n_empty, samples; in their order). A task without sources has an empty array."""
    columns = column_profiles(tagged_cells(sources)) if sources else None
    listed = files.select("task_id", "source", F.lower("kind").alias("kind"), "length", F.when(F.lower(F.element_at(F.split("source", "/"), -1)) == RULE_FILE, "semantic_rule").otherwise("data").alias("role"))
    if columns is None:
        per_source = listed.withColumns({"row_count": F.lit(None).cast("long"), "columns": F.lit(None).cast("array<struct<name:string,dtype:string,cardinality:bigint,n_empty:bigint,samples:array<struct<value:string,cnt:bigint>>>>")})
    else:
        ordered = F.array_sort(F.collect_list(F.struct("col_no", F.struct(F.col("col_name").alias("name"), "dtype", "cardinality", "n_empty", "samples").alias("column"))))
        described = columns.groupBy("task_id", "source").agg(F.max("row_count").alias("row_count"), F.transform(ordered, lambda x: x["column"]).alias("columns"))
        per_source = listed.join(described, ["task_id", "source"], "left")
    is_doc, rules = F.col("kind").isin("md", "txt", "docx", "pdf"), F.col("role") == "semantic_rule"
    per_task = per_source.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("source", "kind", "role", "length", "row_count", "columns"))).alias("sources"),
        F.count("*").alias("files"),
        F.count_distinct("kind").alias("kinds"),
        F.count_if(is_doc).alias("docs"),
        F.count_if(F.col("kind").isin("db", "sqlite", "sqlite3")).alias("dbs"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bool_or(F.col("kind").isin(*TABLE_KINDS)), F.lit(False)).alias("has_tables"),
        F.coalesce(F.bool_or(is_doc & ~rules), F.lit(False)).alias("has_documents"),
        F.coalesce(F.bool_or(F.col("kind") == "record_text"), F.lit(False)).alias("has_records"),
        F.coalesce(F.bool_or(rules), F.lit(False)).alias("has_rules"),
        F.coalesce(F.bool_or(F.col("kind").isin(*_IMAGES)), F.lit(False)).alias("has_images"),
        F.coalesce(F.bool_or(~F.col("kind").isin(*TABLE_KINDS, *TEXT_KINDS, *_IMAGES, "record_text")), F.lit(False)).alias("has_others"),
    )
    known = tasks.join(per_task, "task_id", "left").fillna(0, ["files", "kinds", "docs", "dbs", "bytes"]).fillna(False, ["has_tables", "has_documents", "has_records", "has_rules", "has_images", "has_others"])
    flags = F.filter(F.array(F.when(F.col("files") >= 4, "many_files"), F.when(F.col("has_rules"), "semantic_rule_context"), F.when(F.col("kinds") >= 2, "multiple_modalities")), lambda x: x.isNotNull())
    c = {n: F.col(n) for n in ("has_tables", "has_documents", "has_records", "has_rules", "has_images", "has_others")}
    known = known.withColumn("task_type", G.task_type(c["has_tables"], c["has_documents"], c["has_records"], c["has_rules"], c["has_images"]))
    level, model, tools = G.budget(F.col("task_type"), F.col("difficulty"), flags)
    points = G.difficulty_points(F.col("question"), F.col("files"), F.col("kinds"), F.col("docs"), F.col("dbs"), F.col("bytes"))
    nothing = per_task.schema["sources"].dataType
    return known.select(
        "task_id",
        "question",
        G.answer_shape(F.col("question")).alias("answer_shape"),
        G.operations(F.col("question"), c["has_documents"] | c["has_records"], c["has_tables"], c["has_rules"]).alias("operations"),
        "task_type",
        G.primary_tool(F.col("task_type"), F.col("dbs") > 0).alias("primary_tool"),
        G.difficulty_bucket(points).alias("difficulty"),
        F.col("difficulty").alias("stated_difficulty"),
        G.auxiliary_tools(F.col("task_type"), F.col("dbs") > 0).alias("auxiliary_tools"),
        G.modalities(c["has_tables"], c["has_documents"] | c["has_records"] | c["has_rules"], c["has_images"], c["has_others"]).alias("modalities"),
        flags.alias("flags"),
        level.alias("budget_level"),
        model.alias("model_calls"),
        tools.alias("tool_calls"),
        F.coalesce("sources", F.array().cast(nothing)).alias("sources"),
    )


def schema_view(profiles: DataFrame, samples: int = VIEW_SAMPLES, columns: int = VIEW_COLUMNS) -> DataFrame:
    """task_id, source, kind, row_count, column_count, columns: a projection of profiles that shows so many columns of each source and so many
    samples of each; nothing is read again."""
    each = profiles.select("task_id", F.explode("sources").alias("s")).select("task_id", "s.*")
    shown = F.transform(F.slice("columns", 1, columns), lambda x: x.withField("samples", F.slice(x["samples"], 1, samples)))
    return each.select("task_id", "source", "kind", "row_count", F.size(F.coalesce("columns", F.array().cast(each.schema["columns"].dataType))).alias("column_count"), shown.alias("columns"))


def route_audit(profiles: DataFrame, routes: Mapping[str, Mapping], by_type: Mapping[str, str] | None = None, default: str | None = None) -> DataFrame:
    """AUDIT_COLUMNS, all text: which route each task would take and why, beside what is known of it, for a file of tabs (tabs and line ends in
    values are blanks). ``routes`` have kind and model by name; routes are chosen by type, so there are as many choices as types."""
    taken = {t: route(t, routes, by_type, default) for t in TASK_TYPES}
    by = lambda values: F.create_map(*[F.lit(x) for t, v in values.items() for x in (t, str(v))])[F.col("task_type")]
    joined = lambda c, sep=",": F.array_join(c, sep)
    values = {
        "task_id": F.col("task_id"),
        "difficulty": F.col("stated_difficulty"),
        "task_type": F.col("task_type"),
        "answer_type": F.col("answer_shape"),
        "budget": F.col("budget_level"),
        "llm_budget": F.col("model_calls"),
        "tool_budget": F.col("tool_calls"),
        "route": by({t: n for t, (n, _) in taken.items()}),
        "route_reason": by({t: why for t, (_, why) in taken.items()}),
        "kind": by({t: routes[n].get("kind", "") for t, (n, _) in taken.items()}),
        "model": by({t: routes[n].get("model", "") for t, (n, _) in taken.items()}),
        "primary_tool": F.col("primary_tool"),
        "auxiliary_tools": joined(F.col("auxiliary_tools")),
        "modalities": joined(F.col("modalities")),
        "operations": joined(F.col("operations")),
        "source_kinds": joined(F.transform("sources", lambda s: F.concat_ws(":", s["kind"], s["role"])), ";"),
        "sources": joined(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["kind"])), ";"),
        "flags": joined(F.col("flags")),
    }
    return profiles.select(*[F.regexp_replace(F.coalesce(values[n].cast("string"), F.lit("")), r"[\t\n]", " ").alias(n) for n in AUDIT_COLUMNS])
