"""What is known of a task's sources, as text within a budget of characters, in four modes.

Each source is a block, rendered by columns of a profile; tables come before other kinds, by name. Blocks that don't fit give way to a line that
names them. Texts of documents are sections: the first ones, or those that the question asks about, or passages that were retrieved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.operators.context import KIND_ORDER, rendered, shown_kind
from tablesense.operators.documents import flat_sections, focused_sections


@dataclass(frozen=True)
class Mode:
    """budget of characters for a task, samples of each column, sections of each text and characters of each; whether sections are chosen by the
    question, and whether retrieved passages stand in place of all sections, in so many characters."""

    budget: int
    samples: int
    sections: int
    chars: int
    by_question: bool = False
    passages: int = 0


#: The modes' budgets and sizes.
MODES = {
    "schema": Mode(8_000, 0, 2, 400),
    "samples": Mode(12_000, 5, 2, 600),
    "focused": Mode(10_000, 4, 3, 900, by_question=True),
    "retrieved": Mode(12_000, 4, 0, 0, passages=6_000),
}


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _table_block(mode: Mode) -> Column:
    def column_line(c: Column) -> Column:
        values = F.transform(F.slice(c["samples"], 1, max(1, mode.samples)), lambda s: s["value"])
        shown = F.concat(F.lit(": "), F.array_join(values, " | ")) if mode.samples else F.lit("")
        return F.concat(F.lit("- "), c["name"], F.lit(" ("), c["dtype"], F.lit(", "), c["cardinality"].cast("string"), F.lit(" different)"), shown)

    return _lines(F.concat(F.col("row_count").cast("string"), F.lit(" rows")), F.array_join(F.transform("columns", column_line), "\n"))


def _text_blocks(texts: DataFrame, questions: DataFrame, mode: Mode) -> DataFrame:
    """task_id, source, body: sections of each text that are shown, cut to the mode's characters."""
    keyed = texts.select(F.struct("task_id", "source").alias("__id"), "text")
    sections = flat_sections(keyed, "__id", "text")
    if mode.by_question:
        asked = sections.withColumn("task_id", F.col("__id.task_id")).join(questions.select("task_id", "question"), "task_id")
        sections = focused_sections(asked, "__id", F.col("question"), mode.sections)
    else:
        nth = F.row_number().over(Window.partitionBy("__id").orderBy("section_no"))
        sections = sections.withColumn("__nth", nth).where(F.col("__nth") <= mode.sections)
    cut = F.when(F.char_length("body") > mode.chars, F.concat(F.substring("body", 1, mode.chars), F.lit("…"))).otherwise(F.col("body"))
    each = F.struct("section_no", F.concat(F.lit("### "), "heading", F.lit("\n"), cut).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), "\n")
    return sections.groupBy("__id").agg(joined.alias("body")).select("__id.task_id", "__id.source", "body")


def render_context(profiles: DataFrame, texts: DataFrame, mode: str, passages: DataFrame | None = None) -> DataFrame:
    """task_id, text, of every task with a source. profiles: of ``task_profiles``; texts: task_id, source, text of its documents; passages, for the
    mode that shows them: task_id, rank, text, of which as many are shown as fit the part of the budget that is theirs, the first always."""
    m = MODES[mode]
    sources = profiles.select("task_id", "question", F.explode("sources").alias("s")).select("task_id", "question", "s.*")
    kind = shown_kind(F.col("kind"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind), F.lit(0)), F.lit(len(KIND_ORDER) + 1))
    order = Window.partitionBy("task_id").orderBy(place, "source")
    placed = sources.withColumn("pos", F.row_number().over(order).cast("long"))
    if m.sections:
        placed = placed.join(_text_blocks(texts, profiles, m), ["task_id", "source"], "left")
    else:
        placed = placed.withColumn("body", F.lit(None).cast("string"))
    head = F.concat(F.lit("## "), "source", F.lit("\n("), "kind", F.when(F.col("role") == "semantic_rule", ", rules").otherwise(""), F.lit(", "), F.coalesce(F.col("length").cast("string"), F.lit("?")), F.lit(" bytes)"))
    block = F.concat(_lines(head, F.when(F.col("columns").isNotNull(), _table_block(m)), F.col("body")), F.lit("\n"))
    blocks = placed.select("task_id", "pos", F.col("source").alias("title"), block.alias("block"))
    found = rendered(blocks, "task_id", "pos", "block", "title", m.budget - m.passages)
    if not m.passages or passages is None:
        return found
    so_far = F.sum(F.char_length("text") + 1).over(Window.partitionBy("task_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = passages.select("task_id", "rank", F.substring("text", 1, m.passages).alias("text")).withColumn("__used", so_far).where((F.col("__used") <= m.passages) | (F.col("rank") == 1))
    told = kept.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("told"))
    return found.join(told, "task_id", "left").select("task_id", F.concat("text", F.coalesce(F.concat(F.lit("## retrieved passages\n"), "told", F.lit("\n")), F.lit(""))).alias("text"))
