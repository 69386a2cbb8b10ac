"""What kind of task a question is: operations, shape of the answer, difficulty, budgets, tools, and the order of subtasks."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a question says what is to be done.
COUNT = r"\b(how many|number of|count of|count)\b"
AGGREGATE = r"\b(avg|average|mean|median|sum|total|minimum|maximum|min|max)\b"
RATIO = r"\b(ratio|percentage|percent|how many times|times as|as many as)\b"
TOP = r"\b(top\s+\d+|bottom\s+\d+|highest|lowest|largest|smallest|rank)\b"
COMPARE = r"\b(compare|difference|greater than|less than|more than|fewer than|between)\b"
JOIN = r"\b(whose|corresponding|associated|linked|related|match(?:ing)?)\b"
GROUP = r"\b(for each|per|group by|by each)\b"
FILTER = r"\b(where|whose|that|which|among|before|after|during|in \d{4})\b"
BOOLEAN = r"^\s*(is|are|was|were|does|do|did|has|have|can)\b"
WEAK = ("with", "by", "same", "times", "number", "after", "before")
#: Words that make a question harder, as parts of it.
AGGREGATION_WORDS = (
    "average", "avg", "mean", "median", "sum", "total", "count", "percentage", "percent", "ratio", "compare",
    "comparison", "difference", "trend", "max", "maximum", "min", "minimum", "highest", "lowest", "rank", "year-over-year", "growth", "between", "range",
)
HOP_WORDS = ["join", "across", "both", "also", "then", "first", "second", "third", "after", "before", "while", "during", "whose", "with the same", "from each", "for each", "by each", "per", "every"]
#: Calls of a model and of tools that each type of task may make, before additions.
BUDGETS = {
    "table_computation": (8, 18),
    "record_text_with_semantic_rule": (15, 36),
    "table_with_semantic_rule": (15, 34),
    "document_qa": (14, 28),
    "mixed_context": (14, 30),
    "image_understanding": (12, 22),
    "pure_reasoning": (8, 12),
}
DIFFICULTY_CALLS = {"easy": 0, "medium": 1, "hard": 2, "extreme": 4}
FLAG_CALLS = {
    "large_document_context": (6, 8),
    "large_table_context": (1, 10),
    "many_files": (1, 4),
    "multiple_modalities": (1, 4),
    "semantic_rule_context": (2, 4),
}
MOST_CALLS = (30, 60)
LEVELS = ((9, "small"), (14, "medium"), (22, "large"))


def answer_shape(question: Column) -> Column:
    q = F.lower(F.trim(question))
    return F.when(q.rlike(BOOLEAN), "boolean").when(q.rlike(COUNT) | q.rlike(AGGREGATE) | q.rlike(RATIO), "scalar").otherwise("table")


def operations(question: Column, has_documents: Column, has_tables: Column, has_rules: Column) -> Column:
    """The operations a question asks for, in the order in which they run."""
    q = F.lower(question)
    reads = has_documents | has_rules
    found = {
        "retrieve": reads,
        "extract": reads,
        "filter": q.rlike(FILTER),
        "join": q.rlike(JOIN) & has_tables,
        "groupby": q.rlike(GROUP),
        "aggregate": q.rlike(COUNT) | q.rlike(AGGREGATE),
        "sort": q.rlike(TOP),
        "topk": q.rlike(TOP),
        "compare": q.rlike(COMPARE) | q.rlike(RATIO),
        "compute": q.rlike(COMPARE) | q.rlike(RATIO) | has_rules,
    }
    named = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.when(has_documents, "extract").otherwise("filter")))


def weak_words(question: Column) -> Column:
    q = F.lower(question)
    return F.filter(F.array(*[F.when(q.rlike(rf"\b{w}\b"), F.lit(w)) for w in WEAK]), lambda x: x.isNotNull())


def task_type(has_tables: Column, has_documents: Column, has_records: Column, has_rules: Column, has_images: Column) -> Column:
    return (
        F.when(has_records & has_rules, "record_text_with_semantic_rule")
        .when(has_tables & has_rules, "table_with_semantic_rule")
        .when(has_tables & (has_records | has_documents), "mixed_context")
        .when(has_documents & ~has_images, "document_qa")
        .when(has_tables & ~has_images, "table_computation")
        .when(has_images & ~(has_tables | has_documents), "image_understanding")
        .when(has_images, "mixed_context")
        .otherwise("pure_reasoning")
    )


def primary_tool(kind: Column, has_database: Column) -> Column:
    sql = F.when(has_database, "sql").otherwise("pandas")
    return (
        F.when(kind == "record_text_with_semantic_rule", "document_extractor")
        .when(kind.isin("table_with_semantic_rule", "mixed_context"), "pandas")
        .when(kind == "table_computation", sql)
        .when(kind == "document_qa", "rag")
        .when(kind == "image_understanding", "vision")
        .otherwise("react")
    )


def auxiliary_tools(kind: Column, has_database: Column) -> Column:
    """The tools that a type of task may need besides its primary one, in order."""
    named = lambda *tools: F.array(*map(F.lit, tools))
    return (
        F.when(kind == "record_text_with_semantic_rule", named("pandas", "document_parser", "rag"))
        .when(kind == "table_with_semantic_rule", F.when(has_database, named("sql", "document_parser", "rag")).otherwise(named("document_parser", "rag")))
        .when(kind == "table_computation", F.when(has_database, named("pandas")).otherwise(named("sql")))
        .when(kind == "document_qa", named("document_parser"))
        .when(kind == "mixed_context", F.when(has_database, named("sql", "rag")).otherwise(named("document_parser", "rag")))
        .otherwise(F.array().cast("array<string>"))
    )


def modalities(has_tables: Column, has_texts: Column, has_images: Column, has_others: Column) -> Column:
    named = {"table": has_tables, "document": has_texts, "image": has_images, "unknown": has_others}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]), lambda x: x.isNotNull())


def word_hits(question: Column, words: Iterable[str]) -> Column:
    q = F.lower(question)
    return sum((F.contains(q, F.lit(w)).cast("int") for w in words), F.lit(0))


def difficulty_points(question: Column, files: Column, kinds: Column, docs: Column, dbs: Column, size: Column) -> Column:
    """0 to 11 points, for what there is to read and what is asked."""
    aggregations, hops = word_hits(question, AGGREGATION_WORDS), word_hits(question, HOP_WORDS)
    words = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    signs = (files >= 4, kinds >= 2, kinds >= 3, docs >= 1, dbs >= 1, size >= 200_000, size >= 1_500_000, words >= 22, aggregations >= 2, hops >= 1, hops >= 2)
    return sum((s.cast("int") for s in signs), F.lit(0))


def difficulty_bucket(points: Column) -> Column:
    return F.when(points <= 1, "Easy").when(points <= 3, "Medium").when(points <= 6, "Hard").otherwise("Extreme")


def _by(key: Column, table: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def budget(kind: Column, difficulty: Column, flags: Column) -> tuple[Column, Column, Column]:
    """level, model calls and tool calls."""
    has = lambda f: F.array_contains(flags, f)
    more = _by(F.lower(difficulty), DIFFICULTY_CALLS, 1)
    model, tools = _by(kind, {k: v[0] for k, v in BUDGETS.items()}, 10) + more, _by(kind, {k: v[1] for k, v in BUDGETS.items()}, 18) + 2 * more
    for flag, (a, b) in FLAG_CALLS.items():
        model, tools = model + F.when(has(flag), a).otherwise(0), tools + F.when(has(flag), b).otherwise(0)
    unsure = has("low_confidence") | has("ambiguous_schema")
    model, tools = F.least(model + F.when(unsure, 1).otherwise(0), F.lit(MOST_CALLS[0])), F.least(tools + F.when(unsure, 2).otherwise(0), F.lit(MOST_CALLS[1]))
    level = F.lit("xlarge")
    for most, name in reversed(LEVELS):
        level = F.when(model <= most, name).otherwise(level)
    return level, model, tools


def topological_layers(needs: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """Subtasks in layers, each after those it needs and sorted by name. What isn't a subtask can't be waited for here."""
    left = {k: {d for d in v if d in needs} for k, v in needs.items()}
    layers = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"these wait for each other: {sorted(left)}")
        layers.append(ready)
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return layers


def blocked(needs: Mapping[str, Iterable[str]], succeeded: Iterable[str]) -> list[str]:
    """Subtasks that need one that didn't succeed, or that isn't there at all."""
    ok = set(succeeded)
    return sorted(k for k, v in needs.items() if set(v) - ok)


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """Counts calls against their limits, and time against a deadline."""

    limits: Mapping[str, int]
    seconds: float | None = None
    used: dict[str, int] = field(default_factory=dict)
    began: float = field(default_factory=time.monotonic)

    def spend(self, what: str, n: int = 1) -> None:
        if self.seconds is not None and time.monotonic() - self.began > self.seconds:
            raise BudgetExceeded("time")
        if self.used.get(what, 0) + n > self.limits.get(what, 0):
            raise BudgetExceeded(what)
        self.used[what] = self.used.get(what, 0) + n

    def left(self, what: str) -> int:
        return self.limits.get(what, 0) - self.used.get(what, 0)
