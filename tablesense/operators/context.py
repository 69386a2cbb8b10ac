"""What a question's context shows: ordered and budgeted blocks, previews, target schemas, and replies read as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.operators.relational import ranked

#: The order in which kinds of files are shown.
KIND_ORDER = ("csv", "db", "json", "record_text", "doc", "image")
#: Which kind a suffix is shown as.
SUFFIX_KINDS = {"csv": "csv", "tsv": "csv", "db": "db", "sqlite": "db", "sqlite3": "db", "json": "json", "jsonl": "json", "md": "doc", "txt": "doc", "docx": "doc", "png": "image", "jpg": "image", "jpeg": "image", "record_text": "record_text"}
#: Fields of records by what their file is about.
SCHEMA_HINTS = {
    "patient": ("patient_id", "sex", "birthday", "first_record_date", "got", "gpt", "ldh", "alp", "t_bil", "creatinine", "uric_acid", "diagnosis", "admission"),
    "race": ("race_id", "year", "round", "name", "date", "constructor_id", "constructor_ref", "url"),
    "default": ("id", "name", "date", "value"),
}


def shown_kind(suffix: Column) -> Column:
    out = F.lit("other")
    for k, v in SUFFIX_KINDS.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def in_kind_order(files: DataFrame, kind: str = "kind", name: str = "name") -> DataFrame:
    """With place: tables before databases, JSON, records, documents, images and the rest; by name within a kind."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col(kind)), F.lit(0)), F.lit(len(KIND_ORDER) + 1))
    placed = ranked(files.withColumn("__order", F.struct(rank.alias("kind"), F.col(name).alias("name"))), "__order")
    return placed.withColumn("place", F.col("pos") + 1).drop("__order", "pos")


def table_relevance(name: Column, columns: Column, question: Column) -> Column:
    """How many words of a table's and its columns' names a question has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
    asked = F.filter(words(question), lambda w: F.length(w) > 2)
    return F.size(F.array_intersect(words(F.array_join(F.concat(F.array(name), columns), " ")), asked))


def packed_blocks(blocks: DataFrame, key: str, pos: str, size: str, stub: str, budget: int) -> DataFrame:
    """pos, shown ('block', 'stub' or 'none') of each key's blocks, in order: what doesn't fit gives way to a stub if that
    fits, and later blocks may fit again. A fold over each key's sizes; contexts have few blocks."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(size).cast("long").alias("size"), F.col(stub).cast("long").alias("stub"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:bigint,shown:string>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        whole, short = acc["used"] + b["size"] <= budget, acc["used"] + b["stub"] <= budget
        shown = F.when(whole, "block").when(short, "stub").otherwise("none")
        taken = F.when(whole, b["size"]).when(short, b["stub"]).otherwise(0)
        return F.struct((acc["used"] + taken).cast("long").alias("used"), F.concat(acc["out"], F.array(F.struct(b["pos"].cast("long").alias("pos"), shown.alias("shown")))).alias("out"))

    folded = blocks.groupBy(key).agg(ordered.alias("__b")).select(key, F.aggregate("__b", start, step)["out"].alias("out"))
    return folded.select(key, F.explode("out").alias("o")).select(key, F.col("o.pos").alias(pos), "o.shown")


def preview_rows(records: DataFrame, pos: str, positive: Column | None = None, most: int | None = None) -> DataFrame:
    """The first five records, or with ``positive`` the first eight of those it takes."""
    kept = records.where(positive) if positive is not None else records
    return kept.orderBy(pos).limit(most if most is not None else 8 if positive is not None else 5)


def target_schema(path: Column, question: Column, fields: Column) -> Column:
    """Which fields records of a text file should have, by its path, the question, and the fields already seen."""
    p, q = F.lower(path), F.lower(question)
    lit = lambda names: F.array(*map(F.lit, names))
    return (
        F.when(F.contains(p, F.lit("patient")) & q.rlike(r"\b(age|birthday|birth|born|70|years old)\b"), lit(("patient_id", "birth_year", "birthday_text")))
        .when(F.contains(p, F.lit("laboratory")) & q.rlike(r"\b(creatinine|cre)\b"), lit(("patient_id", "creatinine", "creatinine_abnormal", "evidence")))
        .when(F.contains(p, F.lit("race")) & q.rlike(r"\b(race|grand prix|constructor|champion)\b"), lit(("race_id", "year", "name", "date")))
        .when(F.contains(p, F.lit("patient")) & ~F.array_contains(fields, "patient_id"), lit(SCHEMA_HINTS["patient"]))
        .when(F.contains(p, F.lit("race")) & ~F.array_contains(fields, "race_id"), lit(SCHEMA_HINTS["race"]))
        .when(F.size(fields) > 0, fields)
        .otherwise(lit(SCHEMA_HINTS["default"]))
    )


def signature_preview(cells: Column) -> Column:
    """A column's tokens: all of up to eight, else the first four, how many are left out, and the last two."""
    short = F.concat(F.slice(cells, 1, 4), F.array(F.concat(F.lit("..."), (F.size(cells) - 6).cast("string"), F.lit(" more..."))), F.slice(cells, -2, 2))
    return F.when(F.size(cells) <= 8, cells).otherwise(short)


def override_union(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of ``over`` in place of base rows with their key."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"))


def counter_summary(df: DataFrame, column: str, most: int = 15) -> DataFrame:
    """The most common values and their counts."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def rate_per_minute(done: int, seconds: float) -> float:
    return done / seconds * 60 if done and seconds > 0 else 0.0


def first_success(samples: DataFrame, order: str, ok: str, by: Sequence[str] = ()) -> DataFrame:
    """The first sample that succeeded, of all or of each group of equal ``by``."""
    return samples.where(F.col(ok)).groupBy(*by).agg(F.min_by(F.struct(*samples.columns), order).alias("s")).where("s is not null").select("s.*")


def repaired_json(text: str | None) -> str | None:
    """The JSON in a reply, as compact text: out of a fence, or from the first bracket on, with bare line ends in strings
    escaped and what is left open closed. None where that is no JSON."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    body = (fenced[1] if fenced else text).strip()
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not starts:
        starts = [0]
    out, open_, inside, escaped = [], [], False, False
    for ch in body[min(starts) :]:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
            elif ch < " ":
                ch = json.dumps(ch)[1:-1]
        elif ch == '"':
            inside = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not open_ or open_.pop() != ch:
                return None
            if not open_:
                out.append(ch)
                break
        out.append(ch)
    whole = "".join(out) + ('"' if inside else "") + "".join(reversed(open_))
    try:
        return json.dumps(json.loads(whole), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


def json_of_reply(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired_json, na_action=None).astype(object)

    return run(text)


def route(kind: str, routes: Mapping[str, Mapping], by_type: Mapping[str, str] | None = None, default: str | None = None, visited: Sequence[str] = (), light: bool = False) -> tuple[str, str]:
    """Which route a task takes, and why: the easy one for light tables, else its type's own, else the first of a suitable kind."""
    free = [n for n in routes if n not in visited]
    if light and "easy" in free:
        return "easy", "light_table_easy"
    own = (by_type or {}).get(kind)
    if own in free:
        return own, "task_type_routing"
    # fixed values: the kinds of routes that a type of task may take, in order
    tables = ("operator_executor", "tablellm_direct", "react", "multi_agent")
    kinds = {"table_computation": tables, "document_qa": tables, "mixed_context": tables, "image_understanding": ("multi_agent", "react")}.get(kind, ("react", "operator_executor", "multi_agent"))
    rag = kind in ("document_qa", "mixed_context")
    for wanted in kinds:
        for n in free:
            if routes[n].get("kind") == wanted and (routes[n].get("rag") or not rag):
                return n, "task_type_auto"
    if default in free:
        return default, "default_route"
    if free:
        return free[0], "first_available"
    raise ValueError("every route was tried")


def rendered(blocks: DataFrame, key: str, pos: str, text: str, title: str, budget: int) -> DataFrame:
    """key, text: each key's blocks in order within the budget; what doesn't fit is named in a line."""
    stub = F.concat(F.lit("## "), F.col(title), F.lit("\n_(omitted to stay within budget)_\n"))
    sized = blocks.withColumn("__size", F.char_length(text)).withColumn("__stub", stub).withColumn("__short", F.char_length("__stub"))
    marks = packed_blocks(sized, key, pos, "__size", "__short", budget)
    chosen = sized.join(marks, [key, pos]).where("shown <> 'none'").withColumn("__t", F.when(F.col("shown") == "block", F.col(text)).otherwise(F.col("__stub")))
    return chosen.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "__t"))), lambda x: x["__t"]), "").alias("text"))


class Memo:
    """Results of pure tools by their name and arguments."""

    def __init__(self) -> None:
        self.kept: dict[str, object] = {}
        self.hits = 0

    def call(self, name: str, tool: Callable, **arguments: object) -> object:
        key = f"{name} {json.dumps(arguments, sort_keys=True, default=str)}"
        if key in self.kept:
            self.hits += 1
        else:
            self.kept[key] = tool(**arguments)
        return self.kept[key]
