"""Documents as chunks: sections under their headings, paragraphs, windows, records and JSON subtrees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tablesense.functions.cells import strip
from tablesense.functions.text import STOPWORDS, keyword_score

#: Headings of up to this level; deeper ones are body text.
LEVELS = 4
WINDOW_CHARS, OVERLAP_CHARS, RECORD_CHARS = 1200, 150, 6000
TRUNCATED = "\n… (truncated)"


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, section_no, heading_path, raw_text: the body under each heading with all headings it stands under.

    The path needs no stack: the last heading of a level is open unless one of a smaller level came later. Text before
    the first heading has an empty path; empty bodies are left out."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,4})\s+\S", 1))).withColumn("title", F.regexp_extract("line", r"^#{1,4}\s+(.+?)\s*$", 1))
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, LEVELS + 1):
        lines = lines.withColumn(f"last{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(so_far))
    path, bound = [], F.lit(-1)
    for k in range(1, LEVELS + 1):
        at = F.coalesce(F.col(f"last{k}.pos"), F.lit(-1))
        path.append(F.when(at > bound, F.col(f"last{k}.title")))
        bound = F.greatest(bound, at)
    marked = lines.withColumn("path", F.filter(F.array(*path), lambda t: t.isNotNull())).withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    found = marked.groupBy(id_col, F.col("section").cast("int").alias("section_no")).agg(F.first("path").alias("heading_path"), strip(body).alias("raw_text"))
    return found.where("raw_text <> ''")


def flat_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, section_no (from 1), heading, body: what stands under each heading by itself, whatever headings it stands under; empty bodies
    too. Text before the first heading is left out; a text without any is one section, '(top)', as it is. Null texts have none."""
    headed = F.coalesce(F.col(text_col).rlike(r"(?m)^#{1,4}\s+\S"), F.lit(False))
    known = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__text"), headed.alias("__headed"))
    lines = known.where("__headed").select(id_col, F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
    title = F.regexp_extract("line", r"^#{1,4}\s+(.+?)\s*$", 1)
    is_heading = F.col("line").rlike(r"^#{1,4}\s+\S")
    numbered = lines.withColumn("section_no", F.count_if(is_heading).over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("section_no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_heading, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    found = numbered.groupBy(id_col, F.col("section_no").cast("int").alias("section_no")).agg(F.max(F.when(is_heading, title)).alias("heading"), strip(body).alias("body"))
    return found.unionByName(known.where("not __headed").select(id_col, F.lit(1).alias("section_no"), F.lit("(top)").alias("heading"), F.col("__text").alias("body")))


def focused_sections(sections: DataFrame, id_col: str, question: Column, most: int) -> DataFrame:
    """Of each document the ``most`` sections with most words of the question (of three letters or more, each once), in order of the text, with
    score; sections without any are left out, unless no section has one: then the first ``most``."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9_]+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))
    scored = sections.withColumn("score", keyword_score(F.concat_ws("\n", "heading", "body"), words))
    own = Window.partitionBy(id_col)
    rank = F.row_number().over(own.orderBy(F.desc("score"), "section_no"))
    kept = scored.withColumn("__any", F.max("score").over(own) > 0).withColumn("__rank", rank)
    return kept.where((F.col("__rank") <= most) & (~F.col("__any") | (F.col("score") > 0))).drop("__any", "__rank")


def indexable(path: Column, raw: Column) -> Column:
    """What is indexed of a chunk: its headings, then its text."""
    return F.when(F.size(path) > 0, F.concat(F.lit("["), F.array_join(path, " › "), F.lit("]\n"), raw)).otherwise(raw)


def paragraphs(c: Column, loose: bool = False) -> Column:
    """Paragraphs between empty lines (``loose``: lines of blanks too), stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n" if loose else r"\n{2,}"), strip), lambda p: p != "")


def window_chunks(text: str, most: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[str]:
    """Chunks of whole paragraphs, each begun with the end of the one before. A paragraph longer than a chunk is cut by
    itself and leaves nothing to begin the next one with. A text that fits is one chunk; empty chunks are left out."""
    parts = [p.strip() for p in re.split(r"\n{2,}", text)] if len(text) > most else []
    parts = [p for p in parts if p]
    held, chunks = "", []
    for part in parts:
        joined = f"{held}\n\n{part}".strip()
        if len(part) > most:
            chunks.append(held)
            step = most - overlap if most > overlap else len(part)
            last = max(0, -(-(len(part) - most) // step)) if most > overlap else 0
            chunks += [part[k * step : k * step + most] for k in range(last + 1)]
            held = ""
        elif len(joined) <= most:
            held = joined
        else:
            chunks.append(held)
            held = f"{held[len(held) - min(overlap, len(held)):]}\n\n{part}".strip()
    chunks.append(held if parts else text)
    yield from (c for c in map(str.strip, chunks) if c)


def record_chunks(text: str, most: int = RECORD_CHARS) -> Iterator[str]:
    """Whole paragraphs up to ``most`` characters together, and only those chunks that name a record's number."""
    held: list[str] = []
    size = 0
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    for part in [*parts, None]:
        if part is not None and (not held or size + 2 + len(part) <= most):
            size += len(part) + (2 if held else 0)
            held.append(part)
            continue
        chunk = "\n\n".join(held)
        if held and re.search(r"\b\d{3,}\b", chunk):
            yield chunk
        held, size = ([part], len(part)) if part is not None else ([], 0)


def json_chunks(text: str, most: int = WINDOW_CHARS, depth: int = 4) -> Iterator[tuple[list[str], str]]:
    """(path, text) of a JSON document: what the root holds, then each subtree that fits or is ``depth`` deep. An index is
    written on the name before it. A text that isn't JSON has no chunks."""
    try:
        root = json.loads(text)
    except ValueError:
        return
    if isinstance(root, dict):
        said = f"top-level keys: {json.dumps(list(root), ensure_ascii=False)}"
        if isinstance(root.get("records"), list):
            said += f"\nrecords count: {len(root['records'])}"
    else:
        said = f"top-level list with {len(root)} items" if isinstance(root, list) else f"scalar json payload: {type(root).__name__}"
    yield ["$"], said
    left = [(root, ["$"], 0)]
    while left:
        value, path, level = left.pop()
        shown = json.dumps(value, indent=2, ensure_ascii=False)
        if len(shown) <= most or level >= depth or not isinstance(value, dict | list):
            yield path, shown if len(shown) <= most else shown[:most] + TRUNCATED
        elif isinstance(value, dict):
            left += [(v, [*path, str(k)], level + 1) for k, v in reversed(value.items())]
        else:
            left += [(v, [*path[:-1], f"{path[-1]}[{i}]"], level + 1) for i, v in reversed(list(enumerate(value)))]


def _chunked(docs: DataFrame, id_col: str, text_col: str, make, pair: bool) -> DataFrame:
    """A row per chunk; texts are cut where they are, batch by batch."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("chunk_no", IntegerType()), StructField("heading_path", ArrayType(StringType())), StructField("raw_text", StringType())])

    def cut(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for key, text in zip(b[id_col], b[text_col]):
                for n, chunk in enumerate(make(text or "")):
                    rows.append((key, n, chunk[0] if pair else [], chunk[1] if pair else chunk))
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(id_col, text_col).mapInPandas(cut, schema)


def chunk_windows(docs: DataFrame, id_col: str, text_col: str, most: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    return _chunked(docs, id_col, text_col, lambda t: window_chunks(t, most, overlap), False)


def chunk_records(docs: DataFrame, id_col: str, text_col: str, most: int = RECORD_CHARS) -> DataFrame:
    return _chunked(docs, id_col, text_col, lambda t: record_chunks(t, most), False)


def chunk_json(docs: DataFrame, id_col: str, text_col: str, most: int = WINDOW_CHARS, depth: int = 4) -> DataFrame:
    return _chunked(docs, id_col, text_col, lambda t: json_chunks(t, most, depth), True)


def relevant_chunks(chunks: DataFrame, terms: Column, most: int, id_col: str, pos: str = "chunk_no", text_col: str = "raw_text") -> DataFrame:
    """Of each document the ``most`` chunks with most terms, in document order; where no chunk has one, the first ones."""
    scored = chunks.withColumn("__s", keyword_score(F.col(text_col), terms))
    any_hit = F.max("__s").over(Window.partitionBy(id_col)) > 0
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("__s"), pos))
    kept = scored.withColumn("__any", any_hit).withColumn("__r", rank).where((F.col("__r") <= most) & (~F.col("__any") | (F.col("__s") > 0)))
    return kept.drop("__s", "__any", "__r")


def rule_lines(docs: DataFrame, id_col: str, text_col: str, terms: Column, most: int = 8) -> DataFrame:
    """id_col, line_no, line: the first lines of each text that hold one of the terms."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    hits = lines.where((F.col("line") != "") & (keyword_score(F.col("line"), terms) > 0))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("line_no"))
    return hits.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")
