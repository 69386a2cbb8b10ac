"""Records out of texts, by an extractor that the file's path and the question choose, merged per record by a table function.

A text's paragraphs become blocks; fields of a block are found by built-in functions. A Python table function, given the blocks
of one record of one file in their order, merges them and returns the record, so nothing larger than a record is in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablesense.functions.text import evidence, last_match
from tablesense.operators import extraction as X
from tablesense.operators.documents import paragraphs
from tablesense.sources.sinks import synthesised_name, write_answer


@dataclass(frozen=True)
class Extractor:
    """What a kind of record text is recognised by, and its fields: columns made of a block's text, in the order of the table. ``key`` names the
    record. ``sticky`` fields keep their last value that isn't null; others, and evidence with them, are those of the last block."""

    name: str
    path: str
    question: str
    key: Column
    fields: Mapping[str, Column]
    sticky: bool = False

    def schema(self) -> list[str]:
        return list(self.fields)


def _text(c: Column) -> Column:
    return c.cast("string")


def extractors(threshold: float | None = None) -> list[Extractor]:
    """The known extractors, the first that fits being taken, and one for all other record texts at the end. Path and question patterns are
    fixed values."""
    block = F.col("block")
    number = F.regexp_extract(block, r"\b(?:ID|id)\s+(\d{2,})\b", 1)
    patient = _text(X.field(block, "patient_id"))
    low = F.lower(block)
    status = F.when(low.rlike(r"\blegal\b|unrestricted standing|cleared for play"), "Legal").when(low.rlike(r"\bbanned\b"), "Banned").when(low.rlike(r"\brestricted\b"), "Restricted")
    births = {"patient_id": patient, "birth_year": _text(X.birth_year(block)), "birthday_text": X.field(block, "birthday")}
    value = X.lab_value(block)
    lab = {"patient_id": patient, "creatinine": _text(value), "creatinine_abnormal": _text(X.is_abnormal(value, block, threshold)), "rule_source": F.lit("rules" if threshold is not None else "markers"), "evidence": evidence(block)}
    legal = {"legality_id": F.when(number != "", number), "card_id": last_match(block, r"(?i)\bcards_id\s+(\d+)\b"), "format": F.when(low.rlike("commander|singleton multiplayer|multiplayer format"), "commander"), "status": status}
    any_id = F.coalesce(patient, F.nullif(F.regexp_extract(block, r"\b(\d{3,})\b", 1), F.lit("")))
    general = {"id": any_id} | {n: _text(X.field(block, n)) for n in X.FIELDS}
    return [
        Extractor("patient_births", "patient", r"\b(age|birthday|birth|born|70|years old)\b", patient, births),
        Extractor("creatinine", "laboratory", r"\b(creatinine|cre)\b", patient, lab),
        Extractor("legalities", "legalities", r"\b(commander|legal|status|content warning)\b", F.when(number != "", number), legal, sticky=True),
        Extractor("records", "", "", any_id, general, sticky=True),
    ]


def chosen(path: Column, question: str, known: Sequence[Extractor]) -> Column:
    """Name of the extractor for a path and a question."""
    p, q = F.lower(path), question.lower()
    fit = [(F.contains(p, F.lit(e.path)), e.name) for e in known if re.search(e.question, q)]
    out = F.lit(None).cast("string")
    for condition, name in reversed(fit):
        out = F.when(condition, name).otherwise(out)
    return out


class MergedRecord:
    """Given the blocks of one record in order, returns the record: the values of its fields, and where it was first seen."""

    def __init__(self):
        self.first: Row | None = None
        self.values: dict[str, str | None] = {}

    def eval(self, row: Row) -> None:
        if self.first is None:
            self.first = row
        own = dict(zip(row["names"], row["found"], strict=True))
        if row["sticky"]:
            own = {k: self.values.get(k) if v is None else v for k, v in own.items()}
        self.values = own

    def terminate(self) -> Iterator[tuple]:
        if self.first is not None:
            yield self.first["source"], self.first["extractor"], self.first["record_id"], self.first["pos"], list(self.values), list(self.values.values())


RECORD = "source string, extractor string, record_id string, first_pos int, names array<string>, found array<string>"


def extract_records(docs: DataFrame, question: str, source_col: str = "source", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """source, extractor, record_id, first_pos, names, found: the records of texts, each as an array of its fields' values beside one of their
    names. Paragraphs without a number and a word for ids are no records, nor is one whose id isn't found. Null texts have none."""
    known = extractors(threshold)
    blocks = docs.select(F.col(source_col).alias("source"), chosen(F.col(source_col), question, known).alias("extractor"), F.posexplode(paragraphs(F.col(text_col), loose=True)).alias("pos", "block"))
    names, found, key, sticky = (F.lit(None).cast(t) for t in ("array<string>", "array<string>", "string", "boolean"))
    for e in known:
        this = F.col("extractor") == e.name
        names = F.when(this, F.array(*map(F.lit, e.schema()))).otherwise(names)
        found = F.when(this, F.array(*e.fields.values())).otherwise(found)
        key, sticky = F.when(this, e.key).otherwise(key), F.when(this, F.lit(e.sticky)).otherwise(sticky)
    rows = blocks.where(X.is_record_block(F.col("block"))).select("source", "extractor", "pos", key.alias("record_id"), names.alias("names"), found.alias("found"), sticky.alias("sticky")).where("record_id is not null")
    merge = F.udtf(MergedRecord, returnType=RECORD)
    return merge(rows.asTable().partitionBy("source", "extractor", "record_id").orderBy("pos"))


def record_table(records: DataFrame, extractor: str, threshold: float | None = None) -> DataFrame:
    """The records of one extractor under its columns, with source and first_pos. Records of which no field but the id is known are left out."""
    (schema,) = [e.schema() for e in extractors(threshold) if e.name == extractor]
    own = records.where(F.col("extractor") == extractor)
    table = own.select("source", "first_pos", *[F.get("found", F.lit(i)).alias(n) for i, n in enumerate(schema)])
    return table.where(F.coalesce(*[F.col(n) for n in schema[1:] if n != "rule_source"]).isNotNull())


def synthesise(docs: DataFrame, question: str, folder: str, source_col: str = "source", text_col: str = "text", threshold: float | None = None) -> dict[str, str]:
    """Writes the records of each text as a table named for it, with its extractor's columns in order and records in order of appearance.
    Returns the tables' paths by source; a text without records has none. There is one driver step per text of a context."""
    records = extract_records(docs, question, source_col, text_col, threshold).persist()
    try:
        written = {}
        for r in records.select("source", "extractor").distinct().orderBy("source").collect():
            rows = record_table(records, r["extractor"], threshold).where(F.col("source") == r["source"])
            written[r["source"]] = f"{folder.rstrip('/')}/{synthesised_name(r['source'])}"
            write_answer(rows.orderBy("first_pos").drop("source", "first_pos"), written[r["source"]])
        return written
    finally:
        records.unpersist()

