"""Extractors by path and question, records merged by the table function, and their tables written."""

from pyspark.sql import functions as F

from tablesense.operators import record_extraction as E
from tablesense.sources import files as S

LABORATORY = """Patient file number 12345 was seen.
Creatinine was 1.1 mg/dL, within normal limits.

No number here.

Patient file number 777: creatinine 2.0 mg/dL.
   \t
Patient file number 12345 again: CRE 9.5 mg/dL, elevated."""
LEGALITIES = """ID 123 has cards_id 7, or rather cards_id 9.

ID 123 in the Commander format.

ID 123 is banned.

ID 55."""
BIRTHS = "Patient 4001 was born on March 4, 1950. Nothing else.\n\nPatient 4002, id 4002, came in 1999."


def docs(spark):
    rows = [("doc/Laboratory.md", LABORATORY), ("legalities.md", LEGALITIES), ("doc/Patient.md", BIRTHS), ("empty.md", ""), ("none.md", None)]
    return spark.createDataFrame(rows, "source string, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_the_question_and_the_path_choose(spark):
    known = E.extractors()
    paths = spark.createDataFrame([("doc/Laboratory.md",), ("legalities.md",), ("Patient.md",), ("x.md",)], "p string")
    pick = lambda q: [r[0] for r in paths.select(E.chosen(F.col("p"), q, known)).collect()]
    assert pick("Who has a high creatinine?") == ["creatinine", "records", "records", "records"]
    assert pick("Which card is legal, and who was born before?") == ["records", "legalities", "patient_births", "records"]


def test_laboratory_records(spark):
    found = E.record_table(E.extract_records(docs(spark), "creatinine?"), "creatinine")
    assert rows(found, "patient_id", "creatinine", "creatinine_abnormal", "first_pos") == [("12345", "9.5", "true", 0), ("777", "2.0", "false", 2)]
    judged = E.record_table(E.extract_records(docs(spark), "creatinine?", threshold=1.5), "creatinine", 1.5)
    assert rows(judged, "patient_id", "creatinine_abnormal", "rule_source") == [("12345", "true", "rules"), ("777", "true", "rules")]


def test_fields_of_several_paragraphs(spark):
    found = E.record_table(E.extract_records(docs(spark), "Is it legal?"), "legalities")
    assert rows(found, "legality_id", "card_id", "format", "status") == [("123", "9", "commander", "Banned")]
    born = E.record_table(E.extract_records(docs(spark), "Who was born in 1950?"), "patient_births")
    assert rows(born, "patient_id", "birth_year", "birthday_text") == [("4001", "1950", "March 4, 1950")]


def test_other_texts_have_general_records(spark):
    notes = spark.createDataFrame([("notes.md", "Record number 900, male, GOT 35 U/L.\n\nRecord number 900, GPT 20 U/L, see https://a.b/c")], "source string, text string")
    found = E.record_table(E.extract_records(notes, "What?"), "records")
    assert rows(found, "id", "sex", "got", "gpt", "url") == [("900", "male", "35.0", "20.0", "https://a.b/c")]


def test_tables_are_written(spark, tmp_path):
    written = E.synthesise(docs(spark), "Is the creatinine or the status of legal cards high?", f"file://{tmp_path}")
    assert set(written) == {"doc/Laboratory.md", "legalities.md", "doc/Patient.md"} and written["doc/Laboratory.md"].endswith("/doc__Laboratory.synth.csv")
    table = S.read_delimited(spark, written["doc/Laboratory.md"])
    assert table.columns == ["patient_id", "creatinine", "creatinine_abnormal", "rule_source", "evidence"]
    assert [r["patient_id"] for r in table.collect()] == ["12345", "777"] and "elevated" in table.first()["evidence"]


def test_no_texts(spark):
    assert E.extract_records(docs(spark).limit(0), "creatinine").count() == 0 == E.extract_records(docs(spark).where("source in ('empty.md', 'none.md')"), "creatinine").count()
