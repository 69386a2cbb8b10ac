"""Queries of texts: tokens, sections, chunks, extraction, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesense.functions import text as T
from tablesense.operators import documents as D
from tablesense.operators import extraction as X
from tablesense.operators import record_extraction as E
from tablesense.operators import retrieval as R
from tablesense.operators import term_index as I
from tablesense.plans.q_core import table
from tablesense.sources import store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_QSTOP = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)


def _tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {_tokens_sql("text")} AS t FROM documents)""")
def doc_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.index_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_token"))


@query(f"""SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tokens_sql("text")}) AS token FROM documents) GROUP BY 1""")
def doc_term_stats(spark, d):
    return R.chunk_term_stats(table(spark, d, "documents"), "text")


@query(f"""
WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+'), lambda x: lower(x)), lambda w: length(w) > 2 AND w NOT IN ({_QSTOP})) AS l FROM benchmark),
 u AS (SELECT item_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS pos FROM w), f AS (SELECT item_id, word, min(pos) AS pos FROM u GROUP BY 1, 2),
 r AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS nth FROM f)
SELECT item_id, word, nth FROM r WHERE nth <= 16""")
def question_concepts(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(T.question_concepts(F.col("text"))).alias("p", "word"))
    return b.select("item_id", "word", (F.col("p") + 1).cast("bigint").alias("nth"))


@query("""SELECT doc_id, CAST(len(list_filter(['the', 'und', 'para', 'dans'], lambda t: contains(lower(text), t))) AS INTEGER) AS score FROM documents""")
def keyword_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id", T.keyword_score(F.col("text"), F.array(*map(F.lit, ("the", "und", "para", "dans")))).alias("score"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
 g AS (SELECT doc_id, CAST((pos - 1) // 2 AS INTEGER) AS para_no, string_agg(line, chr(10) ORDER BY pos) AS t FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS BIGINT) AS nth, length(t) AS n_chars FROM (SELECT doc_id, para_no, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM g) WHERE t <> ''""")
def doc_paragraphs(spark, d):
    spaced = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i > 0) & (i % 2 == 0), F.concat(F.lit("\n"), x)).otherwise(x)), "\n")
    p = table(spark, d, "documents").select("doc_id", F.posexplode(D.paragraphs(spaced)).alias("p", "para"))
    return p.select("doc_id", (F.col("p") + 1).cast("bigint").alias("nth"), F.char_length("para").cast("bigint").alias("n_chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
 h AS (SELECT doc_id, line_no, trim(line) AS line FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'copyright')),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM h)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM r WHERE n <= 8""")
def doc_lines_rules(spark, d):
    return D.rule_lines(table(spark, d, "documents"), "doc_id", "text", F.array(F.lit("license"), F.lit("copyright")))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"


@query(f"""
WITH m AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 1 AND trim(raw) <> '' THEN CAST((pos // 5) % 3 AS INTEGER) + 1 ELSE 0 END AS level, raw FROM {_LINES}),
 s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM m),
 b AS (SELECT doc_id, section_no, regexp_replace(string_agg(raw, chr(10) ORDER BY pos) FILTER (level = 0), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY 1, 2),
 h AS (SELECT doc_id, section_no, level FROM s WHERE level > 0),
 p AS (SELECT b.doc_id, b.section_no, count(DISTINCT a.level) AS depth FROM b JOIN h c ON b.doc_id = c.doc_id AND b.section_no = c.section_no
   JOIN h a ON a.doc_id = b.doc_id AND a.section_no <= b.section_no AND NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = a.doc_id AND x.section_no > a.section_no AND x.section_no <= b.section_no AND x.level <= a.level) GROUP BY 1, 2)
SELECT b.doc_id, CAST(b.section_no AS INTEGER) AS section_no, CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(length(body) AS BIGINT) AS n_chars FROM b LEFT JOIN p ON b.doc_id = p.doc_id AND b.section_no = p.section_no WHERE body <> ''""")
def md_sections(spark, d):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 5 == 1) & (F.trim(x) != ""), F.concat(F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int")), F.lit(" "), F.trim(x))).otherwise(x)), "\n")
    s = D.sections(table(spark, d, "documents").select("doc_id", marked.alias("md")), "doc_id", "md")
    return s.select("doc_id", "section_no", F.size("heading_path").cast("bigint").alias("depth"), F.char_length("raw_text").cast("bigint").alias("n_chars"))


@query(f"""
WITH m AS (SELECT doc_id, pos, pos % 5 = 1 AND trim(raw) <> '' AS head, raw FROM {_LINES}), s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM m),
 b AS (SELECT doc_id, n, max(CASE WHEN head THEN trim(raw) END) AS heading, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT head), ''), '^\\s+|\\s+$', '', 'g') AS body FROM s WHERE n > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(n AS INTEGER) AS section_no, substr(sha256(heading), 1, 16) AS heading, CAST(length(body) AS BIGINT) AS n_chars FROM b
UNION ALL SELECT doc_id, 1, substr(sha256('(top)'), 1, 16), length(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)""")
def flat_sections(spark, d):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 5 == 1) & (F.trim(x) != ""), F.concat(F.lit("## "), F.trim(x))).otherwise(x)), "\n")
    s = D.flat_sections(table(spark, d, "documents").select("doc_id", marked.alias("md")), "doc_id", "md")
    return s.select("doc_id", "section_no", T.content_hash(F.col("heading")).alias("heading"), F.char_length("body").cast("bigint").alias("n_chars"))


def _paragraphed(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query("")
def chunk_sliding(spark, d):
    c = D.chunk_windows(_paragraphed(spark, d), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.char_length("raw_text").alias("n_chars"), T.content_hash(F.col("raw_text")).alias("content_hash"))


@query("")
def chunk_records(spark, d):
    numbered = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Record "), F.col("doc_id") + 1000, F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")).alias("text"))
    return D.chunk_records(numbered, "doc_id", "text", 2000).select("doc_id", "chunk_no", F.char_length("raw_text").alias("n_chars"))


@query("""SELECT event_id, CAST(0 AS INTEGER) AS chunk_no, '$' AS pointer, 'top-level keys: ["k"]' AS raw_text FROM events UNION ALL
SELECT event_id, CAST(1 AS INTEGER), '$', '{' || chr(10) || '  "k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || chr(10) || '}' FROM events""")
def json_chunks(spark, d):
    c = D.chunk_json(table(spark, d, "events"), "event_id", "props")
    return c.select("event_id", "chunk_no", F.array_join("heading_path", " › ").alias("pointer"), "raw_text")


@query("""SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'https?://[^\\s"''<>]+')) AS BIGINT) AS urls, regexp_extract(url, '(https?://\\S+)', 1) AS page_url FROM pages""")
def extract_patterns(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"""https?://[^\s"'<>]+""")).cast("bigint").alias("urls"), X.field(F.col("url"), "url").alias("page_url"))


def _notes(spark, d) -> DataFrame:
    """Paragraphs about patients, made of orders: an id, a birth, a value and, for some, a correction."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") + 1000).alias("k"), "o_orderkey")
    value = F.format_string("%d.%d", F.col("k") % 9 + 1, F.col("k") % 7)
    note = F.concat(F.lit("Patient file number "), "k", F.lit(" was born on March 4, "), F.col("k") % 60 + 1930, F.lit(". Creatinine measured 2.5 mg/dL, then "), value, F.lit(" mg/dL. GOT was 35.0 U/L"), F.when(F.col("k") % 3 == 0, F.lit("; corrected to 28.5 U/L. Renal function is impaired.")).otherwise(". Findings within normal limits."))
    return o.select("o_orderkey", "k", note.alias("note"))


@query("""SELECT o_orderkey, o_orderkey + 1000 AS patient_id, 2.5 AS creatinine, CAST(((o_orderkey + 1000) % 9 + 1) || '.' || ((o_orderkey + 1000) % 7) AS DOUBLE) AS last_creatinine,
 CAST((o_orderkey + 1000) % 60 + 1930 AS INTEGER) AS born, (o_orderkey + 1000) % 3 = 0 AS impaired, CAST(((o_orderkey + 1000) % 9 + 1) || '.' || ((o_orderkey + 1000) % 7) AS DOUBLE) > 4.5 AS above FROM orders""".replace("2.5 AS creatinine", "CAST(2.5 AS DOUBLE) AS creatinine"))
def extract_last_number(spark, d):
    n = F.col("note")
    return _notes(spark, d).select("o_orderkey", X.field(n, "patient_id").alias("patient_id"), X.field(n, "creatinine").alias("creatinine"), X.lab_value(n).alias("last_creatinine"), X.birth_year(n).alias("born"), X.is_abnormal(X.lab_value(n), n).alias("impaired"), X.is_abnormal(X.lab_value(n), n, 4.5).alias("above"))


@query("""SELECT o_orderkey, 'GOT was 35.0 U/L' || CASE WHEN (o_orderkey + 1000) % 3 = 0 THEN '; corrected to 28.5 U/L' ELSE '' END AS said FROM orders""")
def sentence_filter(spark, d):
    return _notes(spark, d).select("o_orderkey", T.sentences_with(F.col("note"), r"\bGOT\b").alias("said"))


@query("""SELECT o_orderkey, CAST(CASE WHEN (o_orderkey + 1000) % 3 = 0 THEN 28.5 ELSE 35.0 END AS DOUBLE) AS got FROM orders""")
def corrected_override(spark, d):
    records = _notes(spark, d).withColumn("got", X.field(F.col("note"), "got")).withColumn("note", F.regexp_replace("note", "(?i)creatinine", "CRE"))
    return X.corrected(records, "note", ("got",)).select("o_orderkey", "got")


@query("""SELECT CAST(o_orderkey + 1000 AS VARCHAR) AS legality_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS card_id, 'commander' AS format, CASE WHEN o_orderkey % 3 = 0 THEN 'Banned' ELSE 'Legal' END AS status FROM orders""")
def legality_records(spark, d):
    o = table(spark, d, "orders")
    first = F.concat(F.lit("ID "), F.col("o_orderkey") + 1000, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" has cards_id 7, or rather cards_id "), "o_orderkey")).otherwise(""), F.lit(" in the Commander format."))
    second = F.concat(F.lit("ID "), F.col("o_orderkey") + 1000, F.when(F.col("o_orderkey") % 3 == 0, F.lit(" is banned.")).otherwise(F.lit(" is cleared for play, not banned.")))
    blocks = o.select("o_orderkey", F.posexplode(F.array(first, second)).alias("n", "block")).withColumn("pos", F.col("o_orderkey") * 2 + F.col("n"))
    return X.legalities(blocks, "block", "pos").drop("first_seen")


@query("""
WITH o AS (SELECT 'doc/Laboratory/' || o_custkey || '.md' AS source, o_orderkey, CAST(1000 + o_orderkey % 3 AS VARCHAR) AS patient_id,
  CAST((o_orderkey % 9 + 1) || '.' || (o_orderkey % 7) AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderkey % 5 <> 4)
SELECT source, patient_id, arg_max(v, o_orderkey) AS creatinine, arg_max(v, o_orderkey) > 4.5 AS abnormal, CAST(min(nth) AS INTEGER) AS nth FROM o GROUP BY 1, 2""")
def extracted_records(spark, d):
    o = table(spark, d, "orders")
    value = F.format_string("%d.%d", F.col("o_orderkey") % 9 + 1, F.col("o_orderkey") % 7)
    note = F.concat(F.lit("Patient file number "), 1000 + F.col("o_orderkey") % 3, F.lit(":\ncreatinine was 2.5 mg/dL, then "), value, F.lit(" mg/dL."))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 5 != 4, F.struct("o_orderkey", note.alias("n"))))), lambda x: x["n"]), "\n \n")
    docs = o.groupBy("o_custkey").agg(text.alias("text")).select(F.concat(F.lit("doc/Laboratory/"), "o_custkey", F.lit(".md")).alias("source"), "text")
    found = E.record_table(E.extract_records(docs, "Whose creatinine is high?", threshold=4.5), "creatinine", 4.5)
    return found.select("source", "patient_id", F.col("creatinine").cast("double").alias("creatinine"), F.col("creatinine_abnormal").cast("boolean").alias("abnormal"), (F.col("first_pos") + 1).alias("nth"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS is_record FROM orders""")
def record_text_detector(spark, d):
    para = "Patient file number 12345 was recorded on 1991-03-04 with GOT level 35 U/L and creatinine value 1.2 mg/dL. "
    text = F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit(para), 6)).otherwise(F.repeat(F.lit("A quiet walk by the river. "), 40))
    return table(spark, d, "orders").select("o_orderkey", X.looks_like_records(text).alias("is_record"))


@query("""SELECT content_hash, copies, first_doc FROM (SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1)""")
def text_hash_dedup(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 500) AS snippet FROM documents""")
def evidence_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.evidence(F.col("text")).alias("snippet"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS chunk_no FROM documents),
 s AS (SELECT *, CAST(contains(lower(line), 'license') AS INTEGER) + CAST(contains(lower(line), 'the ') AS INTEGER) AS sc FROM l),
 r AS (SELECT *, max(sc) OVER (PARTITION BY doc_id) > 0 AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, chunk_no) AS rn FROM s)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no FROM r WHERE rn <= 3 AND (NOT hit OR sc > 0)""")
def relevant_chunks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "raw_text"))
    return D.relevant_chunks(lines, F.array(F.lit("license"), F.lit("the ")), 3, "doc_id").select("doc_id", "chunk_no")


_BM25 = f"""
 t AS (SELECT doc_id, {_tokens_sql("text")} AS l FROM documents), n AS (SELECT count(*) AS n, greatest(avg(len(l)), 1.0) AS avg_len FROM t),
 p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS token FROM t) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
 q AS (SELECT DISTINCT item_id, unnest({_tokens_sql("text")}) AS token FROM benchmark),
 bm AS (SELECT item_id, p.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(len(l), 1) / avg_len))) AS score
  FROM q JOIN p ON q.token = p.token JOIN df ON df.token = p.token JOIN t ON t.doc_id = p.doc_id, n GROUP BY 1, 2),
 bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)"""


_indexes: dict[tuple[str, str], str] = {}


def _index(spark, d) -> I.TermIndex:
    """The index of a folder's documents, written by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        folder = store.work_folder(spark, "documents-index")
        I.write_index(table(spark, d, "documents"), "doc_id", "text", folder)
        _indexes[key] = folder
    return I.open_index(spark, _indexes[key])


def _by_id(index: I.TermIndex, found: DataFrame) -> DataFrame:
    return found.join(index.docs.select("place", "id"), "place").select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))


def _bm25(spark, d) -> DataFrame:
    index = _index(spark, d)
    return _by_id(index, I.bm25_best(index, _questions(spark, d), "item_id", "question", R.FIRST_STAGE))


@query(f"""WITH {_BM25} SELECT item_id, doc_id, round(round(score, 6), 3) AS score, rank FROM bmr WHERE rank <= 30""")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("item_id", "doc_id", F.round("score", 3).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_TFIDF = f"""
 t2 AS (SELECT doc_id, unnest({_tokens_sql("text")}) AS token FROM documents), p2 AS (SELECT doc_id, token, count(*) AS tf FROM t2 GROUP BY 1, 2),
 c2 AS (SELECT count(*) AS n FROM documents), i2 AS (SELECT token, ln((1 + n) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM p2, c2 GROUP BY token, n),
 q2 AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_tokens_sql("text")}) AS token FROM benchmark) GROUP BY 1, 2),
 w2 AS (SELECT doc_id, p2.token, tf / CAST(max(tf) OVER (PARTITION BY doc_id) AS DOUBLE) * idf AS w FROM p2 JOIN i2 ON p2.token = i2.token),
 v2 AS (SELECT item_id, q2.token, tf / CAST(max(tf) OVER (PARTITION BY item_id) AS DOUBLE) * coalesce(idf, ln(1 + n) + 1) AS w FROM q2 LEFT JOIN i2 ON q2.token = i2.token, c2),
 tf AS (SELECT item_id, doc_id, sum(v2.w * w2.w) / (any_value(qn.s) * any_value(dn.s)) AS score FROM v2 JOIN w2 ON v2.token = w2.token JOIN (SELECT item_id AS qi, sqrt(sum(w * w)) AS s FROM v2 GROUP BY 1) qn ON qi = item_id JOIN (SELECT doc_id AS di, sqrt(sum(w * w)) AS s FROM w2 GROUP BY 1) dn ON di = doc_id GROUP BY 1, 2),
 tfr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM tf)"""


def _tfidf(spark, d) -> DataFrame:
    index = _index(spark, d)
    return _by_id(index, R.top_k(I.tfidf_scores(index, _questions(spark, d), "item_id", "question"), "q", "place"))


@query(f"""WITH {_TFIDF} SELECT item_id, doc_id, CAST(floor(round(score, 6) * 1000) AS BIGINT) AS score_thousandths, rank FROM tfr WHERE rank <= 30""")
def tfidf_topk(spark, d):
    return _tfidf(spark, d).select("item_id", "doc_id", F.floor(F.col("score") * 1000).alias("score_thousandths"), F.col("rank").cast("bigint").alias("rank"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 6""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.nearest(e, q, "vec_id", "embedding", "query_id", "q").select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_RRF = f"""WITH {_BM25}, {_TFIDF}, u AS (SELECT item_id, doc_id, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT item_id, doc_id, rank FROM tfr WHERE rank <= 30),
 f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f)"""


def _fused(spark, d) -> DataFrame:
    f = R.fuse([_bm25(spark, d), _tfidf(spark, d)], "item_id", "doc_id").withColumn("score", F.round("score", 8))
    return R.top_k(f, "item_id", "doc_id", R.FINAL)


@query(f"""{_RRF} SELECT item_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM r WHERE rank <= 6""")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_CROSS = f"""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS place, {_tokens_sql("text")} AS l FROM documents), n AS (SELECT count(*) AS n, greatest(avg(len(l)), 1.0) AS avg_len FROM d),
 p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS token FROM d) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
 top AS (SELECT doc_id, max(tf) AS top FROM p GROUP BY 1), w AS (SELECT p.doc_id, p.token, tf, tf / CAST(top AS DOUBLE) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM p JOIN top USING (doc_id) JOIN df ON df.token = p.token, n),
 q0 AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_tokens_sql("text")}) AS token FROM benchmark) GROUP BY 1, 2),
 q AS (SELECT item_id, q0.token, tf / CAST(max(tf) OVER (PARTITION BY item_id) AS DOUBLE) * (ln((1 + n) / CAST(1 + coalesce(df, 0) AS DOUBLE)) + 1) AS w, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM q0 LEFT JOIN df ON df.token = q0.token, n),
 dn AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS s FROM q GROUP BY 1),
 hit AS (SELECT q.item_id, w.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * greatest(len(l), 1) / avg_len))) AS bm, sum(q.w * w.w) AS dot FROM q JOIN w ON w.token = q.token JOIN d ON d.doc_id = w.doc_id, n GROUP BY 1, 2),
 every AS (SELECT b.item_id, d.doc_id, place, d.text, coalesce(round(bm, 6), 0) AS bm, coalesce(round(dot / (qn.s * dn.s), 6), 0) AS tf FROM benchmark b CROSS JOIN (SELECT doc_id, place, text FROM d) d LEFT JOIN hit ON hit.item_id = b.item_id AND hit.doc_id = d.doc_id LEFT JOIN qn ON qn.item_id = b.item_id LEFT JOIN dn ON dn.doc_id = d.doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm DESC, place) AS r1, row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, place) AS r2 FROM every),
 f AS (SELECT item_id, text, round(sum(1.0 / (60 + r1) + 1.0 / (60 + r2)), 12) AS score, min(r1) AS first, max_by(doc_id, r2) AS doc_id FROM r GROUP BY 1, 2)
"""


@query(f"""{_CROSS} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM f) WHERE rank <= 30""")
def rrf_full_rankings(spark, d):
    index, asked = _index(spark, d), _questions(spark, d)
    found = I.fused(index, asked, "item_id", [I.bm25_scores(index, asked, "item_id", "question"), I.tfidf_scores(index, asked, "item_id", "question")], R.FIRST_STAGE)
    return found.select("item_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""{_RRF}, s AS (SELECT item_id, r.doc_id, rank, sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 6)
SELECT item_id, doc_id, rank, CAST(used AS BIGINT) AS used FROM s WHERE rank = 1 OR used <= 12000""")
def char_budget_cut(spark, d):
    sized = _fused(spark, d).join(table(spark, d, "documents").select("doc_id", F.char_length("text").alias("size")), "doc_id")
    cut = R.within_budget(sized, "item_id", "rank", F.col("size"), 12_000)
    return cut.select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "used")


@query(f"""WITH {_BM25}, s AS (SELECT item_id, bmr.doc_id, rank, sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM bmr JOIN documents d ON d.doc_id = bmr.doc_id WHERE rank <= 6)
SELECT item_id, doc_id, rank FROM s WHERE rank = 1 OR used <= 12000""")
def retrieval_pipeline(spark, d):
    found = R.retrieve(table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("text", "question"), "doc_id", "text", "item_id", "question")
    return found.select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS place FROM conversations""")
def conversation_order(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.row_number().over(w).cast("bigint").alias("place"))
