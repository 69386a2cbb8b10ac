"""The operators with production parameters, over whole tables: one query each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm import collocations, conversations, decontamination, language_id, licenses, packing, quality_classifier, quality_rules, sharding, simhash, substrings, tokens, warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"), label_col="quality", max_documents=6000)
    return quality_classifier.score_documents(docs, model, threshold=0.3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), distance=4, shingle=4, seed=42)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = tokens.write_tokens(docs, tokenizer_path(), end_id=2)
    read = tokens.read_tokens(spark, files, docs.schema["doc_id"].dataType.simpleString())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate_substrings(_table(spark, sf_dir, "documents"), length=200)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), weights=(1.0,) * 8, grown=(1.0,) * 9)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder, files = warc.write_warc(pages, least_bytes=0)
    read = warc.read_warc(spark, folder, files, pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs, max_documents=2400, max_windows=4))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    turns = conversations.ordered_turns(_table(spark, sf_dir, "conversations"))
    convs, rebuilt = conversations.branched(turns, base=conv - conv % 100, taken=conversations.crc_of_id(conv) % 6, most=5)
    return conversations.prefix_trie(convs, rebuilt)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, top=2000)


def _normalised_sql(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT_LINE}', '', 'g'), '{licenses.SIGNS}', '  ', 'g')"
    spelt = f"concat(' ', {plain}, ' ')"
    for old, new in licenses.spellings():
        spelt = f"replace({spelt}, '{old}', '{new}')"
    return f"trim(regexp_replace({spelt}, ' +', ' ', 'g'))"


def _licenses_sql() -> str:
    quoted = [(name.replace("'", "''"), text.replace("'", "''")) for name, text in [*licenses.KNOWN, *licenses.bsd_texts()]]
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(quoted))
    digests = ", ".join(f"('{d}', '{name}')" for name, known in licenses.DIGESTS.items() for d in known)
    untitled = f"regexp_replace(normal, '{licenses.title_pattern()}', '')"
    return f"""
WITH texts AS (SELECT k, license_id, {_normalised_sql("text")} AS normal FROM (VALUES {values}) v(k, license_id, text)), known AS (
  SELECT digest, min_by(license_id, k) AS license_id FROM (SELECT k, license_id, sha256({untitled}) AS digest FROM texts) GROUP BY digest
  UNION ALL SELECT digest, license_id FROM (VALUES {digests}) v(digest, license_id)
), d AS (SELECT doc_id, length(normal) AS n, sha256({untitled}) AS digest FROM (SELECT doc_id, {_normalised_sql("text")} AS normal FROM documents))
SELECT doc_id, CAST(n AS BIGINT) AS n_normal, d.digest, license_id FROM d LEFT JOIN known ON known.digest = d.digest
"""


#: CRC-32 by its table of 256 remainders, a byte at a time.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(tab[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295)"

_TRIE_SQL = f"""
WITH tab AS (
  SELECT list(t ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))
), t AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), h AS (SELECT conv, own, conv - conv % 100 AS base, {_CRC.format("CAST(conv AS VARCHAR)")} % 6 AS taken FROM (SELECT conv, count(*) AS own FROM t GROUP BY conv), tab
), k AS (SELECT h.*, least(taken, coalesce(b.own, 0)) AS lead FROM h LEFT JOIN (SELECT conv, own FROM h) b ON b.conv = h.base), turns AS (
  SELECT k.conv, t.i AS depth, role, text FROM k JOIN t ON t.conv = base AND t.i <= lead
  UNION ALL SELECT k.conv, t.i - taken + lead, role, text FROM k JOIN t ON t.conv = k.conv AND t.i > taken
), x AS (
  SELECT conv, depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv, 0, 0, '' FROM k
), size AS (SELECT conv, max(depth) AS size FROM x GROUP BY conv), nodes AS (
  SELECT node, min(x.conv) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
    string_agg(CAST(x.conv AS VARCHAR), ',' ORDER BY x.conv) FILTER (depth = size) AS ends FROM x JOIN size USING (conv) GROUP BY node
), up AS (
  SELECT nodes.node, p.node AS parent, q.conv_id AS parent_conv_id FROM nodes LEFT JOIN x p ON p.conv = nodes.conv_id AND p.depth = nodes.depth - 1 LEFT JOIN nodes q ON q.node = p.node
), kids AS (SELECT parent AS node, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent), sums AS (
  SELECT a.node, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves
  FROM nodes n JOIN x a ON a.conv = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY a.node
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN up USING (node) JOIN sums USING (node) LEFT JOIN kids USING (node)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_substrings": op7_substrings,
    "op8_licenses": op8_licenses,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_language_id": op11_language_id,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op12_conversation_trie": _TRIE_SQL,
    "op8_licenses": _licenses_sql(),
    "op6_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), pos AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), hit AS (
  SELECT DISTINCT doc_id, item, pos.n, i FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
