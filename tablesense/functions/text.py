"""Words, keywords and snippets of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesense.functions.cells import strip

#: Words that term indexes leave out.
STOPWORDS = (
    "the", "a", "an", "of", "is", "are", "was", "were", "and", "or", "in", "on", "for", "to", "by", "with", "what",
    "which", "who", "how", "list", "show", "give", "name", "names", "all", "this", "that", "these", "those", "from",
    "many", "much", "do", "does", "be", "as", "at", "it", "its",
)

#: Words of questions that name nothing.
QUESTION_STOPWORDS = (
    "the", "a", "an", "of", "is", "are", "was", "were", "and", "or", "in", "on", "for", "to", "by", "with", "what",
    "which", "who", "how", "list", "show", "give", "name", "names", "all", "this", "that", "these", "those", "from",
    "many", "much", "do", "does", "did", "be", "as", "at", "it", "its", "their", "his", "her", "they", "them", "we",
    "you", "i", "me", "my", "our", "us", "your", "yours", "any", "some", "each", "every", "such", "than", "then", "so",
    "if", "but", "not", "no", "yes", "yet", "more", "less", "most", "least", "between", "amongst", "among", "have", "has",
    "had", "been", "being", "where", "when", "while", "during", "after", "before", "into", "onto", "out", "over", "under",
    "above", "below", "about", "around", "across", "through", "per", "via", "due", "find", "calculate", "compute",
    "count", "tell", "specify", "given", "based", "using", "use", "please", "can", "could", "would", "should", "may",
    "might", "must", "will", "shall",
)


def index_tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Tokens for term indexes: runs of ASCII letters, digits and _, longer than one, lower-cased, without stopwords;
    then each CJK character of the text by itself."""
    text = F.lower(F.coalesce(c, F.lit("")))
    words = F.filter(F.regexp_extract_all(text, F.lit("([a-z0-9_]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    return F.concat(words, F.regexp_extract_all(text, F.lit("([\\x{4E00}-\\x{9FFF}])"), 1))


def question_concepts(c: Column, most: int = 16, stopwords: Sequence[str] = QUESTION_STOPWORDS) -> Column:
    """Words of a question that may name things: each once, in order, longer than two, without stopwords."""
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9_]+)"), 1), F.lower)
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))), 1, most)


def keyword_terms(c: Column, most: int = 80) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z][a-z0-9_-]{2,})"), 1)
    return F.slice(F.array_distinct(words), 1, most)


def keyword_score(text: Column, terms: Column) -> Column:
    """How many of the terms are in a text, in any case."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def evidence(c: Column, most: int = 500) -> Column:
    """A text on one line, at most ``most`` characters of it."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def content_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, digits)


def sentences(c: Column) -> Column:
    """Sentences that end in a full stop with no digit at either side, so that decimals stay whole."""
    return F.filter(F.transform(F.split(c, r"(?<!\d)\.(?!\d)"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def sentences_with(c: Column, pattern: str) -> Column:
    """The sentences that a pattern matches, in any case, joined by spaces."""
    return F.array_join(F.filter(sentences(c), lambda s: s.rlike(f"(?i){pattern}")), " ")


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group; null where there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1))


def fenced_code(c: Column) -> Column:
    """What is inside the first code fence; all of a text without one."""
    inner = F.regexp_extract(c, r"(?is)```(?:[a-z]*)\s*(.*?)```", 1)
    return strip(F.when(inner == "", c).otherwise(inner))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length; 0 where one is empty or nothing but zeros."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
