"""Names of columns, and how like they are."""

from __future__ import annotations

from difflib import SequenceMatcher, get_close_matches

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(c: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def plain_name(name: str) -> str:
    return "".join(x for x in name.lower() if x.isascii() and x.isalnum())


def name_similarity(concept: Column, name: Column) -> Column:
    """1 for the same name or a whole word of it, 0.85 for a part, else 1 less the edit distance over the longer length."""
    a, b = F.lower(concept), F.regexp_replace(F.lower(name), r"[_.]", " ")
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    part = F.contains(b, a) | F.contains(a, b)
    return F.when((a == b) | F.array_contains(F.split(b, r"\s+"), a), 1.0).when(part & (F.length(a) > 0) & (F.length(b) > 0), 0.85).otherwise(1.0 - F.levenshtein(a, b) / longest)


def value_hit(concept: Column, samples: Column) -> Column:
    """Whether a sample that isn't a number equals the concept, or one contains the other."""
    a = F.lower(concept)

    def hits(v: Column) -> Column:
        low = F.lower(F.trim(v))
        return ~low.rlike(r"^[+-]?[0-9.]+$") & (low != "") & (F.contains(low, a) | F.contains(a, low))

    return F.coalesce(F.exists(samples, hits), F.lit(False))


def binding_score(concept: Column, name: Column, samples: Column, cardinality: Column) -> Column:
    base = F.greatest(name_similarity(concept, name), F.when(value_hit(concept, samples), 0.9).otherwise(0.0))
    few = cardinality.between(1, 12) & (base >= 0.4)
    return F.least(base + F.when(few, 0.05).otherwise(0.0), F.lit(1.0))


def close_names(name: str, names: list[str], n: int = 5, cutoff: float = 0.45) -> list[str]:
    """The names most like one, best first; for catalogs, not for rows."""
    return get_close_matches(name.lower(), [x.lower() for x in names], n=n, cutoff=cutoff)


def name_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, plain_name(a), plain_name(b)).ratio()
