"""Cells of untyped tables: their type, their token for comparison, and their form as a join key."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "__EMPTY__"
#: Words that count as booleans, and words that count as no value.
BOOL_WORDS = ("true", "false", "t", "f", "yes", "no")
EMPTY_WORDS = ("", "null", "none", "nan", "n/a", "na")

_DIGITS = r"\d+(?:_\d+)*"
INT_PATTERN = rf"^[+-]?{_DIGITS}$"
FLOAT_PATTERN = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
DATE_PATTERN = r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/(?:\d{2}|\d{4})$)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes off spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def cell_dtype(c: Column) -> Column:
    """empty, bool, int, float, date or str, decided by patterns: a cast would take '1d' and refuse '1_000'."""
    t = strip(F.coalesce(c.cast("string"), F.lit("")))
    return (
        F.when(t == "", "empty")
        .when(F.lower(t).isin(*BOOL_WORDS), "bool")
        .when(t.rlike(INT_PATTERN), "int")
        .when(t.rlike(FLOAT_PATTERN), "float")
        .when(t.rlike(DATE_PATTERN), "date")
        .otherwise("str")
    )


_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers; null for days that no month has. It is asked before a date is made: a parser would raise an error for each wrong row."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(month.between(1, 12) & day.between(1, last), F.make_date(year, month, day))


def date_value(c: Column) -> Column:
    """The date that a text says: 2020-01-31 (and a time), 1/31/2020, 1/31/20, or with the month's name, whole or short, before the day or after it,
    with or without st, nd, rd, th and commas. Null for other texts and for days that no month has."""
    plain = F.regexp_replace(F.regexp_replace(strip(c.cast("string")), r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[,\s]+|\s+of\s+", " ")
    number = lambda text, pattern, group: F.regexp_extract(text, pattern, group).try_cast("int")
    month = lambda text, pattern, group: F.array_position(F.array(*map(F.lit, _MONTHS)), F.regexp_extract(text, pattern, group)).cast("int")
    iso, signs = r"^(\d{4})-(\d{2})-(\d{2})(?:$|[ T])", r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    before, after = r"^(\w{3})[a-z]*\.? (\d{1,2}) (\d{4})$", r"^(\d{1,2}) (\w{3})[a-z]*\.? (\d{4})$"

    def by_name(t: Column) -> Column:
        first = F.when(t.rlike(before), _day(number(t, before, 3), month(t, before, 1), number(t, before, 2)))
        return first.when(t.rlike(after), _day(number(t, after, 3), month(t, after, 2), number(t, after, 1)))

    def said(t: Column) -> Column:
        year = F.regexp_extract(t, signs, 3)
        first = F.when(t.rlike(iso), _day(number(t, iso, 1), number(t, iso, 2), number(t, iso, 3)))
        first = first.when(t.rlike(signs), _day(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).try_cast("int"), number(t, signs, 1), number(t, signs, 2)))
        return first.otherwise(_once(F.initcap(F.regexp_replace(t, r"(?i)\bof ", "")), by_name))

    return _once(plain, said)


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once however often ``f`` reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def value_label(c: Column) -> Column:
    """null, bool, number, empty or string: what a validator calls a text cell."""
    t = strip(c.cast("string"))
    return F.when(c.isNull(), "null").when(t == "", "empty").when(F.lower(t).isin("true", "false"), "bool").when(t.rlike(FLOAT_PATTERN), "number").otherwise("string")


def is_emptyish(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))).isin(*EMPTY_WORDS)


def quantum(c: Column, tolerance: float) -> Column:
    """Index of the multiple of ``tolerance`` nearest to a number, half to even: equal tokens have equal indices."""
    return F.round(F.bround(c / F.lit(tolerance)), 0).cast("decimal(38,0)")


def match_token(c: Column, tolerance: float = 1e-2) -> Column:
    """A cell's token for comparing columns, without a UDF: numbers by their quantum, text stripped and lower-cased.

    Numbers, and text that reads as a finite one, share tokens; null, '' and blanks are ``EMPTY``; 'nan' stays text.
    """
    t = strip(c.cast("string"))
    value = F.when(t.rlike(FLOAT_PATTERN) & ~t.rlike("(?i)(inf|nan)"), F.regexp_replace(t, "_", "").try_cast("double"))
    return F.when(c.isNull() | (t == ""), EMPTY).when(value.isNotNull(), F.concat(F.lit("#"), quantum(value, tolerance).cast("string"))).otherwise(F.lower(t))


#: Types whose cells are numbers as they are. Floats and decimals aren't: what their text reads as is another double.
NUMBERS = ("double", "bigint", "int", "smallint", "tinyint")


def number_token(c: Column, tolerance: float = 1e-2) -> Column:
    """``match_token`` of a column of one of the types ``NUMBERS``, without writing it as text and reading that."""
    x = c.cast("double")
    odd = F.when(c.isNull(), EMPTY).when(F.isnan(x), "nan").when(x == float("inf"), "infinity").when(x == float("-inf"), "-infinity")
    return odd.otherwise(F.concat(F.lit("#"), quantum(x, tolerance).cast("string")))


def show_token(value: object, tolerance: float = 1e-6) -> str:
    """The token as it is shown: integers without a point, other numbers with up to 12 significant digits."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return EMPTY
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        text = value.strip()
        if not text:
            return EMPTY
        try:
            number = float(text)
        except ValueError:
            return text.lower()
        if math.isnan(number):
            return text.lower()
    else:
        number = float(value)
    number = round(number / tolerance) * tolerance
    whole = round(number)
    return str(whole) if abs(number - whole) < 1e-9 else f"{number:.12g}"


def show_tokens(tolerance: float = 1e-6):
    """``show_token`` as an Arrow-batched function, for displays; comparisons use ``match_token``."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: show_token(v, tolerance), na_action=None)

    return shown


def join_key(c: Column) -> Column:
    """One form for the keys 14, 14.0 and '14': null for null and ''; whole numbers without a point; other text lower-cased."""
    t = strip(c.cast("string"))
    whole = F.when(t.rlike(INT_PATTERN), F.regexp_replace(t, "_", "").try_cast("decimal(38,0)").cast("string"))
    number = F.when(t.rlike(FLOAT_PATTERN) & ~t.rlike("(?i)(inf|nan)"), F.regexp_replace(t, "_", "").try_cast("double"))
    as_whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("decimal(38,0)").cast("string"))
    return F.when(t == "", None).otherwise(F.coalesce(whole, as_whole, number.cast("string"), F.lower(t)))


def id_text(c: Column) -> Column:
    """An id as text without the '.0' that a float column gave it."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def is_true(c: Column) -> Column:
    """A filter that takes true, True and 'TRUE' alike."""
    return F.lower(c.cast("string")) == "true"
