"""A query as data: sources, joins, filters, groups, measures, order, limit. It is compiled to one lazy DataFrame.

What is said declaratively can be checked and repaired before it runs: a wrong column is renamed, a key normalised, a
filter loosened, by making another specification. There is no program text to run.

Tables may be reshaped on the way: columns melted into rows first; windows (ranks, shifts, running and rolling aggregates) over the
filtered rows; and rows pivoted into columns in place of groups and measures.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as Frame
from pyspark.sql import functions as F

from tablesense.functions.cells import id_text
from tablesense.operators.relational import merge

MEASURES = {
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "total": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "count_distinct": F.count_distinct,
    "monthly_avg": lambda c: F.avg(c) / 12,
}
_COMPARISONS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Join:
    source: str
    left_on: tuple[str, ...]
    right_on: tuple[str, ...]
    how: str = "inner"
    normalise: bool = False


@dataclass(frozen=True)
class Filter:
    """op: a comparison, in, between, like, contains, is_true, is_null, not_null, year, yyyymm. ``loose`` compares text without
    case and ids without '.0'."""

    column: str
    op: str
    value: object = None
    loose: bool = False


@dataclass(frozen=True)
class Measure:
    name: str
    function: str
    column: str = "*"


@dataclass(frozen=True)
class Melt:
    """A row for each of ``values``: the kept columns, the column's name and its value. Columns of different types become text. Null
    values keep their rows."""

    keep: tuple[str, ...]
    values: tuple[str, ...]
    names_to: str = "variable"
    values_to: str = "value"


@dataclass(frozen=True)
class Windowed:
    """A column over the rows of equal ``partition`` in ``order`` (column, descending): rank, dense_rank, row_number, percent_rank; shift by ``rows``
    (negative: from later rows); or an aggregate of MEASURES, over all rows up to this one (``rows`` None) or over this one and the ``rows`` - 1
    before it. Like a rolling window elsewhere, an aggregate of fewer than ``least`` values that aren't null is null. Nulls are ordered last.
    Without a partition the whole table is one: give one wherever the table is large."""

    name: str
    function: str
    column: str = "*"
    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    rows: int | None = None
    least: int = 1


@dataclass(frozen=True)
class Pivot:
    """A row for each value of ``index`` and a column for each of ``values_in`` of ``columns``, with a measure of ``values``. Which columns there
    are is said beforehand, so that nothing has to run to know the schema; rows of other values count in no column, but their index stays."""

    index: tuple[str, ...]
    columns: str
    values: str
    function: str
    values_in: tuple[object, ...]
    fill: object = None


@dataclass(frozen=True)
class QuerySpec:
    source: str
    joins: tuple[Join, ...] = ()
    melt: Melt | None = None
    windows: tuple[Windowed, ...] = ()
    where_windows: tuple[Filter, ...] = ()
    pivot: Pivot | None = None
    filters: tuple[Filter, ...] = ()
    derived: Mapping[str, str] = field(default_factory=dict)
    groups: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    having: tuple[Filter, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # column, descending
    limit: int | None = None
    distinct: bool = False
    columns: tuple[str, ...] = ()

    def with_column_renamed(self, old: str, new: str) -> QuerySpec:
        """The specification with a column's name replaced wherever it stands."""
        name = lambda c: new if c == old else c
        return replace(
            self,
            joins=tuple(replace(j, left_on=tuple(map(name, j.left_on)), right_on=tuple(map(name, j.right_on))) for j in self.joins),
            filters=tuple(replace(f, column=name(f.column)) for f in self.filters),
            groups=tuple(map(name, self.groups)),
            measures=tuple(replace(m, column=name(m.column)) for m in self.measures),
            order=tuple((name(c), d) for c, d in self.order),
            columns=tuple(map(name, self.columns)),
            melt=self.melt and replace(self.melt, keep=tuple(map(name, self.melt.keep)), values=tuple(map(name, self.melt.values))),
            windows=tuple(replace(w, column=name(w.column), partition=tuple(map(name, w.partition)), order=tuple((name(c), d) for c, d in w.order)) for w in self.windows),
            where_windows=tuple(replace(f, column=name(f.column)) for f in self.where_windows),
            pivot=self.pivot and replace(self.pivot, index=tuple(map(name, self.pivot.index)), columns=name(self.pivot.columns), values=name(self.pivot.values)),
        )


def predicate(f: Filter) -> Column:
    c = F.col(f"`{f.column}`")
    if f.op == "is_null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    if f.op == "is_true":
        return F.lower(c.cast("string")) == str(f.value if f.value is not None else True).lower()
    if f.op == "year":
        return F.year(c) == f.value
    if f.op == "yyyymm":
        return F.date_format(c, "yyyyMM") == str(f.value)
    if f.op == "between":
        return c.between(*f.value)
    if f.loose:
        text = lambda v: str(v).strip().lower().removesuffix(".0")
        own = F.lower(F.trim(id_text(c)))
        if f.op == "in":
            return own.isin([text(v) for v in f.value])
        if f.op in ("=", "!="):
            return _COMPARISONS[f.op](own, F.lit(text(f.value)))
    if f.op == "in":
        return c.isin(list(f.value))
    if f.op == "like":
        return c.ilike(str(f.value))
    if f.op == "contains":
        return F.contains(F.lower(c), F.lit(str(f.value).lower()))
    return _COMPARISONS[f.op](c, F.lit(f.value))


_RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number, "percent_rank": F.percent_rank}


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def _melted(df: DataFrame, m: Melt) -> DataFrame:
    kinds = {t for c, t in df.dtypes if c in m.values}
    value = (lambda c: _named(c)) if len(kinds) < 2 else (lambda c: _named(c).cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias(m.names_to), value(c).alias(m.values_to)) for c in m.values])
    return df.select(*map(_named, m.keep), F.explode(cells).alias("__cell")).select(*map(_named, m.keep), f"__cell.`{m.names_to}`", f"__cell.`{m.values_to}`")


def _windowed(w: Windowed) -> Column:
    over: WindowSpec = Frame.partitionBy(*map(_named, w.partition)).orderBy(*[_named(c).desc_nulls_last() if down else _named(c).asc_nulls_last() for c, down in w.order])
    if w.function in _RANKS:
        return _RANKS[w.function]().over(over)
    if w.function == "shift":
        return F.lag(_named(w.column), w.rows if w.rows is not None else 1).over(over)
    if w.order:
        over = over.rowsBetween(Frame.unboundedPreceding if w.rows is None else 1 - w.rows, Frame.currentRow)
    c = F.lit(1) if w.column == "*" else _named(w.column)
    return F.when(F.count(c).over(over) >= w.least, MEASURES[w.function](c).over(over))


def _pivoted(df: DataFrame, p: Pivot) -> DataFrame:
    made = df.groupBy(*map(_named, p.index)).agg(*[MEASURES[p.function](F.when(_named(p.columns) == F.lit(v), _named(p.values))).alias(str(v)) for v in p.values_in])
    return made if p.fill is None else made.fillna(p.fill, [str(v) for v in p.values_in])


def compile_spec(spec: QuerySpec, sources: Mapping[str, DataFrame]) -> DataFrame:
    """The DataFrame of a specification. Columns and filters reach the scans by Catalyst; nothing runs here."""
    df = sources[spec.source]
    for j in spec.joins:
        if j.left_on == j.right_on:
            df = merge(df, sources[j.source], on=list(j.left_on), how=j.how, null_safe=False, normalise_keys=j.normalise)
        else:
            df = merge(df, sources[j.source], left_on=list(j.left_on), right_on=list(j.right_on), how=j.how, null_safe=False, normalise_keys=j.normalise)
    if spec.melt:
        df = _melted(df, spec.melt)
    for name, expression in spec.derived.items():
        df = df.withColumn(name, F.expr(expression))
    for f in spec.filters:
        df = df.where(predicate(f))
    if spec.windows:
        df = df.withColumns({w.name: _windowed(w) for w in spec.windows})
        for f in spec.where_windows:
            df = df.where(predicate(f))
    if spec.pivot:
        df = _pivoted(df, spec.pivot)
    elif spec.measures:
        made = [MEASURES[m.function](F.col(f"`{m.column}`") if m.column != "*" else F.lit(1)).alias(m.name) for m in spec.measures]
        df = df.groupBy(*[F.col(f"`{g}`") for g in spec.groups]).agg(*made)
        for f in spec.having:
            df = df.where(predicate(f))
    elif spec.groups:
        df = df.select(*spec.groups).distinct()
    if spec.columns:
        df = df.select(*[F.col(f"`{c}`") for c in spec.columns])
    if spec.distinct:
        df = df.distinct()
    if spec.order:
        df = df.orderBy(*[F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in spec.order])
    return df.limit(spec.limit) if spec.limit is not None else df
