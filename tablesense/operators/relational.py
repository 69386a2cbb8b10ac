"""Joins, deduplication, record merging and sampling, with an explicit order wherever "first" or "last" is said."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.functions.cells import id_text, is_emptyish
from tablesense.sources import store


#: Pairs of rows that one cell of a join of many with many has, about.
PAIRS = 2_000_000


def _dealt(a: DataFrame, b: DataFrame, keys: Sequence[tuple[Column, Column]], null_safe: bool) -> DataFrame:
    """The inner join of both sides. A key with more than ``PAIRS`` pairs is a grid: its left rows are dealt over the grid's rows and repeated in each of
    its columns, its right rows the other way round, so that each pair meets in one cell. A cell has ``PAIRS`` rows of one side at most, about, so it is
    joined by a hash table, which costs less for each pair than sorted rows do; rows of all other keys meet in a join that may spill.
    What is collected is one number; keys with a grid are as many as the result has ``PAIRS`` rows, at most."""
    names = [f"__k{i}" for i in range(len(keys))]
    same = lambda p, q: p.eqNullSafe(q) if null_safe else p == q
    plain = reduce(Column.__and__, [same(p, q) for p, q in keys])
    counted = [df.groupBy(*[k[side].alias(x) for k, x in zip(keys, names)]).agg(F.count("*").alias("n")).alias(f"s{side}") for side, df in enumerate((a, b))]
    both = counted[0].join(counted[1], reduce(Column.__and__, [same(F.col(f"s0.{x}"), F.col(f"s1.{x}")) for x in names]))
    pairs = F.col("s0.n").cast("double") * F.col("s1.n")
    wide = F.least(F.ceil(F.sqrt(pairs / PAIRS * F.col("s1.n") / F.col("s0.n"))), F.ceil(pairs / PAIRS), F.col("s1.n"))
    grids = both.where(pairs > PAIRS).select(*[F.col(f"s0.{x}").alias(x) for x in names], pairs.alias("__pairs"), wide.alias("__wide"), F.ceil(pairs / PAIRS / wide).alias("__high"))
    grids = store.written(grids, "grids")
    total = grids.agg(F.sum("__pairs")).first()[0]
    if total is None:
        return a.join(b, plain)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(total / PAIRS), 10_000))
    high, wide = (F.col(c).cast("int") for c in ("__high", "__wide"))
    cells, rest = [], []
    for side, (df, own, times) in enumerate(((a, high, wide), (b, wide, high))):
        of_grid = reduce(Column.__and__, [same(k[side], F.col(x)) for k, x in zip(keys, names)])
        rest.append(df.join(F.broadcast(grids), of_grid, "left_anti"))
        found = df.join(F.broadcast(grids), of_grid)
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), own).cast("int").alias("__own")
        placed = found.select(*[df[f"`{c}`"] for c in df.columns], wide.alias("__w"), times.alias("__times"), place)
        each = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__again"))  # one place for all copies
        row, column = ("__own", "__again") if side == 0 else ("__again", "__own")
        cell = F.struct(*[k[side].alias(x) for k, x in zip(keys, names)], (F.col(row) * F.col("__w") + F.col(column)).alias("at"))
        cells.append(each.select(*[F.col(f"`{c}`") for c in df.columns], cell.alias(f"__cell{side}")).repartition(parts, f"__cell{side}"))
    met = cells[0].hint("shuffle_hash").join(cells[1], F.col("__cell0") == F.col("__cell1"))  # fields of structs are equal if both are null
    return met.drop("__cell0", "__cell1").unionByName(rest[0].join(rest[1], plain))


def merge(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None, left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = True, normalise_keys: bool = False, many: bool = False) -> DataFrame:
    """An equi-join with named results: other columns of the same name get suffixes, a common key comes once, keys of
    different names both stay. ``null_safe`` lets missing keys match each other; ``normalise_keys`` compares ids as
    text without a trailing '.0'. Inputs are renamed before the join, so the plan is one equi-join. ``many`` is for inner joins whose
    keys have many rows on both sides: keys are counted first, and the pairs of frequent ones are dealt out over tasks."""
    left_on, right_on = list(on or left_on or ()), list(on or right_on or ())
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("keys of both sides are needed, as many of each")
    common = set(on or ())
    twice = (set(left.columns) & set(right.columns)) - common
    a = left.toDF(*[f"l.{c}" for c in left.columns])
    b = right.toDF(*[f"r.{c}" for c in right.columns])
    condition = F.lit(True)
    keys = [(F.col(f"`l.{x}`"), F.col(f"`r.{y}`")) for x, y in zip(left_on, right_on)]
    if normalise_keys:
        keys = [(id_text(p), id_text(q)) for p, q in keys]
    if many:
        if how != "inner":
            raise ValueError("only inner joins are dealt out")
        joined = _dealt(a, b, keys, null_safe)
    else:
        for p, q in keys:
            condition = condition & (p.eqNullSafe(q) if null_safe else p == q)
        joined = a.join(b, condition, how)
    out = []
    for c in left.columns:
        own = F.col(f"`l.{c}`")
        if c in common and how in ("right", "outer", "full"):
            own = F.coalesce(own, F.col(f"`r.{c}`"))
        out.append(own.alias(c + suffixes[0] if c in twice else c))
    out += [F.col(f"`r.{c}`").alias(c + suffixes[1] if c in twice else c) for c in right.columns if c not in common]
    return joined.select(*out)


def members(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key is among the other side's."""
    return left.join(right.select(F.col(other or key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def unmatched(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key isn't among the other side's."""
    return left.join(right.select(F.col(other or key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order given: an aggregate, with partial results before the shuffle."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first.alias("__row")).select("__row.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value, the most frequent first; nulls aren't values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def limited(df: DataFrame, limit: int, order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows, and a one-row table that says if there are more. One row too many is read, no more."""
    some = df.orderBy(*order).limit(limit + 1)
    flag = some.agg((F.count("*") > limit).alias("truncated"), F.least(F.count("*"), F.lit(limit)).alias("row_count"))
    return some.orderBy(*order).limit(limit), flag


def spread_places(n: int, size: int) -> list[int]:
    """Places of a sample of ``size`` from n rows: both ends and evenly spread ones, rounded half to even."""
    if n <= size:
        return list(range(n))
    if size < 2:
        return [0][:size]
    return sorted({round(k * (n - 1) / (size - 1)) for k in range(size)})


def diverse_sample(df: DataFrame, size: int, order: str) -> DataFrame:
    """Rows evenly spread over the order, both ends included. ``order`` is a unique column; only its values are ranked,
    by range partitions with prefix sums, and the rows at the chosen places are joined."""
    n = df.count()
    wanted = spread_places(n, size)
    placed = ranked(df.select(order), order)
    at = placed.where(F.col("pos").isin(wanted)).select(order)
    return df.join(F.broadcast(at), order, "left_semi")


def ranked(df: DataFrame, order: str) -> DataFrame:
    """``df`` with pos, from 0 in ascending order (nulls first), without putting all rows into one task. Rows are range-sorted into a written table
    once; a partition's first place is a prefix sum over the partitions' sizes, of which there is a row each."""
    spark, folder = df.sparkSession, store.work_folder(df.sparkSession, "ranked")
    dealt = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    dealt.write.parquet(folder)
    written = spark.read.schema(dealt.schema).parquet(folder)
    sizes = sorted((r["part"], r["n"]) for r in written.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for part, n in sizes:
        bases.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "__part long, __base long"))
    nth = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return written.join(base, F.shiftright("__at", 33) == F.col("__part")).withColumn("pos", F.col("__base") + nth).drop("__part", "__base", "__at")


def last_record(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last whole record of each key; records without a key are left out."""
    kept = df.where(F.col(key).isNotNull())
    return kept.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def last_values(df: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the last value of each column that isn't null."""
    others = [c for c in df.columns if c not in (key, order)]
    kept = df.where(F.col(key).isNotNull())
    return kept.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])


def merged_records(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key, nulls of it included, in the order in which keys came first (column first_seen)."""
    kept = df.where(F.col(key).isNotNull())
    rows = kept.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), order).alias("__row"), F.min(order).alias("first_seen"))
    return rows.select("__row.*", "first_seen")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing but empty cells, found in one pass; one column stays."""
    found = df.agg(*[F.count_if(~is_emptyish(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if found[i]] or df.columns[:1]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def rectangular(cells: Column, width: int) -> Column:
    """A row of exactly ``width`` cells: short ones padded with '', long ones cut."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(cells, i), F.lit("")))


def above_threshold(df: DataFrame, field: str, rules: DataFrame, text_col: str, default: float | None = None) -> DataFrame:
    """Rows whose field is over the first threshold that the rule text states for it, as "field ... above 1.2"."""
    pattern = rf"(?i){field}[^.\n]{{0,80}}?(?:above|greater than|over|exceeds|>)\s*([0-9]+(?:\.[0-9]+)?)"
    found = rules.select(F.regexp_extract(text_col, pattern, 1).alias("__t")).where("__t <> ''").limit(1)
    limit = found.agg(F.coalesce(F.max(F.col("__t").cast("double")), F.lit(default)).alias("__limit"))
    return df.crossJoin(F.broadcast(limit)).where(F.col(field) > F.col("__limit")).drop("__limit")
