"""SQLite files as a Spark data source: one table's rows, read in ranges of row ids, with filters and columns pushed down."""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def open_read_only(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(declared: str) -> DataType:
    """A declared type's Spark type, by SQLite's rules of affinity; what is stored may differ, and is then converted."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return StringType()


def converted(value: object, kind: DataType) -> object:
    """A stored value as its column's type; null where it can't be one."""
    if value is None:
        return None
    try:
        if isinstance(kind, LongType):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(kind, BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.schema, self.parts, self.where, self.values = path, table, schema, parts, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        types = {f.name: f.dataType for f in self.schema}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = name in types and isinstance(types[name], LongType | DoubleType)
            if plain and type(f) in _OPERATORS and isinstance(f.value, int | float):
                self.where.append(f"{quoted(name)} {_OPERATORS[type(f)]} ?")
                self.values.append(f.value)
            elif name in types and isinstance(f, IsNull | IsNotNull):
                yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with open_read_only(self.path) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read whole
                return [_Range(0, -1)]
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.high >= partition.low:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        columns = ", ".join(quoted(f.name) for f in self.schema)
        sql = f"SELECT {columns} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        c = open_read_only(self.path)
        try:
            c.text_factory = bytes
            kinds = [f.dataType for f in self.schema]
            for row in c.execute(sql, values):
                yield tuple(converted(v, k) for v, k in zip(row, kinds))
        finally:
            c.close()


class SqliteSource(DataSource):
    """Options: path, dbtable, numPartitions (4). The file must be where the executors can open it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        with open_read_only(self.options["path"]) as c:
            found = c.execute(f"PRAGMA table_info({quoted(self.options['dbtable'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['dbtable']}")
        return StructType([StructField(name, affinity(declared)) for _, name, declared, *_ in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["dbtable"], schema, int(self.options.get("numpartitions", 4)))


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 4) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").option("path", path).option("dbtable", table).option("numPartitions", parts).load()


_COUNTS = "table_name string, column_name string, kind string, value string, cnt long, first_row long"


class _CountsReader(DataSourceReader):
    """Each range of row ids of each table is counted where it is read: a row per column and value of the range leaves it."""

    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for table in _own_tables(self.path):
            ranges = _Reader(self.path, table, StructType([]), self.parts).partitions()
            found += [_TableRange(table, r.low, r.high) for r in ranges]
        return found

    def read(self, partition: _TableRange) -> Iterator[tuple]:
        table, ranged = quoted(partition.table), partition.high >= partition.low
        with contextlib.closing(open_read_only(self.path)) as c:
            c.text_factory = lambda b: b.decode("utf-8", "replace")
            columns = [name for _, name, *_ in c.execute(f"PRAGMA table_info({table})").fetchall()]
            where = " WHERE rowid BETWEEN ? AND ?" if ranged else ""
            for name in columns:
                # a table without row ids is one range, whose order isn't known
                sql = f"SELECT {quoted(name)}, count(*), {'min(rowid)' if ranged else '0'} FROM {table}{where} GROUP BY 1"
                for value, n, first in c.execute(sql, (partition.low, partition.high) if ranged else ()):
                    yield (partition.table, name, *_shown(value), n, first)


class _TableRange(InputPartition):
    def __init__(self, table: str, low: int, high: int):
        super().__init__((table, low, high))
        self.table, self.low, self.high = table, low, high


def _shown(value: object) -> tuple[str, str | None]:
    """Kind and text of a stored value; equal numbers, whole or not, are one, as in SQLite."""
    if value is None:
        return "null", None
    if isinstance(value, bytes):
        return "blob", value.hex()
    if isinstance(value, float):
        return "number", str(int(value)) if value == int(value) and abs(value) < 2**53 else repr(value)
    return ("number", str(value)) if isinstance(value, int) else ("text", value)


class SqliteCounts(DataSource):
    """Options: path, numPartitions (4 for each table)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_counts"

    def schema(self) -> str:
        return _COUNTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CountsReader(self.options["path"], int(self.options.get("numpartitions", 4)))


def _own_tables(path: str) -> list[str]:
    with contextlib.closing(open_read_only(path)) as c:
        return [name for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall()]


def sqlite_statistics(spark: SparkSession, path: str, parts: int = 4, samples: int = 5, most: int = 60) -> DataFrame:
    """table_name, column_name, row_count, cardinality (different values, nulls apart), samples (value, cnt: the most frequent, nulls among them,
    ties to what comes first; null if the cardinality is over ``most``) and first_values (of the first two rows) of all columns of a file.

    Ranges of row ids are counted in the data source, and the counts of ranges are added up by value: no range's rows move."""
    spark.dataSource.register(SqliteCounts)
    parted = spark.read.format("sqlite_counts").option("path", path).option("numPartitions", parts).load()
    column = ["table_name", "column_name"]
    counts = parted.groupBy(*column, "kind", "value").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))
    whole = counts.groupBy(*column).agg(F.sum("cnt").alias("row_count"), F.count_if(F.col("kind") != "null").alias("cardinality"))
    rank = F.row_number().over(Window.partitionBy(*column).orderBy(F.desc("cnt"), "first_row", "kind", "value"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= samples)
    listed = best.groupBy(*column).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))), lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("cnt"))).alias("samples"))
    first, names = [], []
    with contextlib.closing(open_read_only(path)) as c:
        for table in _own_tables(path):
            own = [name for _, name, *_ in c.execute(f"PRAGMA table_info({quoted(table)})").fetchall()]
            names += [(table, name, k) for k, name in enumerate(own)]
            head = c.execute(f"SELECT * FROM {quoted(table)} LIMIT 2").fetchall()
            first += [(table, name, [_shown(row[k])[1] for row in head]) for k, name in enumerate(own)]
    known = spark.createDataFrame([(*n, f[2]) for n, f in zip(names, first, strict=True)], "table_name string, column_name string, place int, first_values array<string>")  # a row per column
    joined = known.join(whole, column, "left").join(listed, column, "left")
    shown = F.when(F.coalesce("cardinality", F.lit(0)) <= most, F.coalesce("samples", F.array().cast("array<struct<value:string,cnt:bigint>>")))
    return joined.select(*column, "place", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("cardinality", F.lit(0)).alias("cardinality"), shown.alias("samples"), "first_values")


def sqlite_catalog(spark: SparkSession, path: str) -> DataFrame:
    """table_name, sql, column_name, declared, row_count of a file's own tables, by name."""
    rows = []
    with open_read_only(path) as c:
        for table, sql in c.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            count = c.execute(f"SELECT count(*) FROM {quoted(table)}").fetchone()[0]
            rows += [(table, sql, name, declared, count) for _, name, declared, *_ in c.execute(f"PRAGMA table_info({quoted(table)})").fetchall()]
    return spark.createDataFrame(rows, "table_name string, sql string, column_name string, declared string, row_count long")


def register_tables(spark: SparkSession, path: str) -> list[str]:
    """Temporary views of all tables, for ``read_only_sql``."""
    names = [r["table_name"] for r in sqlite_catalog(spark, path).select("table_name").distinct().orderBy("table_name").collect()]
    for n in names:
        read_sqlite(spark, path, n).createOrReplaceTempView(n)
    return names
