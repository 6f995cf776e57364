"""Scans of SQLite files as a Spark data source: tables and queries of a service's state, read by several tasks.

    spark.dataSource.register(SQLite)
    spark.read.format("quillon_sqlite").option("path", file).option("table", "runs").load()

Options: path, a file that all executors see; table; columns, comma-separated, all by default; parts, how many tasks
read (4). A task reads a range of row ids, so a table must have them (not WITHOUT ROWID). Filters that SQLite can judge
as Spark does go into its WHERE clause. Files are opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

BATCH = 8192
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path.removeprefix('file://')).resolve().as_uri()}?mode=ro", uri=True)


def column_type(declared: str):
    """Spark's type for a declared one, by SQLite's own rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if "BOOL" in d:
        return BooleanType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")) or not d or any(x in d for x in ("DATE", "TIME", "JSON")):
        return StringType()
    return BinaryType() if "BLOB" in d else DoubleType()


@dataclass
class Range(InputPartition):
    first: int
    last: int


class SQLiteReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("parts", 4))
        self.where, self.values = [], []

    def pushFilters(self, filters):
        """Comparisons of numbers and texts with constants; the others stay with Spark."""
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = kinds.get(column)
            plain = isinstance(kind, LongType) and (lambda v: isinstance(v, int) and not isinstance(v, bool)) or isinstance(kind, StringType) and (lambda v: isinstance(v, str)) or (lambda v: False)
            if isinstance(f, IsNull | IsNotNull) and column:
                self.where.append(f"{quoted(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            elif type(f) in _COMPARED and plain(f.value):
                self.where.append(f"{quoted(column)} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and all(map(plain, f.value)):
                self.where.append(f"{quoted(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f

    def partitions(self):
        with opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(1, 0)]
        size = (high - low) // self.parts + 1
        return [Range(at, min(at + size - 1, high)) for at in range(low, high + 1, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema]
        kinds = [{LongType: pa.int64(), BooleanType: pa.bool_(), StringType: pa.string(), BinaryType: pa.binary(), DoubleType: pa.float64()}[type(f.dataType)] for f in self.schema]
        text = f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.table)} WHERE {' AND '.join(['rowid BETWEEN ? AND ?', *self.where])}"
        with opened(self.path) as db:
            found = db.execute(text, [partition.first, partition.last, *self.values])
            while rows := found.fetchmany(BATCH):
                columns = []
                for values, kind in zip(zip(*rows), kinds):
                    cast = bool if pa.types.is_boolean(kind) else float if pa.types.is_floating(kind) else str if pa.types.is_string(kind) else None
                    columns.append(pa.array([v if v is None or cast is None else cast(v) for v in values], kind))
                yield pa.RecordBatch.from_arrays(columns, names)


class SQLite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_sqlite"

    def schema(self) -> StructType:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        with opened(self.options["path"]) as db:
            found = {r[1]: column_type(r[2] or "") for r in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")}
        missing = [c for c in wanted if c not in found]
        if missing or not found:
            raise ValueError(f"{self.options['table']} has no columns {missing or 'at all'}")
        return StructType([StructField(c, found[c]) for c in wanted or found])

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(schema, self.options)


def scan(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, parts: int = 4) -> DataFrame:
    """A table of a SQLite file; columns: only these are read."""
    spark.dataSource.register(SQLite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("quillon_sqlite").option("path", path).option("table", table).option("parts", parts)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
