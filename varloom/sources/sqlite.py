"""Whole-table load from a SQLite file, read by ranges of row ids.

A Python data source: the schema comes from the table's declaration, and every task
opens the file by itself, read-only, and reads one range of row ids in batches.  The file
must be in a folder that all executors see.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", file).option("table", "mutation").option("partitions", 8).load()
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from varloom.operators.filters import BadRequest
from varloom.roles import UnknownTable

#: Rows fetched at once.
BATCH = 10_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type_of(declared: str) -> T.DataType:
    """The Spark type of a declared column type, by SQLite's own rules of affinity."""
    kind = declared.upper()
    if "INT" in kind:
        return T.LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not kind or "BLOB" in kind:
        return T.BinaryType()
    if any(x in kind for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.StringType() if any(x in kind for x in ("DATE", "TIME")) else T.DoubleType()


class SqliteSource(DataSource):
    """Options: path, table, partitions (1 by default)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise UnknownTable(f"table {self.options['table']!r} not found")
        return T.StructType([T.StructField(c[1], _type_of(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.wanted = int(options.get("partitions", 1))
        if self.wanted < 1:
            raise BadRequest("partitions must be at least 1")

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of equal width between the least and the largest row id; a gap makes some of them smaller."""
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(1, 0)]
        n = min(self.wanted, high - low + 1)
        edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
        return [RowRange(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        shape = to_arrow_schema(self.schema)
        with _open(self.path) as db:
            rows = db.execute(
                f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)
            )
            while found := rows.fetchmany(BATCH):
                columns = [
                    pa.array([_as(v, f.dataType) for v in values], field.type)
                    for values, f, field in zip(zip(*found, strict=True), self.schema.fields, shape, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)


def _as(value: object, kind: T.DataType) -> object:
    """A stored value as the column's type; SQLite may hold a value of any type in any column, what does not fit is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value.decode(errors="replace") if isinstance(value, bytes) else str(value)
        if isinstance(kind, T.BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError, OverflowError):
        return None


def load_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 1) -> DataFrame:
    """A table of a SQLite file, read by so many tasks."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()
