"""A batch data source for SQLite files: spark.read.format("sqlite_table").option("path", ...).option("table", ...)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"INTEGER": LongType(), "INT": LongType(), "REAL": DoubleType()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Reads ranges of rowids, each in a task."""

    def __init__(self, path: str, table: str, columns: list[str], parts: int) -> None:
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[RowRange]:
        with self._open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with self._open() as db:
            yield from db.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(c[1], _TYPES.get(c[2].upper(), StringType())) for c in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.fieldNames(), int(self.options.get("parts", "8")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
