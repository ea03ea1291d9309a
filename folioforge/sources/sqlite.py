"""Catalogues in SQLite files, opened read-only, as a Spark data source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def connect(path: str, timeout: float = 5.0) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=timeout)


class _Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as c:
            low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), 0) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Slice(k, k + step) for k in range(low, high + 1, step)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        cast = [{"bigint": int, "double": float}.get(f.dataType.simpleString(), str) for f in self.schema]
        cols = ", ".join(f'"{f.name}"' for f in self.schema)
        c = connect(self.path)
        try:
            for row in c.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                yield tuple(None if v is None else f(v) for f, v in zip(cast, row, strict=True))
        finally:
            c.close()


class SqliteSource(DataSource):
    """spark.read.format("sqlite_ro").option("path", file).option("table", name): rows by ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as c:
            info = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kind = lambda t: LongType() if "INT" in t.upper() or "BOOL" in t.upper() else DoubleType() if any(x in t.upper() for x in ("REAL", "FLOA", "DOUB")) else StringType()
        return StructType([StructField(r[1], kind(r[2] or "")) for r in info])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_ro").option("path", path).option("table", table).option("partitions", partitions).load()
