"""SQLite tables as a Python data source: ``spark.read.format("sqlite").option("path", ...).option("table", ...)``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# The columns of a news table and their names here.
RENAMED = {"標題": "title", "連結": "url", "發布時間": "published_at", "內文": "html_text", "pdf內容": "pdf_text"}


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            names = ", ".join(_name(c) for c in self.columns)
            for row in con.execute(f"SELECT {names} FROM {_name(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in row)


class SqliteSource(DataSource):
    """Options: path, table, partitions (8). All columns are text; rows are read by ranges of row numbers."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            return StructType([StructField(r[1], StringType()) for r in con.execute(f"PRAGMA table_info({_name(self.options.get('table', 'latest_news'))})")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "latest_news"), schema.names, int(self.options.get("partitions", "8")))


def read_news_table(spark: SparkSession, path: str, table: str = "latest_news") -> DataFrame:
    """The news table with its columns renamed and missing ones empty."""
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", table).load().withColumnsRenamed(RENAMED)
    return df.withColumns({c: F.lit("") for c in (*RENAMED.values(), "text") if c not in df.columns})


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 8, **options: str) -> DataFrame:
    """A whole table of a database; with a numeric ``key`` and its bounds, in ranges read side by side. Needs the driver's jar."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()
