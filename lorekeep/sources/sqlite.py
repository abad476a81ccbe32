"""Tables of SQLite files as a batch source: read in ranges of rowids, with comparisons pushed into the query."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from .sessions import database_log

#: Spark's types for declared column types, by the first part that occurs in them.
TYPES = (("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()))
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def opened(path: str):
    """A read-only connection; the file may be in use by its owner."""
    import sqlite3
    from pathlib import Path

    return sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rowids(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteTable(DataSource):
    """spark.read.format("sqlite_table") with the options path, table and rows (rowids a task, 100000)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        kind = lambda declared: next((t for part, t in TYPES if part in declared.upper()), StringType())
        return StructType([StructField(c[1], kind(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", 100_000)))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Takes comparisons of a column with a number or text; Spark tests what is given back."""
        for f in filters:
            if type(f) in COMPARED and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.tests.append((f.attribute[0], COMPARED[type(f)], f.value))
            elif not isinstance(f, IsNotNull) or len(f.attribute) != 1:
                yield f
            else:
                self.tests.append((f.attribute[0], "IS NOT", None))

    def where(self) -> tuple[str, list]:
        return "".join(f" AND {quoted(c)} {op} ?" for c, op, _ in self.tests), [v for _, _, v in self.tests]

    def partitions(self) -> list[Rowids]:
        more, values = self.where()
        with opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)} WHERE 1 = 1{more}", values).fetchone()
        return [Rowids(0, -1)] if low is None else [Rowids(at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]

    def read(self, partition: Rowids) -> Iterator[tuple]:
        more, values = self.where()
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        casts = [fit[type(f.dataType)] for f in self.schema.fields]
        with opened(self.path) as db:
            for row in db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?{more}", [partition.first, partition.last, *values]):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))


#: SQLite keeps any type in any column: what does not fit is null.
def whole(v):
    return v if isinstance(v, int) else int(v) if isinstance(v, float) and v.is_integer() else None


fit = {
    LongType: whole, StringType: lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), BinaryType: lambda v: v if isinstance(v, bytes) else str(v).encode(),
    DoubleType: lambda v: float(v) if isinstance(v, (int, float)) else None,
}


def sqlite_table(spark: SparkSession, path: str, table: str, rows: int = 100_000) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("rows", rows).load()


def database_sessions(spark: SparkSession, path: str, since: int = 0, agent: str = "database") -> tuple[DataFrame, int]:
    """Messages of the sessions that were updated at or after `since` (milliseconds), and the cursor for the next read.

    Tables session (id, directory, time_updated, time_archived), message (id, session_id, role, time_created) and part
    (message_id, time, text). A session that goes on is given whole again.
    """
    rows = sqlite_table(spark, path, "session").filter(F.col("time_updated") >= since)
    newest = rows.agg(F.max("time_updated")).first()[0]
    messages = sqlite_table(spark, path, "message").join(rows.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    if "model" not in messages.columns:
        messages = messages.withColumn("model", F.lit(None).cast("string"))
    return database_log(spark, rows, messages, sqlite_table(spark, path, "part"), agent), since if newest is None else newest


