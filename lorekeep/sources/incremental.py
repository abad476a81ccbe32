"""Session logs read on from where the last read ended: a byte position for each file, and the fan-in of several sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, stored
from .growing import PIECE, lines_between
from .sessions import MESSAGE

#: Up to where a file has been read, and what its modification time was then.
CURSOR = "path string, position long, modified timestamp"


def no_cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CURSOR)


def changed(spark: SparkSession, root: str, cursors: DataFrame, force: bool = False, since: str | None = None) -> DataFrame:
    """path, size, modified, position, truncated of the .jsonl files below root that differ from their cursor; contents are not read.

    Sizes tell, not times: a line appended within the time that was seen before counts. A file shorter than its position
    was truncated and is read again from its start. force takes files that have not changed too. since is how far a look
    back reaches: files without a cursor that were last changed before are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = files.join(cursors.select("path", "position", F.col("modified").alias("seen")), "path", "left")
    truncated = F.coalesce(F.col("size") < F.col("position"), F.lit(False))
    rows = rows.withColumns({"truncated": truncated, "position": F.when(truncated, 0).otherwise(F.coalesce("position", F.lit(0))).cast("long")})
    fresh = F.lit(True) if force else F.col("seen").isNull() | (F.col("size") != F.col("position"))
    if since:
        rows = rows.filter(F.col("seen").isNotNull() | (F.col("modified") >= F.lit(since).cast("timestamp")))
    return rows.filter(fresh).select("path", "size", "modified", "position", "truncated")


def sought(batches):
    """Ranges -> the lines in them."""
    import pyarrow as pa

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, start, stop, line = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(line)], ["path", "start", "stop", "line"])

    for part in batches:
        for path, position, size, at in zip(*(part.column(c).to_pylist() for c in ("path", "position", "size", "at")), strict=True):
            rows, held, end = [], 0, min(at + PIECE, size)
            for start, stop, line in lines_between(path, position, at, end, tail=end == size):
                rows.append((path, start, stop, line))
                held += len(line)
                if held > 1 << 22:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def resume(spark: SparkSession, root: str, cursors: DataFrame, force: bool = False, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New lines (path, modified, seq, line, start, stop, truncated; a stored table), and the cursors after them.

    Only the bytes between a file's cursor and the size that it had when listed are read, in pieces by any number of tasks;
    what is appended meanwhile comes with the next read. A last line without its newline counts if it is JSON and waits
    otherwise. Any other line that is no JSON is delivered like the rest, for sessions.corrupt to put aside. Blank lines are
    passed over. Cursors of other files stay as they are; a file that has gone keeps its cursor.
    """
    files = stored(changed(ship(spark), root, cursors, force, since), "log-files")
    pieces = files.filter("size > position").select("path", "position", "size", F.explode(F.expr(f"sequence(position, size - 1, {PIECE}L)")).alias("at"))
    lines = stored(pieces.repartition("path", "at").mapInArrow(sought, "path string, start bigint, stop bigint, line string"), "log-lines")
    ends = lines.groupBy("path").agg(F.max("stop").alias("reached"))
    after = files.join(ends, "path", "left").select("path", F.coalesce("reached", "position").alias("position"), "modified")
    after = cursors.select("path", "position", "modified").join(after, "path", "left_anti").unionByName(after)
    place = F.struct(F.col("start").alias("block"), F.lit(0).cast("long").alias("row")).alias("seq")
    new = lines.filter(F.trim("line") != "").join(files.select("path", "modified", "truncated"), "path").select("path", "modified", place, "line", "start", "stop", "truncated")
    return stored(new, "log-new"), stored(after, "log-cursors")


def ingest(
    spark: SparkSession, sources: dict[str, tuple[str, Callable[..., DataFrame]]], cursors: DataFrame, force: bool = False
) -> tuple[DataFrame | None, DataFrame, dict[str, str]]:
    """New messages of all sources (agent -> root, adapter), the cursors after them, and the errors by agent.

    A source that can't be read leaves its cursors as they were and the other sources alone; no source, or none that
    can be read, gives no messages (None). Counts by agent are a groupBy of the messages.
    """
    found, errors = [], {}
    for agent, (root, adapter) in sources.items():
        try:
            lines, after = resume(spark, root, cursors, force)
        except PySparkException as error:
            errors[agent] = str(error).splitlines()[0]
            continue
        cursors = after
        found.append(adapter(lines, agent).select(*MESSAGE))
    return reduce(DataFrame.unionByName, found) if found else None, cursors, errors
