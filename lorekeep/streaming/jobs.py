"""Streaming ingestion and roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import upsert
from ..session import ship
from ..sources.growing import growing_lines


def follow_logs(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """New lines (path, seq, line) of the .jsonl files below root, appended ones included, each once and in the bytes that are new.

    The checkpoint holds how far every file has been read, so a restart goes on from there.
    """
    place = F.struct(F.col("start").alias("block"), F.lit(0).cast("long").alias("row"))
    return growing_lines(ship(spark), root, **options).select("path", place.alias("seq"), "line")


def register_sessions(lines: DataFrame, adapter: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a registry of sessions up to date: the adapter turns each batch of lines into messages; the batch is rolled up, merged by key and written as a new version.

    A session that grows after it was registered is opened again. Versions are folders; the newest complete one counts,
    so a batch that is replayed after a failure writes the same version again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from ..sources.sessions import sessions_of

        spark = batch.sparkSession
        new = sessions_of(adapter(batch)).withColumn("version", F.lit(epoch).cast("long"))
        before = latest(spark, target, epoch)
        if before is not None:
            told = ["messages", "started", "title", "cwd", "branch", "model"]
            known = before.select("agent", "session", *[F.col(c).alias(f"known_{c}") for c in told])
            new = new.join(known, ["agent", "session"], "left")
            merged = {c: F.coalesce(c, f"known_{c}") for c in ("cwd", "branch", "model")}  # a later part of a log need not repeat them
            merged |= {"messages": F.col("messages") + F.coalesce("known_messages", F.lit(0)), "started": F.least("started", "known_started"), "title": F.coalesce("known_title", "title")}
            new = new.withColumns(merged).drop(*[f"known_{c}" for c in told])
            new = upsert(before, new, ["agent", "session"], "version")
        new.write.mode("overwrite").parquet(f"{target}/version={epoch:012d}")

    stream = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="60 seconds")).start()


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a registry (older than `before`), found through Hadoop's file system, wherever that is."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = sorted(n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))
    done = [n for n in done if before is None or int(n.split("=")[1]) < before]
    return spark.read.parquet(f"{target}/{done[-1]}") if done else None


def activity_windows(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """An extension: counts by tumbling window and kind (ts, event_type), with a watermark for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
