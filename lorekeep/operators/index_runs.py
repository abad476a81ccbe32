"""Document chunks kept up to date in runs: only changed files are chunked, and a run counts once its last table is complete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import OVERLAP, SIZE, chunk_documents
from .mutations import compare_index


class ChunkIndex:
    """Chunks of the files of a source below a folder that all executors share.

    A run writes the chunks of new and changed files, then the state: a row for each file that is there now, with its hash,
    the run that holds its chunks, their number and status (ready, empty or failed). Readers take the newest complete
    state, so a run that fails half-way, or is running, leaves everything readable as it was; old chunks of a file stay
    on disk until purge().
    """

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE, overlap: int = OVERLAP):
        self.spark, self.path, self.size, self.overlap = spark, path.rstrip("/"), size, overlap

    def at(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[int]:
        """Complete runs, oldest first."""
        top, files = self.at(self.path)
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        numbers = sorted(int(n.split("-")[1]) for n in names if n.startswith("run-"))
        return [n for n in numbers if files.exists(self.at(f"{self.path}/run-{n:06d}/state/_SUCCESS")[0])]

    def state(self) -> DataFrame | None:
        """key, hash, run, chunks, status of the files that are indexed."""
        done = self.runs()
        return self.spark.read.parquet(f"{self.path}/run-{done[-1]:06d}/state") if done else None

    def chunks(self) -> DataFrame | None:
        """key, ord, heading, content, char_start, char_end of every indexed file."""
        state = self.state()
        if state is None:
            return None
        used = [r[0] for r in state.select("run").distinct().collect()]  # runs, not files
        parts = [self.spark.read.parquet(f"{self.path}/run-{n:06d}/chunks").withColumn("run", F.lit(n)) for n in used]
        return reduce(DataFrame.unionByName, parts).join(state.select("key", "run"), ["key", "run"], "left_semi").drop("run") if parts else None

    def reindex(self, files: DataFrame) -> DataFrame:
        """Brings the index to files (key, hash, content) and returns key, state (new, changed, same, gone) of each.

        A file without text has no chunks and the status empty. Repeated keys count once.
        """
        before, done = self.state(), self.runs()
        files = files.dropDuplicates(["key"])
        known = before if before is not None else self.spark.createDataFrame([], "key string, hash string, run int, chunks long, status string")
        number = done[-1] + 1 if done else 1
        to = f"{self.path}/run-{number:06d}"
        compare_index(files, known).write.mode("overwrite").parquet(f"{to}/compared")
        states = self.spark.read.parquet(f"{to}/compared")
        todo = files.join(states.filter("state in ('new', 'changed')"), "key", "left_semi")
        numbered = todo.withColumn("id", F.xxhash64("key"))
        made = chunk_documents(numbered, self.size, self.overlap).withColumnRenamed("doc", "id").join(numbered.select("id", "key"), "id").drop("id")
        made.write.mode("overwrite").parquet(f"{to}/chunks")
        counts = self.spark.read.parquet(f"{to}/chunks").groupBy("key").agg(F.count(F.lit(1)).alias("chunks"))
        fresh = todo.select("key", "hash", F.lit(number).alias("run")).join(counts, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
        fresh = fresh.withColumn("status", F.when(F.col("chunks") == 0, "empty").otherwise("ready"))
        kept = known.join(states.filter("state = 'same'"), "key", "left_semi")
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{to}/state")
        return states

    def purge(self) -> list[int]:
        """Deletes runs that no indexed file needs, and those that never were completed; returns their numbers."""
        state = self.state()
        used = set() if state is None else {r[0] for r in state.select("run").distinct().collect()} | {self.runs()[-1]}
        top, files = self.at(self.path)
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        gone = sorted(n for n in (int(x.split("-")[1]) for x in names if x.startswith("run-")) if n not in used)
        for n in gone:
            files.delete(self.at(f"{self.path}/run-{n:06d}")[0], True)
        return gone
