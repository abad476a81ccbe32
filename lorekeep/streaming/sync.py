"""From session logs to the graph in one chain: sessions, memories, vectors, entities, edges, one commit a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import clamp, content_hash
from ..operators import delta, entities, extraction
from ..operators.documents import hash_embed
from ..operators.similarity import refreshed_pairs
from ..session import ship, stored
from ..sources.sessions import sessions_of

#: The tables of a store that is kept up to date, with their columns.
TABLES = {
    "conversations": "agent string, session string, messages bigint, started timestamp, ended timestamp, title string, cwd string, branch string, model string, memories bigint",
    "memories": "id bigint, kind string, title string, content string, tags array<string>, sensitivity string, status string, importance double, confidence double, pinned boolean,"
    " session string, project string, created timestamp_ntz, content_hash string",
    "vectors": "id bigint, embedding array<double>",
    "entities": "entity bigint, name string, aliases array<string>, mentions bigint",
    "links": "memory bigint, entity bigint",
    "pairs": "source bigint, target bigint, score double",
    "edges": "source bigint, target bigint, kind string, weight double",
}
COUNTERS = ("processed", "skipped", "created", "pending", "merged", "edges")


class Versions:
    """Versions of TABLES in a shared folder; a version counts once its counters, which come last, are complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = ship(spark), path.rstrip("/")

    def numbers(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(conf)
        names = [s.getPath().getName() for s in files.listStatus(path(self.path))] if files.exists(path(self.path)) else []
        found = sorted(int(n.split("-")[1]) for n in names if n.startswith("version-"))
        return [n for n in found if files.exists(path(f"{self.path}/version-{n:012d}/counters/_SUCCESS"))]

    def read(self, before: int | None = None) -> dict[str, DataFrame]:
        """The tables of the newest version (older than `before`), empty ones where there is none."""
        done = [n for n in self.numbers() if before is None or n < before]
        if not done:
            return {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/version-{done[-1]:012d}/{name}") for name, schema in TABLES.items()}

    def counters(self, number: int) -> dict[str, int]:
        return self.spark.read.parquet(f"{self.path}/version-{number:012d}/counters").first().asDict()

    def commit(self, number: int, tables: dict[str, DataFrame], counters: dict[str, int]) -> None:
        for name, schema in TABLES.items():
            columns = [x.split()[0] for x in schema.split(", ")]
            tables[name].select(*columns).write.mode("overwrite").parquet(f"{self.path}/version-{number:012d}/{name}")
        row = self.spark.range(1).select(*[F.lit(counters[c]).cast("long").alias(c) for c in COUNTERS])
        row.write.mode("overwrite").parquet(f"{self.path}/version-{number:012d}/counters")


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors of length one, without those that have none."""
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x * x))
    return rows.withColumn("norm", norm).filter("norm > 0").select("id", F.transform("embedding", lambda x: x / F.col("norm")).alias("embedding"))


def registered(known: DataFrame, messages: DataFrame) -> DataFrame:
    """The registry after more messages: counts add up, the first title stays, the last place, branch and model count."""
    new = sessions_of(messages).withColumn("late", F.lit(1)).withColumn("memories", F.lit(0).cast("long"))
    both = known.withColumn("late", F.lit(0)).unionByName(new)
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("late"))).alias(c) for c in ("cwd", "branch", "model")}
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("late"))).alias("title")
    return both.groupBy("agent", "session").agg(F.sum("messages").alias("messages"), F.min("started").alias("started"), F.max("ended").alias("ended"), title, *last.values(), F.sum("memories").alias("memories"))


def extracted(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Memories that the rules find in the messages of sessions, numbered by what they say and where."""
    turns = messages.join(sessions.select("agent", "session"), ["agent", "session"], "left_semi")
    turns = turns.select(F.concat_ws("|", "agent", "session").alias("conv_id"), F.col("seq.block").alias("turn"), "role", "text")
    known = sessions.select(F.concat_ws("|", "agent", "session").alias("conv_id"), F.col("cwd").alias("project"), F.col("ended").cast("timestamp_ntz").alias("created"))
    rows = extraction.extract(turns).join(known, "conv_id")
    return rows.select(
        F.xxhash64("conv_id", "kind", "title", "content").alias("id"), "kind", "title", "content", F.array("tag").alias("tags"), "sensitivity", extraction.route(F.col("confidence")).alias("status"),
        "importance", "confidence", F.lit(False).alias("pinned"), F.col("conv_id").alias("session"), "project", "created", content_hash(F.col("kind"), F.col("title"), F.col("content")).alias("content_hash"),
    ).dropDuplicates(["id"])


def twins(new: DataFrame, vectors: DataFrame, old: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """id, twin: which memory a new one repeats: one of equal content, else the most similar of its kind above the threshold.

    A twin is an old memory, or the new one with the smallest number that repeats none itself.
    """
    first = W.partitionBy("content_hash")
    same = new.withColumn("least", F.min("id").over(first)).join(old.groupBy("content_hash").agg(F.min("id").alias("was")), "content_hash", "left")
    exact = same.select("id", F.coalesce("was", F.when(F.col("id") != F.col("least"), F.col("least"))).alias("twin")).filter("twin is not null")
    kinds = old.select("id", "kind", F.lit(0).alias("age")).union(new.select("id", "kind", F.lit(1).alias("age")))
    both = pairs.filter(F.col("score") >= threshold)
    both = both.select("source", "target", "score").union(both.select("target", "source", "score"))
    both = both.join(new.select(F.col("id").alias("source"), "kind"), "source").join(kinds.withColumnsRenamed({"id": "target", "kind": "other"}), "target").filter("kind = other and (age = 0 or target < source)")
    best = both.groupBy("source").agg(F.max_by("target", F.struct(-F.col("age"), F.col("score"), -F.col("target"))).alias("twin"))
    near = best.withColumnRenamed("source", "id").join(exact.select("id"), "id", "left_anti").select("id", "twin")
    found = stored(exact.unionByName(near), "twins")
    over = found.select(F.col("id").alias("twin"), F.col("twin").alias("further"))
    return stored(found.join(over, "twin", "left").select("id", F.coalesce("further", "twin").alias("twin")), "twins-resolved")


def absorbed(memories: DataFrame, new: DataFrame, repeats: DataFrame) -> DataFrame:
    """Memories after what repeats them: tags united, importance +0.08 each, the surer confidence, much longer content, secrecy only up."""
    more = new.join(repeats, "id").groupBy("twin").agg(
        F.array_distinct(F.flatten(F.collect_list("tags"))).alias("more_tags"), F.count(F.lit(1)).alias("times"), F.max("confidence").alias("surer"),
        F.max_by("content", F.struct(F.length("content"), "content")).alias("longest"), F.max(F.col("sensitivity") == "secret").alias("hidden"),
    )
    rows = memories.join(more.withColumnRenamed("twin", "id"), "id", "left")
    hit = F.col("times").isNotNull()
    return rows.withColumns({
        "tags": F.when(hit, F.array_union("tags", "more_tags")).otherwise(F.col("tags")), "importance": F.when(hit, clamp(F.col("importance") + 0.08 * F.col("times"))).otherwise(F.col("importance")),
        "confidence": F.greatest("confidence", "surer"), "content": F.when(F.length("longest") > 1.2 * F.length("content"), F.col("longest")).otherwise(F.col("content")),
        "sensitivity": F.when(F.coalesce("hidden", F.lit(False)), "secret").otherwise(F.col("sensitivity")),
    }).select(*memories.columns)


def sync_batch(store: Versions, messages: DataFrame, number: int, names: Callable[[Column], Column] | None = None, least: int = 4, threshold: float = 0.62, same: float = 0.92) -> dict[str, int]:
    """Takes a batch of messages (sources.sessions.MESSAGE) into version `number` and returns its counters.

    Everything starts from the newest version under `number` and every id comes from contents, so a batch that is replayed
    after a failure writes the same version; one that is complete is left as it is. Sessions of under `least` messages so far are registered and skipped.
    names finds the entities in a memory's content. Messages that were read before a session was long enough are not read
    again. An empty batch commits a version that equals the one before.
    """
    if number in store.numbers():
        return store.counters(number)
    before = store.read(number)
    messages = stored(messages, "sync-messages")
    sessions = stored(registered(before["conversations"], messages), "sync-sessions")
    touched = stored(messages.select("agent", "session").distinct(), "sync-touched")
    long = sessions.join(touched, ["agent", "session"], "left_semi").filter(F.col("messages") >= least)
    found = extracted(messages, long)
    new = stored(found.join(before["memories"].select("id"), "id", "left_anti"), "sync-new")
    fresh = stored(unit(hash_embed(new.withColumn("content", F.concat_ws("\n", "title", "content")))), "sync-vectors")
    vectors = before["vectors"].unionByName(fresh)
    pairs = stored(refreshed_pairs(before["pairs"], vectors, fresh.select("id"), min(threshold, same)), "sync-pairs")
    repeats = twins(new, fresh, before["memories"], pairs, same)
    came = stored(new.join(repeats.select("id"), "id", "left_anti"), "sync-came")
    memories = stored(absorbed(before["memories"].unionByName(came.select(*before["memories"].columns)), new, repeats), "sync-memories")
    lost = repeats.select("id")
    vectors = stored(vectors.join(lost, "id", "left_anti"), "sync-kept-vectors")
    named = new.join(repeats, "id", "left").select(F.coalesce("twin", "id").alias("memory"), F.explode((names or (lambda c: F.array().cast("array<string>")))(F.col("content"))).alias("name"), F.array().cast("array<string>").alias("aliases"))
    things, links = entities.upsert(before["entities"], before["links"], named)
    things, links = stored(things, "sync-entities"), stored(links, "sync-links")
    mentions = lambda e: e.select("entity", "mentions")
    was = delta.State(before["memories"], before["vectors"], before["links"], mentions(before["entities"]))
    now = delta.State(memories, vectors, links, mentions(things))
    changed = delta.any_of(came.select("id"), repeats.select(F.col("twin").alias("id")), named.select(F.col("memory").alias("id")))
    edges, kept = delta.refreshed(before["edges"], before["pairs"], was, now, changed, threshold)
    edges = stored(edges, "sync-edges")
    made = came.groupBy("session").agg(F.count(F.lit(1)).alias("made")).withColumnsRenamed({"session": "conv"})
    sessions = sessions.join(made, F.concat_ws("|", "agent", "session") == F.col("conv"), "left").withColumn("memories", F.col("memories") + F.coalesce("made", F.lit(0))).drop("conv", "made")
    tables = {"conversations": sessions, "memories": memories, "vectors": vectors, "entities": things, "links": links, "pairs": kept, "edges": edges}
    n, active = long.count(), came.filter("status = 'active'").count()
    counters = {"processed": n, "skipped": touched.count() - n, "created": active, "pending": came.count() - active, "merged": repeats.count(), "edges": edges.join(before["edges"], ["source", "target", "kind"], "left_anti").count()}
    store.commit(number, tables, counters)
    return counters


def sync(store: Versions, messages: DataFrame, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Follows a stream of messages; batch n of the stream becomes version n + 1."""
    stream = messages.writeStream.foreachBatch(lambda batch, epoch: sync_batch(store, batch, epoch + 1, **options) and None).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="60 seconds")).start()
