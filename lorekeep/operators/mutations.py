"""Changes as pure functions: new tables from old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys; with a version column the highest wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc(version)] if version else []
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order, F.desc("_new")))
    return both.withColumn("_place", place).filter("_place = 1").drop("_new", "_place")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge a (source, target, kind): the largest weight, the newest reason that is not null; no self loops."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).filter("source <> target")
    reason = F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("_new")))
    return both.groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"), reason.alias("reason"))


def upsert_conversations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows: counts add up (a resumed session is read in increments), the latest end and any model stay."""
    both = old.unionByName(new)
    return both.groupBy("id").agg(F.sum("messages").alias("messages"), F.max("ended").alias("ended"), F.max_by("agent", "ended").alias("agent"))


def without_ids(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """A child table after its parents' deletion; gone has a column id."""
    return table.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def delete_memories(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Memories and what cascades from them: vectors, links, edges at either end."""
    return {
        "memories": without_ids(tables["memories"], "id", gone),
        "vectors": without_ids(tables["vectors"], "id", gone),
        "links": without_ids(tables["links"], "memory", gone),
        "edges": without_ids(without_ids(tables["edges"], "source", gone), "target", gone),
    }


def rename_tag(rows: DataFrame, old: str, new: str) -> DataFrame:
    renamed = F.transform("tags", lambda t: F.when(t == old, F.lit(new)).otherwise(t))
    return rows.withColumn("tags", F.array_distinct(renamed))


def merge_entities(links: DataFrame, source: int, target: int) -> DataFrame:
    """Links of source point to target; a memory linked to both keeps one."""
    return links.withColumn("entity", F.when(F.col("entity") == source, target).otherwise(F.col("entity"))).distinct()


def purge_expired(rows: DataFrame, before: str) -> DataFrame:
    """Drops rows that expired before a time, unless pinned."""
    return rows.filter(~((F.col("created") < F.lit(before).cast("timestamp_ntz")) & ~F.col("pinned")))


def count_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Counters from an append-only log (id, at)."""
    sums = events.groupBy("id").agg(F.count(F.lit(1)).alias("seen"), F.max("at").alias("last_seen"))
    return rows.join(sums, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


def lease(held: tuple[str, int] | None, owner: str, now_ms: int, ttl_ms: int) -> tuple[bool, tuple[str, int] | None]:
    """Acquires a free, own or expired lease (owner, expiry)."""
    if held is None or held[0] == owner or held[1] <= now_ms:
        return True, (owner, now_ms + ttl_ms)
    return False, held


def compare_index(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """key, state: new, changed, same or gone, by content hash (both: key, hash)."""
    both = current.select("key", F.col("hash").alias("now")).join(indexed.select("key", F.col("hash").alias("was")), "key", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("was"), "same").otherwise("changed")
    return both.select("key", state.alias("state"))
