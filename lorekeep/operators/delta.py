"""Edges after a change: only what the change touches is worked out again, with the result of a full rebuild."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .graph import entity_edges, project_edges, session_edges, tag_edges
from .similarity import refreshed_nearest, refreshed_pairs

#: Ids that are broadcast, at most; edges meet more of them in a join by a shuffle.
TOLD = 4_000_000


@dataclass(frozen=True)
class State:
    """What edges are made of: memories, vectors, links (memory, entity) and mentions (entity, mentions)."""

    memories: DataFrame
    vectors: DataFrame
    links: DataFrame
    mentions: DataFrame


def any_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """source, target, score: the k best of each id's pairs."""
    both = pairs.select("source", "target", "score").union(pairs.select("target", "source", "score"))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target"))
    return both.withColumn("place", place).filter(F.col("place") <= k).select("source", "target", "score")


def exchanged(edges: DataFrame, kind: str, sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """The edges of a kind with those of some sources (id) taken out and fresh ones of these put in."""
    ids = sources.select(F.col("id").alias("source"))
    kept = edges.filter(F.col("kind") == kind).join(ids, "source", "left_anti")
    fresh = fresh.join(ids, "source", "left_semi").select("source", "target", F.lit(kind).alias("kind"), "weight")
    return kept.select("source", "target", "kind", "weight").unionByName(fresh)


def told(ids: DataFrame) -> DataFrame:
    """Stored ids, broadcast if they are few, so that the edges stay where they are read."""
    return F.broadcast(ids) if ids.count() <= TOLD else ids


def ends(pairs: DataFrame) -> DataFrame:
    return any_of(pairs.select(F.col("source").alias("id")), pairs.select(F.col("target").alias("id")))


def refreshed(
    edges: DataFrame, pairs: DataFrame | None, before: State, now: State, changed: DataFrame, threshold: float, neighbours: int = 6
) -> tuple[DataFrame, DataFrame | None]:
    """The candidate edges (source, target, kind, weight) and similar pairs of `now`, from those of `before` and the ids that differ.

    Without pairs, which grow with the square of the vectors, the semantic edges are kept up from those before alone.

    changed has every id whose memory, vector or links came, went or changed; more ids do no harm. Worked out again are: the
    pairs of changed ids with all others, and the nearest of whoever has gained or lost a pair; sessions and projects that a
    changed memory is or was in; of the pairs that share an entity those with a changed end, and those whose first end is in
    an entity whose number of mentions changed. Tags are aggregated anew, since each weight depends on how many memories
    there are. Equal to graph.candidates on `now`.
    """
    ids = stored(changed.select("id").distinct(), "changed-ids")
    now_pairs, nearby = None, F.col("score").alias("weight")
    if pairs is None:
        was = edges.filter("kind = 'semantic'").select("source", "target", F.col("weight").alias("score"))
        parts = [refreshed_nearest(was, now.vectors, ids, threshold, neighbours).select("source", "target", F.lit("semantic").alias("kind"), nearby)]
    else:
        now_pairs = stored(refreshed_pairs(pairs, now.vectors, ids, threshold), "similar-pairs")
        touch = lambda p: p.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(p.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
        near = stored(any_of(ids, ends(touch(pairs.select("source", "target", "score"))), ends(touch(now_pairs))), "touched-vectors")
        around = now_pairs.join(near.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(now_pairs.join(near.withColumnRenamed("id", "target"), "target", "left_semi")).distinct()
        parts = [exchanged(edges, "semantic", near, nearest(around, neighbours).select("source", "target", nearby))]
    for kind, column, make in (("session", "session", session_edges), ("project", "project", project_edges)):
        groups = any_of(*[s.memories.join(ids, "id", "left_semi").select(column) for s in (before, now)]).withColumnRenamed(column, "group")
        members = [s.memories.join(groups, F.col(column).eqNullSafe(F.col("group")), "left_semi") for s in (before, now)]
        parts.append(exchanged(edges, kind, any_of(*[m.select("id") for m in members], ids), make(members[1])))
    counts = before.mentions.select("entity", F.col("mentions").alias("was")).join(now.mentions.select("entity", F.col("mentions").alias("is")), "entity", "full")
    weighed = told(stored(counts.filter("not (was <=> is)").select("entity"), "weighed-entities"))
    members = any_of(*[s.links.join(weighed, "entity", "left_semi").select(F.col("memory").alias("id")) for s in (before, now)], ids)
    members = stored(members.join(ids.withColumn("changed", F.lit(True)), "id", "left").select(F.col("id").alias("memory"), F.col("changed").isNotNull().alias("changed")), "touched-members")
    among = told(members)
    shared = now.links.join(now.links.join(among, "memory", "left_semi").select("entity").distinct(), "entity", "left_semi")
    kept = edges.filter("kind = 'entity'").join(told(members.select(F.col("memory").alias("source"))), "source", "left_anti").join(told(ids.withColumnRenamed("id", "target")), "target", "left_anti")
    parts.append(kept.select("source", "target", "kind", "weight"))
    parts.append(entity_edges(shared, now.mentions, among=among).select("source", "target", F.lit("entity").alias("kind"), "weight"))
    parts.append(tag_edges(now.memories).select("source", "target", F.lit("tag").alias("kind"), "weight"))
    return reduce(DataFrame.unionByName, parts), now_pairs
