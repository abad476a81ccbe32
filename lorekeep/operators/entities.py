"""Entities: what memories name, with aliases resolved, and links from memories to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_key
from ..session import stored
from .components import components


def keyed(names: Column) -> Column:
    """Keys of an array of names, without those that have none."""
    return F.filter(F.transform(names, normalize_key), lambda k: k.isNotNull() & (k != ""))


def resolved(entities: DataFrame, named: DataFrame) -> DataFrame:
    """key, root: every key that stands together with another one as name or alias, with the smallest key of its group."""
    groups = [F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names")]
    keys = entities.select(*groups).union(named.select(*groups)).select(keyed(F.col("names")).alias("keys")).filter("size(keys) > 1").distinct()
    edges = keys.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b"))
    return components(edges.distinct()).select(F.col("node").alias("key"), "root")


def upsert(entities: DataFrame, links: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity, name, aliases, mentions) and links (memory, entity) after memories have named some more.

    named is memory, name, aliases: a row a mention. Names that have a key in common, directly or through further aliases,
    are one entity, whether old or new: components over the keys tell. It is the old entity with the smallest number, which
    keeps its name, or a new one numbered by a hash of its smallest key and called by its most frequent name (then the
    smallest). Aliases are all other names of the group, mentions add up (one a row), links of merged entities are pointed to
    the one that stays, and a memory keeps one link to it. Null and blank names are passed over, a null memory has no link.
    """
    named = named.select("memory", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).withColumn("key", normalize_key(F.col("name"))).filter("key <> ''")
    named = stored(named, "named-entities")
    roots = stored(resolved(entities, named), "entity-keys")
    rooted = lambda rows: rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).drop("key")
    old = rooted(entities.select("entity", "name", "aliases", "mentions", normalize_key(F.col("name")).alias("key")))
    new = rooted(named)
    number = F.min("entity")
    stays = old.groupBy("root").agg(number.alias("entity"), F.min_by("name", "entity").alias("name"), F.sum("mentions").alias("mentions"))
    counts = new.groupBy("root", "name").agg(F.count(F.lit(1)).alias("n"))
    fresh = counts.groupBy("root").agg(F.max("n").alias("most"), F.sum("n").alias("added")).join(counts, "root").filter("n = most").groupBy("root").agg(F.min("name").alias("called"), F.max("added").alias("added"))
    both = stays.join(fresh, "root", "full").select(
        "root", F.coalesce("entity", F.xxhash64("root")).alias("entity"), F.coalesce("name", "called").alias("name"), (F.coalesce("mentions", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("mentions")
    )
    both = stored(both, "entities")
    names = [rows.select("root", F.explode(F.concat(F.array("name"), "aliases")).alias("other")) for rows in (old.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), new)]
    aliases = reduce(DataFrame.union, names).filter("trim(other) <> ''").distinct().groupBy("root").agg(F.array_sort(F.collect_list("other")).alias("aliases"))
    result = both.join(aliases, "root", "left").select("entity", "name", F.array_remove(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")).alias("aliases"), "mentions")
    moved = old.select(F.col("entity").alias("was"), "root").join(both.select("root", "entity"), "root").select("was", "entity")
    kept = links.withColumnRenamed("entity", "was").join(moved, "was", "left").select("memory", F.coalesce("entity", "was").alias("entity"))
    brought = new.filter("memory is not null").select("memory", "root").join(both.select("root", "entity"), "root").select("memory", "entity")
    return result, kept.union(brought).distinct()
