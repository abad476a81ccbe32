"""Writes to the memory table as pure functions, the audit log beside it, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: What a bulk action sets; the value of each column as SQL.
ACTIONS = {"accept": {"status": "'active'"}, "reject": {"status": "'rejected'"}, "archive": {"status": "'archived'"}, "pin": {"pinned": "true"}, "unpin": {"pinned": "false"}}
#: Columns that a patch may set.
PATCHED = ("kind", "title", "content", "tags", "sensitivity", "status", "importance", "confidence", "pinned")


def secrecy(kind: Column, sensitivity: Column) -> Column:
    """A credential is always secret; what is not said is private."""
    return F.when(kind == "credential", "secret").otherwise(F.coalesce(sensitivity, F.lit("private")))


def content_hash(content: Column) -> Column:
    return F.sha2(F.trim(F.coalesce(content, F.lit(""))).cast("binary"), 256)


def prepared(new: DataFrame) -> DataFrame:
    """Rows to insert with defaults for what is null: kind fact, status active, importance and confidence 0.5, no tags."""
    defaults = {"kind": F.lit("fact"), "status": F.lit("active"), "importance": F.lit(0.5), "confidence": F.lit(0.5), "pinned": F.lit(False), "tags": F.array().cast("array<string>")}
    rows = new.withColumns({c: F.coalesce(c, d) if c in new.columns else d for c, d in defaults.items()})
    return rows.withColumns({"sensitivity": secrecy(F.col("kind"), F.col("sensitivity")), "content_hash": content_hash(F.col("content"))})


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and the prepared rows of new; an id that old has already is left as it is, one that new repeats comes in once (the row of the least hash)."""
    rows = prepared(new).join(old.select("id"), "id", "left_anti")
    nth = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64(*rows.columns)))
    rows = rows.withColumn("nth_of_id", nth).filter("nth_of_id = 1").drop("nth_of_id")
    return old.unionByName(rows, allowMissingColumns=True)


def update(old: DataFrame, patches: DataFrame) -> DataFrame:
    """old with patches (id and any of PATCHED, null: as it was) applied; the hash follows the content, secrecy the kind.

    Rows without a patch stay as they are. Of several patches of an id the highest version counts (a column `version`); where
    there is none, or it ties, patches that differ are refused with an error.
    """
    given = [c for c in PATCHED if c in patches.columns and c in old.columns]
    some = patches.select("id", *[F.col(c).alias(f"new_{c}") for c in given], (F.col("version") if "version" in patches.columns else F.lit(0)).alias("new_version")).distinct()
    some = some.withColumn("first", F.rank().over(W.partitionBy("id").orderBy(F.desc("new_version")))).filter("first = 1").drop("first")
    alike = F.count(F.lit(1)).over(W.partitionBy("id"))
    some = some.withColumn("patched", F.when(alike > 1, F.raise_error(F.concat(F.lit("patches of one id differ: "), F.col("id").cast("string"))).cast("boolean")).otherwise(True)).drop("new_version")
    rows = old.join(some, "id", "left").withColumn("patched", F.coalesce("patched", F.lit(False)))
    rows = rows.withColumns({c: F.coalesce(f"new_{c}", c) for c in given})
    follow = {"sensitivity": secrecy(F.col("kind"), F.col("sensitivity"))} | ({"content_hash": content_hash(F.col("content"))} if "content_hash" in old.columns else {})
    return rows.withColumns({c: F.when(F.col("patched"), value).otherwise(F.col(c)) for c, value in follow.items()}).select(*old.columns)


def remembered(tables: dict[str, DataFrame], new: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The change set of an insertion: memories, audit (id, action, at) and tags (tag, uses), of which one needs all.

    Only rows that come in are audited and counted; a tag is counted once for each of them.
    """
    memories = insert(tables["memories"], new)
    came = memories.join(tables["memories"].select("id"), "id", "left_anti")
    bumps = came.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))
    tags = tables["tags"].unionByName(bumps).groupBy("tag").agg(F.sum("uses").alias("uses"))
    return tables | {"memories": memories, "audit": audit(tables["audit"], came, "insert", at), "tags": tags}


def bulk(old: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """accept, reject, archive, pin or unpin of all rows whose id is in ids."""
    rows = old.join(ids.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
    for column, value in ACTIONS[action].items():
        rows = rows.withColumn(column, F.when(F.col("chosen"), F.expr(value)).otherwise(F.col(column)))
    return rows.select(*old.columns)


def audit(log: DataFrame, ids: DataFrame, action: str, at: Column) -> DataFrame:
    """log (id, action, at) with an entry for each id."""
    return log.unionByName(ids.select("id", F.lit(action).alias("action"), at.alias("at")))


def recent_audit(log: DataFrame, limit: int = 100) -> DataFrame:
    return log.orderBy(F.desc("at"), "id").limit(limit)


def merge_entities(entities: DataFrame, links: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Entities (entity, name, aliases, mentions) and links (memory, entity) after source has become target.

    The target keeps its name, gains the source's name and aliases, and its mentions are those of both; a memory linked to
    both keeps one link; the source is gone.
    """
    into = F.when(F.col("entity") == source, F.lit(target)).otherwise(F.col("entity")).cast(entities.schema["entity"].dataType)
    both = entities.withColumns({"own": F.col("entity") == target, "other": F.when(F.col("entity") == source, F.array_union(F.array("name"), "aliases")).otherwise(F.col("aliases")), "entity": into})
    merged = both.groupBy("entity").agg(F.max_by("name", "own").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("other")))).alias("aliases"), F.sum("mentions").alias("mentions"))
    return merged.withColumn("aliases", F.array_remove("aliases", F.col("name"))), links.withColumn("entity", F.when(F.col("entity") == source, F.lit(target)).otherwise(F.col("entity"))).distinct()


def add_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Document sources (id, path, name, watch): a path that is there already is not added again."""
    return old.unionByName(new.dropDuplicates(["path"]).join(old.select("path"), "path", "left_anti").select(*old.columns))


def relocate_source(old: DataFrame, source: int, path: str) -> DataFrame:
    """A source under another path, unless another source has that one."""
    taken = old.filter((F.col("path") == path) & (F.col("id") != source)).select(F.lit(True).alias("taken")).limit(1)
    rows = old.join(F.broadcast(taken), how="left")  # one row at most
    return rows.withColumn("path", F.when((F.col("id") == source) & F.col("taken").isNull(), F.lit(path)).otherwise(F.col("path"))).select(*old.columns)


def remove_source(tables: dict[str, DataFrame], source: int) -> dict[str, DataFrame]:
    """Sources, documents and chunks (doc) without a source and all below it."""
    gone = tables["documents"].filter(F.col("source") == source).select(F.col("id").alias("doc"))
    return {
        "sources": tables["sources"].filter(F.col("id") != source),
        "documents": tables["documents"].filter(F.col("source") != source),
        "chunks": tables["chunks"].join(gone, "doc", "left_anti"),
    }


def export_json(rows: DataFrame, path: str) -> None:
    """Hits, lists or edges as JSON lines in a folder."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_table(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A table as Parquet, in folders by some of its columns; it must not be read from the same path."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def processed(conversations: DataFrame) -> Column:
    """Whether a session needs no further look: processed, and not resumed since."""
    return F.col("processed").isNotNull() & (F.col("processed") >= F.col("ended"))


def at_or_below(tag: str):
    """A function of a tag: whether it is this one or below it."""
    return lambda x: (F.lower(x) == tag) | F.lower(x).startswith(f"{tag}/")


def candidates(
    memories: DataFrame, kinds: tuple = (), tags: tuple = (), projects: tuple = (), agents: tuple = (), since: str | None = None, until: str | None = None,
    secret: bool = False, pending: bool = False, archived: bool = False,
) -> DataFrame:
    """What recall may score: the conjunction of all that is asked for, so that it reaches the scan before any scoring."""
    statuses = ["active", *["pending"] * pending, *["archived"] * archived]
    tests = [F.col("status").isin(*statuses)] + [F.col(c).isin(*v) for c, v in (("kind", kinds), ("project", projects), ("agent", agents)) if v]
    if tags:
        tests.append(reduce(Column.__or__, [F.exists("tags", at_or_below(t.lower())) for t in tags]))
    tests += [F.col("created") >= F.lit(since).cast("timestamp_ntz")] if since else []
    tests += [F.col("created") <= F.lit(until).cast("timestamp_ntz")] if until else []
    tests += [] if secret else [F.col("sensitivity") != "secret"]
    return memories.filter(reduce(Column.__and__, tests))


def ordered_lookup(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows by id in the order asked for; unknown ids have none."""
    wanted = rows.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("place", "id"))
    return rows.join(F.broadcast(wanted.withColumn("id", F.col("id").cast("long"))), "id").orderBy("place")


def node_size(importance: Column, pinned: Column) -> Column:
    """Drawn size of a memory: its importance, more if pinned, within 0.2 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.2), importance + F.when(pinned, 0.15).otherwise(0.0)))


def clean_tags(tags: Column) -> Column:
    """Trimmed, lower-case tags, each once and in first-seen order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def prepare_text(text: Column, most: int | None = None) -> Column:
    """White space as one space, trimmed; cut where a most is given."""
    found = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.left(found, F.lit(most)) if most else found


def last_messages(turns: DataFrame, most: int = 3) -> DataFrame:
    """conv_id, turns: the numbers of the last few turns of each session, kept as a memory's provenance."""
    kept = F.slice(F.sort_array(F.collect_list("turn"), asc=False), 1, most)
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(kept), lambda t: t.cast("string")), ",").alias("turns"))


def dashboard(memories: DataFrame, day: str) -> DataFrame:
    """section, name, n: counts by kind, status, sensitivity, project and agent, the newest 8, 6 waiting, 24 tags, and a day's activity."""
    named = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("name")) for c in ("kind", "status", "sensitivity", "project", "agent")])
    of_day = F.when(F.col("created").cast("date") == F.lit(day).cast("date"), F.array(F.struct(F.lit("day").alias("section"), F.lit(day).alias("name"))))
    tagged = F.when(F.col("status") == "active", F.transform("tags", lambda t: F.struct(F.lit("tag").alias("section"), t.alias("name"))))
    nothing = F.array().cast("array<struct<section:string,name:string>>")
    # one pass gives every count: a row counts in each section that it belongs to
    counted = memories.select(F.explode(F.concat(named, F.coalesce(of_day, nothing), F.coalesce(tagged, nothing))).alias("s")).groupBy("s.section", "s.name").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "dashboard")
    none = memories.sparkSession.range(1).select(F.lit("day").alias("section"), F.lit(day).alias("name"), F.lit(0).cast("long").alias("n"))
    today = counted.filter("section = 'day'").unionByName(none).groupBy("section", "name").agg(F.max("n").alias("n"))
    parts = [counted.filter("section not in ('day', 'tag')"), today]
    title = [F.col("title").alias("name"), F.col("id").alias("n")]
    newest = memories.orderBy(F.desc("created"), "id")
    parts.append(newest.limit(8).select(F.lit("recent").alias("section"), *title))
    parts.append(memories.filter("status = 'pending'").orderBy(F.desc("created"), "id").limit(6).select(F.lit("pending").alias("section"), *title))
    parts.append(counted.filter("section = 'tag'").orderBy(F.desc("n"), "name").limit(24))
    return reduce(DataFrame.unionByName, parts)
