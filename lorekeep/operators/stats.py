"""Statistics, tags and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import heat_level, tag_ancestors, week_start


def grouped(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts by a column, nulls dropped; the `top` largest if given."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top else counts


def ranged(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.min("created").alias("oldest"), F.max("created").alias("newest"))


def tag_usage(rows: DataFrame) -> DataFrame:
    """Tags of active rows."""
    return rows.filter("status = 'active'").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_ancestor_counts(rows: DataFrame) -> DataFrame:
    """Every tag and all tags above it, each counted once a row."""
    per_row = F.array_distinct(F.flatten(F.transform("tags", tag_ancestors)))
    return rows.filter("status = 'active'").select(F.explode(per_row).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def daily(rows: DataFrame, by: str = "kind") -> DataFrame:
    return rows.groupBy(F.to_date("created").alias("day"), by).agg(F.count(F.lit(1)).alias("n"))


def calendar(rows: DataFrame, last: str, days: int = 371) -> DataFrame:
    """Dense days up to `last` with counts (0 where nothing happened) and heat levels."""
    spark = rows.sparkSession
    end = F.to_date(F.lit(last))
    dense = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = rows.groupBy(F.to_date("created").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    filled = dense.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return filled.withColumn("level", heat_level(F.col("n")))


def weekly(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Weeks (from Monday, half open) with memories, their projects by count, and sessions; empty weeks do not appear."""
    per = rows.groupBy(week_start(F.col("created")).alias("week"), "project").agg(F.count(F.lit(1)).alias("n"))
    projects = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "project")))
    text = F.array_join(F.transform(projects, lambda x: F.concat(x["project"], F.lit(":"), (-x["m"]).cast("string"))), ",")
    weeks = per.groupBy("week").agg(F.sum("n").alias("memories"), text.alias("projects"))
    sessions = conversations.groupBy(week_start(F.col("started")).alias("week")).agg(F.count(F.lit(1)).alias("sessions"))
    both = weeks.join(sessions, "week", "full")
    return both.select("week", F.coalesce("memories", F.lit(0)).alias("memories"), F.coalesce("projects", F.lit("")).alias("projects"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


def digest(rows: DataFrame, since: str, titles: int = 8) -> DataFrame:
    """Active rows since a time, by project: counts, sessions and the newest titles."""
    window = rows.filter((F.col("status") == "active") & (F.col("created") >= F.lit(since).cast("timestamp_ntz")))
    place = F.row_number().over(W.partitionBy("project").orderBy(F.desc("importance"), "id"))
    top = window.withColumn("place", place).filter(F.col("place") <= titles)
    named = top.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), " | ").alias("titles"))
    counts = window.groupBy("project").agg(F.count(F.lit(1)).alias("memories"), F.countDistinct("session").alias("sessions"))
    return counts.join(named, "project")


def conversation_stats(conversations: DataFrame, least: int = 4) -> DataFrame:
    return conversations.groupBy("agent").agg(F.count(F.lit(1)).alias("conversations"), F.sum("messages").alias("messages"), F.count_if(F.col("messages") >= least).alias("long_enough"))


def rollup(turns: DataFrame) -> DataFrame:
    """A session from its turns: size, first user text (80 characters) as the title, last role, roles in order."""
    first_user = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.left(first_user, F.lit(80)).alias("title"), F.max_by("role", "turn").alias("last_role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"),
    )


def transcript(turns: DataFrame, total: int = 24_000, user: int = 4000, other: int = 800) -> DataFrame:
    """The newest turns of each session within a character budget; the first that does not fit ends it."""
    cut = turns.withColumn("cut", F.left("text", F.when(F.col("role") == "user", user).otherwise(other)))
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    running = cut.withColumn("used", F.sum(F.length("cut")).over(newest.rowsBetween(W.unboundedPreceding, 0)))
    return running.filter(F.col("used") <= total).select("conv_id", "turn", "role", F.length("cut").cast("long").alias("chars"), "used")


def coverage(groups: DataFrame, share: float = 0.55, most: int = 12, least: int = 3) -> DataFrame:
    """Largest groups (of `least` or more) until they cover the share of all members, at most `most`. The groups are one row a label."""
    total = groups.agg(F.sum("n").alias("total"))
    by_size = W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label")
    top = groups.filter(F.col("n") >= least).orderBy(F.desc("n"), "label").limit(most)
    ranked = top.withColumns({"place": F.row_number().over(by_size), "before": F.coalesce(F.sum("n").over(by_size.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    return ranked.join(F.broadcast(total)).filter(F.col("before") < share * F.col("total")).select("label", "n", "place")


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table; each is one count without reading a column."""
    found = None
    for name, table in tables.items():
        row = table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        found = row if found is None else found.unionByName(row)
    return found


def overview(memories: DataFrame, mentions: DataFrame, projects: int = 12, tags: int = 30, entities: int = 20) -> DataFrame:
    """section, name, n: kinds, top projects, tags and entities (of two mentions or more) in one table."""
    parts = {
        "kind": grouped(memories, "kind").select(F.col("kind").alias("name"), "n"),
        "project": grouped(memories, "project", projects).select(F.col("project").alias("name"), "n"),
        "tag": tag_usage(memories).orderBy(F.desc("n"), "tag").limit(tags).select(F.col("tag").alias("name"), "n"),
        "entity": mentions.filter("mentions >= 2").orderBy(F.desc("mentions"), "entity").limit(entities).select(F.col("entity").cast("string").alias("name"), F.col("mentions").alias("n")),
    }
    found = None
    for section, rows in parts.items():
        rows = rows.select(F.lit(section).alias("section"), "name", "n")
        found = rows if found is None else found.unionByName(rows)
    return found


def source_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """source with its documents and chunks (doc), zero where there is none."""
    per_doc = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"))
    both = documents.select("source", "id").join(per_doc, documents["id"] == per_doc["doc"], "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"))
