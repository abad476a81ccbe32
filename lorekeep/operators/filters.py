"""Listing: composed predicates, orders, limits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = {
    "updated": ["created"],
    "created": ["created"],
    "importance": ["pinned", "importance", "created"],
    "access": ["access_count", "created"],
}


@dataclass(frozen=True)
class ListFilter:
    """Conjunction of optional predicates; status defaults to active."""

    kinds: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ("active",)
    sensitivities: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    agents: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    tag_mode: str = "any"
    since: str | None = None
    until: str | None = None
    pinned: bool | None = None
    order: str = "updated"
    limit: int | None = 50
    offset: int = 0


def has_tag(tag: str, tags: str = "tags") -> Column:
    """Hierarchical membership: the tag itself or one below it, ASCII case ignored."""
    low = tag.lower()
    return F.exists(tags, lambda x: (F.lower(x) == low) | F.startswith(F.lower(x), F.lit(low + "/")))


def predicate(f: ListFilter) -> Column:
    found = [F.lit(True)]
    for column, values in (("kind", f.kinds), ("status", f.statuses), ("sensitivity", f.sensitivities), ("project", f.projects), ("agent", f.agents)):
        if values:
            found.append(F.col(column).isin(*values))
    if f.tags:
        found.append(reduce(and_ if f.tag_mode == "all" else or_, map(has_tag, f.tags)))
    if f.since:
        found.append(F.col("created") >= F.lit(f.since).cast("timestamp_ntz"))
    if f.until:
        found.append(F.col("created") <= F.lit(f.until).cast("timestamp_ntz"))
    if f.pinned is not None:
        found.append(F.col("pinned") == f.pinned)
    return reduce(and_, found)


def listed(memories: DataFrame, f: ListFilter = ListFilter()) -> DataFrame:
    """The filtered page in its order; ties go to the smaller id."""
    rows = memories.filter(predicate(f)).orderBy(*[F.desc(c) for c in ORDERS[f.order]], "id")
    if f.offset:
        rows = rows.offset(f.offset)
    return rows.limit(f.limit) if f.limit is not None else rows


def counted(memories: DataFrame, f: ListFilter = ListFilter()) -> DataFrame:
    return memories.filter(predicate(f)).agg(F.count(F.lit(1)).alias("n"))


def like_terms(query: str) -> list[str]:
    return [t for t in (w.translate(str.maketrans("", "", "%_\\")) for w in query.split()) if t]


def like_search(rows: DataFrame, query: str, limit: int = 20, secret: Column | None = None) -> DataFrame:
    """Fallback for queries of short terms: any term in the title or (unless secret) the content; title hits score 0.72, others 0.5."""
    terms = [t.lower() for t in like_terms(query)]
    title = reduce(or_, [F.contains(F.lower("title"), F.lit(t)) for t in terms], F.lit(False))
    body = reduce(or_, [F.contains(F.lower("content"), F.lit(t)) for t in terms], F.lit(False)) & (F.lit(True) if secret is None else ~secret)
    hits = rows.filter(title | body).withColumn("score", F.when(title, 0.72).otherwise(0.5))
    return hits.orderBy(F.desc("confidence"), "id").limit(limit)


def by_suffix(rows: DataFrame, suffix: str) -> DataFrame:
    """Rows whose id ends with the suffix, two at most: a caller needs exactly one."""
    return rows.filter(F.endswith(F.col("id").cast("string"), F.lit(suffix))).orderBy("id").limit(2)
