"""The store's facade: every question is a method that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import delta, documents, entities, extraction, filters, graph, layout, mutations, search, security, stats, writes
from .operators.filters import ListFilter
from .operators.postings import Postings
from .session import ship
from .streaming.sync import Versions, sync


class Engine:
    """Tables by name (memories, vectors, documents, chunks, links, mentions, turns, conversations, edges) and what can be asked of them.

    Methods never change a table; those that would return a store with the new tables instead. `scrubbed` outputs have secrets masked.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], now_ms: int, index: Postings | None = None):
        self.spark, self.tables, self.now_ms, self.index = ship(spark), tables, now_ms, index

    def changed(self, **tables: DataFrame) -> Engine:
        """The same store with some tables in place of what they were."""
        return Engine(self.spark, self.tables | tables, self.now_ms, self.index)

    def indexed(self, path: str, rows: DataFrame | None = None) -> Engine:
        """The store with a text index in a shared folder: an index that is there is used, else one is built over rows (documents)."""
        index = Postings(self.spark, path, ["title", "content"])
        if not index.segments():
            index.build(self.tables["documents"] if rows is None else rows)
        return Engine(self.spark, self.tables, self.now_ms, index)

    def recall(self, vec_id: int, text: str, limit: int = 8, **asked) -> DataFrame:
        """asked: kinds, tags, projects, agents, since, until, secret, pending, archived."""
        t = self.tables
        if not text.strip():
            return search.browse(writes.candidates(t["memories"], **asked), self.now_ms, limit)
        return search.recall(t["memories"], t["vectors"], self.index or t["documents"], t["edges"], vec_id, text, self.now_ms, limit, **asked)

    def remember(self, new: DataFrame, at: Column) -> Engine:
        """New memories with their audit entries and tag counts; ids that are there already change nothing."""
        return self.changed(**writes.remembered(self.logged(), new, at))

    def update(self, patches: DataFrame, at: Column) -> Engine:
        known = patches.join(self.tables["memories"].select("id"), "id", "left_semi").select("id").distinct()
        return self.changed(memories=writes.update(self.tables["memories"], patches), audit=writes.audit(self.logged()["audit"], known, "update", at))

    def act(self, ids: DataFrame, action: str, at: Column) -> Engine:
        """accept, reject, archive, pin or unpin, with audit entries for the ids that exist."""
        known = self.tables["memories"].join(ids.select("id").distinct(), "id", "left_semi").select("id")
        return self.changed(memories=writes.bulk(self.tables["memories"], ids, action), audit=writes.audit(self.logged()["audit"], known, action, at))

    def logged(self) -> dict[str, DataFrame]:
        """The tables with an audit log and tag counts, counted anew where there are none."""
        m = self.tables["memories"]
        log = m.limit(0).select("id", F.lit("").alias("action"), F.current_timestamp().alias("at"))
        return {"audit": log, "tags": m.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))} | self.tables

    def name_entities(self, named: DataFrame) -> Engine:
        """Entities and links after memories have named some (memory, name, aliases)."""
        found, links = entities.upsert(self.tables["entities"], self.tables["links"], named)
        return self.changed(entities=found, links=links, mentions=found.select("entity", "mentions"))

    def refresh_graph(self, before: Engine, pairs: DataFrame, changed: DataFrame, threshold: float = 0.62, neighbours: int = 6) -> tuple[DataFrame, DataFrame]:
        """Candidate edges and similar pairs after a change, from those of the store before it (tables candidates, and pairs)."""
        state = lambda t: delta.State(t["memories"], t["vectors"], t["links"], t["mentions"])
        return delta.refreshed(before.tables["candidates"], pairs, state(before.tables), state(self.tables), changed, threshold, neighbours)

    def sync(self, store: Versions, messages: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        """Follows a stream of messages into versions of a stored graph; see streaming.sync."""
        return sync(store, messages, checkpoint, **options)

    def similar(self, vec_id: int, limit: int = 8) -> DataFrame:
        v = self.tables["vectors"]
        return search.vector_topk(v, search.query_vector(v, vec_id), limit, exclude=vec_id)

    def related(self, vec_id: int, limit: int = 8) -> DataFrame:
        return search.related(self.tables["vectors"], self.tables["edges"], vec_id, limit)

    def search_documents(self, vec_id: int, text: str, limit: int = 5) -> DataFrame:
        return search.document_search(self.tables["documents"], self.tables["vectors"], vec_id, text, limit)

    def list(self, f: ListFilter = ListFilter()) -> DataFrame:
        return filters.listed(self.tables["memories"], f)

    def stats(self) -> dict[str, DataFrame]:
        m = self.tables["memories"]
        return {c: stats.grouped(m, c) for c in ("kind", "status", "sensitivity")} | {"project": stats.grouped(m, "project", 30), "agent": stats.grouped(m, "agent"), "range": stats.ranged(m), "tags": stats.tag_usage(m)}

    def digest(self, since: str) -> DataFrame:
        return stats.digest(self.tables["memories"], since)

    def timeline(self) -> DataFrame:
        return stats.weekly(self.tables["memories"], self.tables["conversations"])

    def activity(self, last: str, days: int = 371) -> DataFrame:
        return stats.calendar(self.tables["memories"], last, days)

    def capture(self, candidates: DataFrame, judge: bool = False) -> DataFrame:
        """candidates (content, best, force) with the admission verdict."""
        return candidates.withColumn("verdict", extraction.admit(F.col("content"), F.col("best"), F.col("force"), judge))

    def extract(self) -> DataFrame:
        return extraction.extract(self.tables["turns"])

    def forget(self, gone: DataFrame) -> dict[str, DataFrame]:
        return mutations.delete_memories(self.tables, gone)

    def chunk(self, size: int = documents.SIZE, overlap: int = documents.OVERLAP) -> DataFrame:
        return documents.chunk_documents(self.tables["documents"], size, overlap)

    def rebuild_graph(self, threshold: float = 0.62, neighbours: int = 6) -> DataFrame:
        """Candidate edges of all sources under the budget of a node."""
        t = self.tables
        return graph.budgeted(graph.candidates(t["memories"], t["vectors"], t["links"], t["mentions"], threshold, neighbours))

    def snapshot(self, most: int = layout.MAX_NODES, focus: int | None = None) -> dict[str, DataFrame]:
        """nodes with their communities, edges between them (the strongest of a pair) and labelled clusters."""
        t = self.tables
        nodes, edges = layout.snapshot(t["edges"], t["memories"].filter("status = 'active'").select("id", "importance"), most, focus)
        return {"nodes": nodes, "edges": edges, "clusters": layout.label_clusters(nodes, t["memories"])}

    def scrubbed(self, rows: DataFrame) -> DataFrame:
        return security.scrub(rows)
