"""Full text by BM25 over phrases, vector search, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import logistic_rank, recency, reciprocal_rank, weight_importance
from ..functions.vectors import dot
from ..session import stored
from .postings import Postings
from .writes import candidates


def phrases(query: str) -> list[str]:
    """Quoted terms of a memory query; those under three characters never match a trigram index."""
    terms = [t.translate(str.maketrans("", "", '"*')) for t in query.split()]
    return [t.lower() for t in terms if len(t) >= 3]


def occurrences(column: str, phrase: str) -> Column:
    """How often the phrase occurs, overlaps included."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    if any(phrase.endswith(phrase[:n]) for n in range(1, len(phrase))):  # it can overlap itself: count its starts
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - len(phrase) + 1, F.lit(1)))
        return F.size(F.filter(starts, lambda i: F.substring(low, i, F.lit(len(phrase))) == phrase))
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def bm25(rows: DataFrame, terms: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """keep and rank (negative is better) of the rows in which a phrase occurs.

    Texts are read once: the counts of every row (no text) are stored, and the corpus statistics and the hits come from
    that table. Postings.bm25 finds the same ranks without reading texts at all.
    """
    length = reduce(lambda a, b: a + b, [F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)) for c in columns])
    tf = [reduce(lambda a, b: a + b, [occurrences(c, t) for c in columns]).alias(f"f{i}") for i, t in enumerate(terms)]
    if not terms:
        return rows.select(*keep, F.lit(0.0).alias("rank")).limit(0)
    counted = stored(rows.select(*keep, length.alias("len"), *tf), "phrase-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    joined = counted.filter(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))
    rank = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f{i}").cast("double")
        rank = rank - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    return joined.select(*keep, rank.alias("rank"))


def memory_text_search(rows: DataFrame | Postings, query: str, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """Best rows by BM25 over title and content, with the logistic score; rows is a table or its index, allowed the ids that count."""
    hits = rows.bm25(phrases(query)) if isinstance(rows, Postings) else bm25(rows, phrases(query), ["title", "content"], ["id"])
    hits = hits if allowed is None else hits.join(allowed.select("id"), "id", "left_semi")
    return hits.withColumn("score", logistic_rank(F.col("rank"))).orderBy("rank", "id").limit(limit)


def chunk_text_search(rows: DataFrame, query: str, limit: int = 20, sources: tuple[str, ...] = ()) -> DataFrame:
    """The whole query as one phrase over the scoped chunks' heading (title) and content, with the reciprocal score."""
    phrase = query.replace('"', "").strip().lower()
    hits = bm25(rows, [phrase] if len(phrase) >= 2 else [], ["title", "content"], ["id", "source"])
    if sources:
        hits = hits.filter(F.col("source").isin(*sources))
    return hits.withColumn("score", reciprocal_rank(F.col("rank"))).orderBy("rank", "id").limit(limit)


def query_vector(vectors: DataFrame, vec_id: int) -> DataFrame:
    return vectors.filter(F.col("id") == vec_id).select(F.col("embedding").alias("query")).limit(1)


def vector_topk(vectors: DataFrame, query: DataFrame, limit: int, exclude: int | None = None) -> DataFrame:
    """Exact top-k against one query vector; a row of another dimension has no score. The query is one row."""
    rows = vectors if exclude is None else vectors.filter(F.col("id") != exclude)
    same = F.size("embedding") == F.size("query")
    scored = rows.join(F.broadcast(query)).filter(same).select("id", dot("embedding", "query").alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def hybrid(channels: DataFrame, memories: DataFrame, edges: DataFrame, allowed: DataFrame, now_ms: int, limit: int = 8, graph: bool = True) -> DataFrame:
    """Fuses channel scores (id, vector, keyword; already weighted) with the graph channel, importance and recency.

    Seeds are the five best by channel score; each brings its six heaviest neighbours at half their weight. A
    neighbour that a channel has found already, is not allowed, or scores under 0.08 is left out, and the first seed
    that brings one wins.
    """
    merged = channels.groupBy("id").agg(F.max("vector").alias("vector"), F.max("keyword").alias("keyword"))
    merged = merged.withColumn("channel", F.coalesce("vector", F.lit(0.0)) + F.coalesce("keyword", F.lit(0.0)))
    found = merged.select("id", "vector", "keyword", F.lit(None).cast("double").alias("graph"), "channel", F.lit(None).cast("long").alias("via"))
    if graph:
        seeds = merged.orderBy(F.desc("channel"), "id").limit(5)
        one = W.partitionBy(F.lit(0)).orderBy(F.desc("channel"), "id")  # of five rows
        seeds = seeds.select(F.col("id").alias("seed"), F.col("channel").alias("seed_score"), F.row_number().over(one).alias("seed_place"))
        both = edges.select(F.col("source").alias("seed"), F.col("target").alias("id"), "weight").unionByName(edges.select(F.col("target").alias("seed"), F.col("source").alias("id"), "weight"))
        near = both.join(F.broadcast(seeds), "seed")
        near = near.withColumn("nth", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("weight"), "id"))).filter("nth <= 6")
        near = near.withColumn("graph", F.col("seed_score") * F.col("weight") * 0.5).filter("graph >= 0.08")
        near = near.join(allowed.select("id"), "id", "left_semi").join(merged.select("id"), "id", "left_anti")
        first = W.partitionBy("id").orderBy("seed_place", F.desc("weight"))
        near = near.withColumn("first", F.row_number().over(first)).filter("first = 1")
        empty = F.lit(None).cast("double")
        found = found.unionByName(near.select("id", empty.alias("vector"), empty.alias("keyword"), "graph", F.col("graph").alias("channel"), F.col("seed").alias("via")))
    rows = found.join(memories, "id")
    total = F.col("channel") + weight_importance(F.col("importance"), F.col("pinned")) + recency(F.col("created"), now_ms)
    return rows.withColumn("score", total).orderBy(F.desc("score"), "id").limit(limit).select("id", "score", "vector", "keyword", "graph", "via")


def recall(
    memories: DataFrame, vectors: DataFrame, texts: DataFrame | Postings, edges: DataFrame, vec_id: int, text: str, now_ms: int, limit: int = 8, graph: bool = True, **asked
) -> DataFrame:
    """Hybrid recall: candidates first, then vector (0.6) and text (0.4) channels, then fusion.

    asked are the filters of writes.candidates (kinds, tags, projects, agents, since, until, secret, pending, archived). texts
    is a table or its index. Without filters the text channel's pool is cut before the candidates are kept, as it always was;
    with filters only candidates enter the pool.
    """
    allowed = candidates(memories, **asked).select("id", "importance", "pinned", "created")
    pool = max(4 * limit, 40)
    mine = vectors.join(allowed.select("id"), "id", "left_semi")
    by_vector = vector_topk(mine, query_vector(vectors, vec_id), pool).select("id", (F.col("score") * 0.6).alias("vector"), F.lit(None).cast("double").alias("keyword"))
    by_text = memory_text_search(texts, text, pool, allowed if asked else None).join(allowed.select("id"), "id", "left_semi")
    by_text = by_text.select("id", F.lit(None).cast("double").alias("vector"), (F.col("score") * 0.4).alias("keyword"))
    return hybrid(by_vector.unionByName(by_text), allowed, edges, allowed, now_ms, limit, graph)


def channel_counts(hits: DataFrame) -> DataFrame:
    """One row: how many hits each channel has part in."""
    return hits.agg(*[F.count(c).alias(f"n_{c}") for c in ("vector", "keyword", "graph")], F.count(F.lit(1)).alias("n_hits"))


def palette(hits: DataFrame, documents: DataFrame, memories: int = 6, docs: int = 4) -> DataFrame:
    """kind, id, score: the best memories of a recall and the best documents of a search."""
    best = lambda rows, kind, n: rows.orderBy(F.desc("score"), "id").limit(n).select(F.lit(kind).alias("kind"), "id", "score")
    return best(hits, "memory", memories).unionByName(best(documents, "document", docs))


def browse(memories: DataFrame, now_ms: int, limit: int = 8) -> DataFrame:
    """Recall without a text: by importance, base score 0.5."""
    rows = memories.filter("status = 'active' and sensitivity <> 'secret'")
    total = 0.5 + weight_importance(F.col("importance"), F.col("pinned")) + recency(F.col("created"), now_ms)
    top = rows.orderBy(F.desc("pinned"), F.desc("importance"), F.desc("created"), "id").limit(limit)
    return top.select("id", total.alias("score"))


def neighbours(chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Each chunk (doc, ord, content) with those around it, in order."""
    around = W.partitionBy("doc").orderBy("ord").rowsBetween(-radius, radius)
    return chunks.select("doc", "ord", F.array_join(F.collect_list("content").over(around), "\n\n").alias("wide"))


def document_search(chunks: DataFrame, vectors: DataFrame, vec_id: int, text: str, limit: int = 8) -> DataFrame:
    """Vector (0.6) and phrase (0.4) channels over chunks, the sum halved."""
    pool = max(4 * limit, 32)
    none = F.lit(None).cast("double")
    by_vector = vector_topk(vectors, query_vector(vectors, vec_id), pool).select("id", (F.col("score") * 0.6).alias("vector"), none.alias("keyword"))
    by_text = chunk_text_search(chunks, text, pool).select("id", none.alias("vector"), (F.col("score") * 0.4).alias("keyword"))
    merged = by_vector.unionByName(by_text).groupBy("id").agg(F.max("vector").alias("vector"), F.max("keyword").alias("keyword"))
    total = (F.coalesce("vector", F.lit(0.0)) + F.coalesce("keyword", F.lit(0.0))) * 0.5
    hits = merged.withColumn("score", total).join(chunks.select("id", "title", "source"), "id")
    return hits.orderBy(F.desc("score"), "id").limit(limit).select("id", "title", "source", "score", "vector", "keyword")


def related(vectors: DataFrame, edges: DataFrame, vec_id: int, limit: int = 8) -> DataFrame:
    """Similar vectors, and graph neighbours that are not among them."""
    similar = vector_topk(vectors, query_vector(vectors, vec_id), limit, exclude=vec_id).select("id", "score", F.lit("similar").alias("reason"))
    both = edges.filter(F.col("source") == vec_id).select(F.col("target").alias("id"), "weight", "kind").union(edges.filter(F.col("target") == vec_id).select("source", "weight", "kind"))
    linked = both.groupBy("id").agg(F.max_by("kind", F.struct("weight", "kind")).alias("reason"), F.max("weight").alias("score"))
    linked = linked.join(similar.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(12)
    return similar.unionByName(linked.select("id", "score", "reason"))


def node_search(rows: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Text search for graph nodes: three times the limit as a pool, title matches first, the rest in rank order."""
    pool = memory_text_search(rows, text, 3 * limit).join(rows.select("id", "title"), "id")
    in_title = reduce(lambda a, b: a | b, [F.contains(F.lower("title"), F.lit(t)) for t in phrases(text)], F.lit(False))
    return pool.withColumn("in_title", in_title).orderBy(F.desc("in_title"), "rank", "id").limit(limit).select("id", "title", "in_title", "rank")


def label_search(rows: DataFrame, text: str, chosen: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """Distinct labels that contain a text, case folded, without those already chosen."""
    hits = rows.select("label").distinct().filter(F.contains(F.lower("label"), F.lit(text.lower())))
    return (hits.filter(~F.col("label").isin(*chosen)) if chosen else hits).orderBy("label").limit(limit)


def detail(edges: DataFrame, memories: DataFrame, node: int, limit: int = 12) -> DataFrame:
    """The heaviest neighbours of a memory with kind, weight and title."""
    ends = edges.filter(F.col("source") == node).select(F.col("target").alias("id"), "kind", "weight").unionByName(edges.filter(F.col("target") == node).select(F.col("source").alias("id"), "kind", "weight"))
    top = ends.orderBy(F.desc("weight"), "id", "kind").limit(limit)
    return top.join(memories.select("id", "title"), "id")
