"""Random-projection buckets against the exact join, and the upkeep of pairs and edges against full rebuilds."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import delta, extraction, graph, similarity
from lorekeep.plans import queries


def unit(v):
    return [float(x) for x in v / np.linalg.norm(v)]


def clustered(seed, n, dims=32, spread=0.5, each=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // each + 1, dims))
    return [unit(centres[i // each] + spread * rng.standard_normal(dims)) for i in range(n)]


def frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<double>")


@pytest.mark.parametrize(("threshold", "bits"), [(0.62, 4), (0.62, 7), (0.9, 8)])
def test_recall_and_growth(spark, threshold, bits):
    vectors = frame(spark, clustered(bits, 1500, spread=0.5 if threshold < 0.9 else 0.3))
    exact = {(r["source"], r["target"]): r["score"] for r in graph.similar_pairs(vectors, threshold).collect()}
    near = {(r["source"], r["target"]): r["score"] for r in similarity.near_pairs(vectors, threshold, bits=bits).collect()}
    assert len(exact) > 300 and near.items() <= exact.items() and len(near) >= 0.95 * len(exact)


def test_given_vectors(spark, sf):
    v = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    exact, near = graph.similar_pairs(v, 0.35), similarity.near_pairs(v, 0.35, bits=2)
    assert near.count() >= 0.95 * exact.count() > 0 and near.join(exact, ["source", "target"], "left_anti").isEmpty()


def test_plan_grows_less_than_the_square():
    assert similarity.plan(1000, 0.62, 0.97) == (0, 0) and similarity.plan(10**6, 0.1, 0.97) == (0, 0)
    share = []
    for n in (10**5, 10**6, 10**7, 10**8):
        bits, tables = similarity.plan(n, 0.62, 0.97)
        share.append(tables / 2**bits)
    assert share == sorted(share, reverse=True) and share[-1] < 0.02


def test_buckets_compare_less(spark):
    rng = np.random.default_rng(3)
    counts = []
    for n in (1000, 4000):
        v = frame(spark, [unit(x) for x in rng.standard_normal((n, 24))])
        bits = {1000: 4, 4000: 6}[n]
        counts.append(similarity.compared(v, bits, 10) / (n * (n - 1) / 2))
    assert counts[1] < 0.5 * counts[0]


def test_copies_nulls_and_unlike_lengths(spark):
    a, b = unit(np.array([1.0, 2, 3])), unit(np.array([1.0, 2, 3.1]))
    rows = [(i, a) for i in range(3000)] + [(3000, b), (3001, None), (3002, unit(np.ones(5))), (3003, unit(np.array([1, 1, 1, 1, 1.05])))]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert sorted((r["source"], r["target"]) for r in similarity.near_pairs(v, 0.9, bits=1).collect()) == [(0, 3000), (3002, 3003)]
    assert similarity.copies(v).filter("representative = 0").count() == 3000 and similarity.near_pairs(v.limit(0), 0.9).count() == 0


def world(rng, ids, spark):
    """Random memories, vectors, links and mentions of some ids."""
    made = lambda i, salt: random.Random(f"{i}-{salt}")
    memories = [(i, made(i, s).choice(["s1", "s2", "s3", None]), made(i, s).choice(["p1", "p2"]), made(i, s).randrange(900), made(i, s).random(), made(i, s).choice(["active", "active", "archived"]), made(i, s).sample(["x/a", "x/b", "y", "z/q/r"], 2)) for i, s in ids.items()]
    m = spark.createDataFrame(memories, "id long, session string, project string, at long, importance double, status string, tags array<string>")
    m = m.withColumn("created", F.timestamp_seconds(F.col("at") * 4000).cast("timestamp_ntz")).drop("at")
    v = spark.createDataFrame([(i, unit(np.array([made(i, f"v{s}").gauss(0, 1) for _ in range(4)]))) for i, s in ids.items() if i % 5], "id long, embedding array<double>")
    links = sorted({(i, made(i, f"l{s}{k}").randrange(12)) for i, s in ids.items() for k in range(2)})
    counts = Counter(e for _, e in links)
    return delta.State(m, v, spark.createDataFrame(links, "memory long, entity long"), spark.createDataFrame([(e, n * rng.choice([1, 1, 2])) for e, n in counts.items()], "entity long, mentions long"))


@pytest.mark.parametrize("seed", range(2))
def test_edges_after_any_change_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    old = {i: 0 for i in range(60)}
    new = {i: s for i, s in old.items() if rng.random() > 0.1} | {i: 1 for i in rng.sample(range(60), 8)} | {i: 0 for i in range(100, 106)}
    changed = [i for i in {*old, *new} if old.get(i) != new.get(i)]
    before, now = world(rng, old, spark), world(rng, new, spark)
    made = lambda s: graph.candidates(s.memories, s.vectors, s.links, s.mentions, 0.5, 3)
    edges, pairs = delta.refreshed(made(before), graph.similar_pairs(before.vectors, 0.5), before, now, spark.createDataFrame([(i,) for i in changed], "id long"), 0.5, 3)
    key = lambda df: Counter((r["source"], r["target"], r["kind"], round(r["weight"], 9)) for r in df.collect())
    assert key(edges) == key(made(now))
    assert Counter(map(tuple, pairs.select("source", "target").collect())) == Counter(map(tuple, graph.similar_pairs(now.vectors, 0.5).select("source", "target").collect()))


def test_blocks_grow_with_memory_only(spark, monkeypatch):
    """A vector travels once a block: 150,000 small vectors were cut into 74 blocks, so they travelled 74 times."""
    many = spark.range(150_000).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    assert graph.block_count(many) <= graph.SPREAD and graph.block_count(many.limit(0)) == 1
    monkeypatch.setattr(graph, "BLOCK", 50_000 // 64)
    assert graph.block_count(many) == -(-150_000 // (50_000 // 64))


def test_nearest_over_blocks_and_ties(spark, monkeypatch):
    """The k nearest by blocks are those of all pairs, copies in the order of their ids; and so are earlier twins of a label."""
    made = clustered(5, 200, dims=8) * 2
    v = spark.createDataFrame([(i, x, None if i % 7 == 0 else i % 2) for i, x in enumerate(made)], "id long, embedding array<float>, label int")
    pairs = [tuple(r) for r in graph.similar_pairs(v, 0.5).collect()]
    label = {r["id"]: r["label"] for r in v.collect()}
    around, twins = {}, {}
    for a, b, score in pairs:
        around.setdefault(a, []).append((-score, b))
        around.setdefault(b, []).append((-score, a))
        if label[a] is not None and label[a] == label[b]:
            twins.setdefault(b, []).append((-score, a))
    want = {(s, t, -score, i) for s, found in around.items() for i, (score, t) in enumerate(sorted(found)[:3], 1)}
    for name, value in (("LEAST", 60), ("SLICE", 16), ("PAIRS", 64)):
        monkeypatch.setattr(graph, name, value)
    assert graph.block_count(v) == 7
    assert {tuple(r) for r in graph.knn(v, 3, 0.5).select("source", "target", "score", "place").collect()} == want
    assert {tuple(r) for r in extraction.semantic_duplicates(v, 0.5).collect()} == {(i, min(found)[1], -min(found)[0]) for i, found in twins.items()}


def test_similar_near_finds_all(spark, sf, monkeypatch):
    """The query's SQL asks for every pair, however many vectors there are; plan() used to turn to buckets, which find a share."""
    asked = []
    plan = similarity.plan
    monkeypatch.setattr(similarity, "plan", lambda n, threshold, recall: asked.append((threshold, recall)) or plan(n, threshold, recall))
    assert queries.QUERIES["similar_near"](spark, sf).count() > 0
    assert [plan(10**6, *x) for x in asked] == [(0, 0)] and plan(10**6, 0.35, 0.97) != (0, 0)


def test_budget_ranks_rounded_weights(spark, sf, monkeypatch):
    """Weights that are equal to six digits are ties, which go by target, as in the SQL."""
    rows = spark.createDataFrame([(1, 9, "semantic", 0.5000004), (1, 3, "semantic", 0.5000001)], "source long, target long, kind string, weight double")
    monkeypatch.setattr(graph, "candidates", lambda *_: rows)
    assert sorted((r["place"], r["target"]) for r in queries.QUERIES["edges_budgeted_all"](spark, sf).collect()) == [(1, 3), (2, 9)]


def test_entity_edges_by_lists(spark, monkeypatch):
    """Pairs are made after the shuffle, in as many places as there are links: no exchange by (source, target)."""
    rng = random.Random(4)
    links = sorted({(rng.randrange(60), rng.randrange(25)) for _ in range(300)})
    counts = Counter(e for _, e in links)
    many = {e: n + e % 3 for e, n in counts.items()}
    want: dict = {}
    for a, e in links:
        for b, f in links:
            if a < b and e == f and many[e] <= 12:
                want.setdefault((a, b), []).append(min(0.95, 1 / np.log2(many[e] + 2) + 0.3))
    frames = spark.createDataFrame(links, "memory long, entity long"), spark.createDataFrame(list(many.items()), "entity long, mentions long")
    monkeypatch.setattr(graph, "LINKS", 20)
    found = graph.entity_edges(*frames, most=12)
    assert {(r["source"], r["target"]): (round(r["weight"], 9), r["shared"]) for r in found.collect()} == {k: (round(max(v), 9), len(v)) for k, v in want.items()}
    assert "hashpartitioning(source" in (plan := found._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(source#\d+L?, target", plan)


def test_label_propagation_deals_edges_once(spark):
    """Broadcast labels and joined ones agree, and with the former the edges are shuffled once for all rounds."""
    rng = random.Random(8)
    rows = sorted({(a, b, "x", rng.randrange(1, 9) / 8) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(220)) if a < b})
    edges = spark.createDataFrame(rows, "source long, target long, kind string, weight double")
    one, other = graph.label_propagation(edges), graph.label_propagation(edges, broadcast_nodes=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert not re.search(r"hashpartitioning\(other|hashpartitioning\(node#\d+L, community", one._jdf.queryExecution().executedPlan().toString())


def test_a_change_leaves_the_other_pairs_of_an_entity(spark):
    """only pairs with a changed end, or of an entity whose mentions changed, are made anew; every pair of every member of a changed memory's entities was."""
    memories = spark.createDataFrame([(i, f"s{i}", f"p{i}", 0.5, "active", ["x"]) for i in range(1, 8)], "id long, session string, project string, importance double, status string, tags array<string>").withColumn("created", F.expr("timestamp_ntz '2024-01-05'"))
    vectors = spark.createDataFrame([], "id long, embedding array<double>")
    links = [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (6, 3), (7, 3)]
    state = lambda rows, two: delta.State(memories, vectors, spark.createDataFrame(rows, "memory long, entity long"), spark.createDataFrame([(1, 3), (2, two), (3, 2)], "entity long, mentions long"))
    before, now = state([x for x in links if x != (2, 1)], 3), state(links, 4)
    edges = graph.candidates(before.memories, before.vectors, before.links, before.mentions, 0.5)
    marked = edges.withColumn("weight", F.when(F.col("kind") == "entity", -1.0).otherwise(F.col("weight")))
    found, _ = delta.refreshed(marked, graph.similar_pairs(vectors, 0.5), before, now, spark.createDataFrame([(2,)], "id long"), 0.5)
    made = {(r["source"], r["target"]): r["weight"] for r in found.filter("kind = 'entity'").collect()}
    whole = {(r["source"], r["target"]): r["weight"] for r in graph.entity_edges(now.links, now.mentions).collect()}
    assert set(made) == set(whole) == {(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (6, 7)}
    assert made == whole | {(1, 3): -1.0}


def test_a_block_is_multiplied_stretch_by_stretch(spark, monkeypatch):
    """F10-F15: 600,000 vectors travel to SPREAD blocks (they did to 10), since a block is no longer multiplied whole."""
    many = spark.range(600_000).select("id", F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"))
    assert graph.block_count(many) == graph.SPREAD
    rng = np.random.default_rng(3)
    left, right = (rng.standard_normal((n, 8)).astype("f4") for n in (40, 90))
    found = lambda: sorted((a, b, x) for part in graph.close_pairs(left, right, 0.5) for a, b, x in zip(*(p.tolist() for p in part), strict=True))
    whole = found()
    monkeypatch.setattr(graph, "SLICE", 7)
    monkeypatch.setattr(graph, "ACROSS", 11)
    assert whole and found() == whole


def test_entities_of_any_number_of_mentions_link(spark, sf, monkeypatch):
    """edges_entity links the members of every entity; those of more than 30 mentions were dropped. Large ones meet in pairs of blocks."""
    rng = random.Random(6)
    links = sorted({(rng.randrange(90), e) for e, n in ((0, 200), (1, 60), (2, 9), (3, 1)) for _ in range(n)})
    counts = Counter(e for _, e in links)
    want: dict = {}
    for a, e in links:
        for b, f in links:
            if a < b and e == f:
                want.setdefault((a, b), []).append(min(0.95, 1 / np.log2(counts[e] + 2) + 0.3))
    frames = spark.createDataFrame(links, "memory long, entity long"), spark.createDataFrame(list(counts.items()), "entity long, mentions long")
    for members in (graph.MEMBERS, 7):
        monkeypatch.setattr(graph, "MEMBERS", members)
        found = {(r["source"], r["target"]): (round(r["weight"], 9), r["shared"]) for r in graph.entity_edges(*frames, most=None).collect()}
        assert counts[0] > 30 and found == {k: (round(max(v), 9), len(v)) for k, v in want.items()}
    rows = spark.createDataFrame(links, "l_orderkey long, l_partkey long")
    monkeypatch.setattr(queries.Store, "table", lambda s, name: rows)
    assert queries.QUERIES["edges_entity"](spark, sf).count() == len(want) and " 30" not in queries.SQL["edges_entity"]


def test_lists_of_a_large_entity_are_short(spark, monkeypatch):
    """no group holds a large entity whole, so its pairs spread over tasks."""
    monkeypatch.setattr(graph, "MEMBERS", 10)
    links, mentions = spark.range(400).select(F.col("id").alias("memory"), F.lit(1).alias("entity")), spark.createDataFrame([(1, 400)], "entity int, mentions long")
    lists, _ = graph.entity_lists(links, mentions)
    assert lists.agg(F.max(F.size("targets"))).first()[0] < 40 and lists.agg(F.sum(F.size("targets"))).first()[0] == 400 * 399 // 2


def test_budget_over_first_partners(spark):
    """entity lists cut to the budget give the same edges, and the candidates are shuffled once, by source; all pairs were, twice."""
    rng = random.Random(9)
    ids = range(80)
    memories = spark.createDataFrame([(i, f"s{i % 9}", f"p{i % 2}", i / 80, "active", ["x", f"y/{i % 7}"]) for i in ids], "id long, session string, project string, importance double, status string, tags array<string>").withColumn("created", F.expr("timestamp_ntz '2024-01-05'"))
    vectors = spark.createDataFrame([(i, unit(np.array([rng.gauss(0, 1) for _ in range(3)]))) for i in ids], "id long, embedding array<double>")
    links = sorted({(rng.randrange(80), rng.randrange(12)) for _ in range(260)})
    frames = memories, vectors, spark.createDataFrame(links, "memory long, entity long"), spark.createDataFrame(list(Counter(e for _, e in links).items()), "entity long, mentions long")
    for budget in (2, 5, 12):
        some = graph.candidates(*frames, 0.8, 3, budget)
        key = lambda df: Counter((r["source"], r["target"], r["kind"], round(r["weight"], 9), r["place"]) for r in df.collect())
        got = graph.budgeted(some, budget)
        assert key(got) == key(graph.budgeted(graph.candidates(*frames, 0.8, 3), budget)) and (budget < 12 or any(k[2] == "entity" for k in key(got)))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan[: plan.index("REPARTITION_BY_NUM")].count("Exchange") == 1
    assert graph.candidates(*frames, 0.8, 3, 2).filter("kind = 'entity'").count() < graph.candidates(*frames, 0.8, 3).filter("kind = 'entity'").count()


@pytest.mark.parametrize("seed", range(3))
def test_nearest_after_any_change_without_pairs(spark, seed, monkeypatch):
    """the nearest are kept up from the lists before alone; all similar pairs, which grow with the square of the vectors, were kept and shuffled for it."""
    rng = random.Random(seed)
    at = lambda: unit(np.array([rng.gauss(0, 1) for _ in range(3)]))
    old = {i: at() for i in range(150)}
    new = {i: x if rng.random() > 0.15 else at() for i, x in old.items() if rng.random() > 0.1} | {i: at() for i in range(200, 212)}
    changed = [i for i in {*old, *new} if old.get(i) != new.get(i)] + [3]
    vectors = lambda some: spark.createDataFrame([*some.items(), (900, None)], "id long, embedding array<double>")
    monkeypatch.setattr(graph, "LEAST", 40)
    monkeypatch.setattr(similarity, "PAIRS", 32)
    best = lambda v: graph.knn(v, 4, (0.5, 0.9, 0.97)[seed]).select("source", "target", "score")
    found = similarity.refreshed_nearest(best(vectors(old)), vectors(new), spark.createDataFrame([(i,) for i in changed], "id long"), (0.5, 0.9, 0.97)[seed], 4)
    key = lambda df: Counter((r["source"], r["target"], round(r["score"], 9)) for r in df.collect())
    assert key(found) == key(best(vectors(new))) and key(found)
    before, now = world(rng, {i: 0 for i in range(50)}, spark), world(rng, {i: int(i < 5) for i in range(55)}, spark)
    made = lambda s: graph.candidates(s.memories, s.vectors, s.links, s.mentions, 0.5, 3)
    edges, pairs = delta.refreshed(made(before), None, before, now, spark.createDataFrame([(i,) for i in (*range(5), *range(50, 55))], "id long"), 0.5, 3)
    full = lambda df: Counter((r["source"], r["target"], r["kind"], round(r["weight"], 9)) for r in df.collect())
    assert pairs is None and full(edges) == full(made(now))
