"""Edges from five sources, the budget of a node, neighbourhoods, communities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

if TYPE_CHECKING:
    import numpy as np

#: Vectors of one block of the blocked similarity join, if they have WIDTH values; a block of longer ones holds fewer.
BLOCK, WIDTH = 262_144, 64
#: Few vectors are cut into up to SPREAD blocks of LEAST, so that there are tasks enough.
SPREAD, LEAST = 8, 2048
#: Vectors of one side that are multiplied at a time with so many of the other, and pairs that are scored or sent on together.
SLICE, ACROSS, PAIRS = 256, 1 << 16, 1 << 16


def block_count(vectors: DataFrame) -> int:
    """In how many blocks vectors (embedding) are compared: a few, until memory asks for more."""
    n, values = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    return max(1, -(-n // BLOCK), -(-values // (BLOCK * WIDTH)), min(SPREAD, -(-n // LEAST)))


def plain_dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up in order in double: bit by bit what functions.vectors.dot gives."""
    import numpy as np

    products = np.ascontiguousarray((left.astype("f8") * right.astype("f8")).T)
    found = np.zeros(len(left))
    for x in products:
        found += x
    return found


def close_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in left (ascending from slice to slice), places in right, and the exact scores that reach the threshold.

    A matrix product of a slice of left and a stretch of right says which pairs may: it is in single precision where the vectors
    are, and everything within its largest possible error of the threshold is scored again in plain double arithmetic.
    """
    import numpy as np

    if not len(left) or not len(right):
        return
    longest = [float(np.sqrt(np.nansum(np.square(x.astype("f8")), axis=1).max())) for x in (left, right)]
    size = longest[0] * longest[1]
    if left.dtype != right.dtype or left.dtype != np.float32 or not size < 1e12:
        left, right = left.astype("f8"), right.astype("f8")
    least = threshold - (2 * left.shape[1] * float(np.finfo(left.dtype).eps) * size + 1e-12)
    for at, over in product(range(0, len(left), SLICE), range(0, len(right), ACROSS)):
        a, b = np.nonzero(left[at : at + SLICE] @ right[over : over + ACROSS].T >= least)
        a, b = a + at, b + over
        for i in range(0, len(a), PAIRS):
            one, two = a[i : i + PAIRS], b[i : i + PAIRS]
            score = plain_dots(left[one], right[two])
            good = score >= threshold
            yield one[good], two[good], score[good]


def nearest_of(rows: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of (source, target, score) the k best of each source: the largest scores, then the smallest targets."""
    import numpy as np

    source, target, score = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((target, -score, source))
    source = source[order]
    first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    nth = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source))))
    return source[nth < k], target[order][nth < k], score[order][nth < k]


def blocked_pairs(vectors: DataFrame, threshold: float, best: int | None = None, earlier: bool = False, within: str | None = None) -> DataFrame:
    """source, target, score (exact, at or above the threshold) of vectors, block against block.

    Vectors are dealt into a few blocks, and each pair of blocks is one group, so neither side is ever whole in one task and
    a vector travels once a block; scores are taken and checked where the vectors are. Without best: all pairs, source < target. With it:
    rows source, target in either order (earlier: only target < source), of which each pair of blocks keeps the best few of
    each source; the best few overall are among them. within: a column that both of a pair must share (nulls share nothing).
    """
    import numpy as np
    import pyarrow as pa

    ship(vectors.sparkSession)
    shared = [] if within is None else [F.col(within).alias("group")]
    vectors = vectors.filter(F.col("embedding").isNotNull() & (F.lit(True) if within is None else F.col(within).isNotNull()))
    blocks = block_count(vectors)
    dealt = vectors.select("id", "embedding", F.size("embedding").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), *shared)
    everyone = F.sequence(F.lit(0), F.lit(blocks - 1))
    pairs = F.transform(everyone, lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    rows = dealt.withColumn("p", F.explode(F.array_distinct(pairs))).select(*dealt.columns, "p.i", "p.j")

    def batch(source: np.ndarray, target: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(source), pa.array(target), pa.array(score)], ["source", "target", "score"])

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j, dims = (x.as_py() for x in key[:3])
        ids, vectors = numbers(batches, dims, i, j)
        same, held, size = i == j, [], 0
        for a, b, score in close_pairs(vectors[0], vectors[1], threshold):
            one, two = ids[0][a], ids[1][b]
            if best is None:
                keep = one < two if same else one != two
                if keep.any():
                    yield batch(np.minimum(one, two)[keep], np.maximum(one, two)[keep], score[keep])
                continue
            sides = [(one, two, score)] + [(two, one, score)] * (not same)
            sides = [tuple(x[s > t if earlier else s != t] for x in (s, t, v)) for s, t, v in sides]
            held += sides
            size += sum(len(s[0]) for s in sides)
            if size >= 16 * PAIRS + 2 * best * (len(ids[0]) + len(ids[1])):
                held = [nearest_of(held, best)]
                size = len(held[0][0])
        if size:
            found = nearest_of(held, best)
            for at in range(0, len(found[0]), PAIRS):
                yield batch(*(x[at : at + PAIRS] for x in found))

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("i", "j", "dims", *["group"] * len(shared)).applyInArrow(work, "source long, target long, score double")


def numbers(batches: Iterator, dims: int, i: int, j: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """ids and vectors (rows of a matrix) of the rows of block i and of block j; one and the same where i = j."""
    import numpy as np

    sides: dict[int, tuple[list, list]] = {i: ([], []), j: ([], [])}
    for part in batches:
        block = part.column("block").to_numpy()
        ids, flat = part.column("id").to_numpy(), part.column("embedding").flatten().to_numpy(zero_copy_only=False)
        flat = flat.reshape(len(ids), dims)
        for at, (some, vectors) in sides.items():
            some.append(ids[block == at])
            vectors.append(flat[block == at])
    joined = {at: tuple(np.concatenate(x) for x in side) for at, side in sides.items()}
    return [joined[i][0], joined[j][0]], [joined[i][1], joined[j][1]]


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """source < target and score of all pairs at or above the threshold; exact. Null vectors and those of unlike length have no score."""
    return blocked_pairs(vectors, threshold)


def knn(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k nearest others of every vector at or above the threshold, with their place; only the best of each pair of blocks are shuffled."""
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target"))
    return blocked_pairs(vectors, threshold, k).withColumn("place", place).filter(F.col("place") <= k)


#: Rows (a memory in an entity) whose pairs one task holds together.
LINKS = 250_000
#: Members of an entity that are listed together; those of a larger one meet in pairs of blocks of about so many.
MEMBERS = 2048
#: Candidate edges come from entities of up to so many mentions.
MOST = 30


def entity_lists(links: DataFrame, mentions: DataFrame, most: int | None = None, among: DataFrame | None = None, first: int | None = None) -> tuple[DataFrame, int]:
    """source, targets, mentions: memories of an entity, each with those after it (see entity_edges) or the first few of these; and in how many places their pairs fit.

    An entity of very many mentions is cut into blocks, and each pair of blocks is a group of its own, so no list is longer than
    some MEMBERS and a large entity spreads over many tasks. mentions are never fewer than an entity's memories.
    """
    few = mentions if most is None else mentions.filter(F.col("mentions") <= most)
    total, largest = few.agg(F.sum("mentions"), F.max("mentions")).first()
    if among is None:
        marked, whole, either = links, F.lit(True), F.lit(True)
    else:
        marked = links.join(among, "memory", "left")
        whole, either = F.col("changed").isNotNull(), F.coalesce("changed", F.lit(False))
    some = (lambda c: c) if first is None else lambda c: F.slice(c, 1, first)
    held = few if (largest or 0) <= MEMBERS else few.filter(F.col("mentions") <= MEMBERS)
    listed = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("memory"))))
    marks = [] if among is None else [listed(whole).alias("whole"), listed(either).alias("either")]
    groups = marked.join(held, "entity").groupBy("entity").agg(listed(F.lit(True)).alias("members"), *marks, F.max("mentions").alias("mentions"))
    each = groups.select(F.posexplode("members").alias("at", "source"), *groups.columns[1:])
    after = F.slice("members", F.col("at") + 2, F.size("members") if first is None else F.lit(first))
    if among is not None:
        after = F.when(F.array_contains("whole", F.col("source")), after).otherwise(some(F.filter("either", lambda m: m > F.col("source"))))
    lists = each.select("source", after.alias("targets"), "mentions")
    if held is not few:
        large = few.filter(F.col("mentions") > MEMBERS).withColumn("blocks", F.ceil(F.col("mentions") / MEMBERS).cast("int"))  # few: one in MEMBERS mentions at most
        rows = marked.join(F.broadcast(large), "entity").withColumn("block", F.pmod(F.xxhash64("memory"), "blocks").cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j")))
        member = F.struct("memory", whole.alias("whole"), either.alias("either"), "block").alias("member")
        rows = rows.withColumn("p", F.explode(F.array_distinct(pairs))).select("entity", "p.i", "p.j", member, "mentions")
        parts = rows.groupBy("entity", "i", "j").agg(F.sort_array(F.collect_set("member")).alias("members"), F.max("mentions").alias("mentions"))
        wanted = lambda m: (m["memory"] > F.col("m.memory")) & (F.col("m.whole") | m["either"]) & ((F.col("i") == F.col("j")) | (m["block"] != F.col("m.block")))
        each = parts.select(F.explode("members").alias("m"), "members", "mentions", "i", "j")
        lists = lists.unionByName(each.select(F.col("m.memory").alias("source"), F.transform(some(F.filter("members", wanted)), lambda m: m["memory"]).alias("targets"), "mentions"))
    return lists.filter(F.size("targets") > 0), max(1, -(-int(total or 0) // LINKS))


def entity_weight() -> Column:
    return F.least(F.lit(0.95), 1 / F.log2(F.col("mentions") + 2) + 0.3)


def entity_edges(links: DataFrame, mentions: DataFrame, most: int | None = MOST, among: DataFrame | None = None) -> DataFrame:
    """Memories that share an entity, with how many they share; entities of more than `most` mentions link nothing (None: all do).

    What travels is a row for each memory of an entity with the memories after it as a list; pairs are only made where the
    lists of a memory have met, and there are as many such places as the links need. among (memory, changed): only the pairs
    whose source is one of these memories or whose target is a changed one, made before anything travels.
    """
    lists, parts = entity_lists(links, mentions, most, among)
    pairs = lists.repartition(parts, "source").select("source", entity_weight().alias("weight"), F.explode("targets").alias("target"))
    return pairs.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("shared"))


def tag_edges(rows: DataFrame, low: int = 2, high: int = 25, peers: int = 5) -> DataFrame:
    """Active rows that share a tag of low..high uses (its uses below it counted as peers): the `peers` most important of each tag."""
    from ..functions.scalars import tag_ancestors

    active = rows.filter("status = 'active'")
    uses = active.select("id", F.explode("tags").alias("tag"))
    counts = uses.groupBy("tag").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses").between(low, high))
    total = active.agg(F.count(F.lit(1)).alias("total"))
    below = active.select("id", "importance", F.explode(F.array_distinct(F.flatten(F.transform("tags", tag_ancestors)))).alias("tag"))
    place = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("importance"), "id"))
    top = below.join(counts.select("tag"), "tag", "left_semi").withColumn("place", place).filter(F.col("place") <= peers).select("tag", F.col("id").alias("target"))
    idf = F.log(F.col("total") / F.col("uses")) / F.log(F.col("total").cast("double"))
    weighted = counts.join(F.broadcast(total)).select("tag", F.least(F.lit(0.45), 0.6 * idf).alias("weight"))
    pairs = uses.withColumnRenamed("id", "source").join(top, "tag").filter("source <> target").join(weighted, "tag")
    return pairs.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def session_edges(rows: DataFrame, peers: int = 10) -> DataFrame:
    """Active rows of one session, each with its first `peers` by id."""
    active = rows.filter("status = 'active'").select("id", "session")
    place = F.row_number().over(W.partitionBy("session").orderBy("id"))
    first = active.withColumn("place", place).filter(F.col("place") <= peers + 1).select("session", F.col("id").alias("target"))
    pairs = active.withColumnRenamed("id", "source").join(first, "session").filter("source <> target")
    nth = F.row_number().over(W.partitionBy("source").orderBy("target"))
    return pairs.withColumn("nth", nth).filter(F.col("nth") <= peers).select("source", "target", F.lit(0.45).alias("weight"))


def with_neighbours(rows: DataFrame, nearest: int, every: str) -> DataFrame:
    """rows (project, created, id, importance) dealt by project and stretch of time, and beside them those nearest to a stretch.

    A stretch gets the last rows before it and the first after it (mine: false), so that what is nearest in a project's order
    is always there, while no task holds more than a stretch. Only a few rows of each stretch take part in finding them.
    """
    own = rows.select("project", "created", "id", "importance", F.date_trunc(every, "created").alias("stretch"))
    inside = W.partitionBy("project", "stretch")
    ends = [
        own.withColumn("nth", F.row_number().over(inside.orderBy(*order))).filter(F.col("nth") <= nearest).withColumn("first", F.lit(first))
        for first, order in ((True, ("created", "id")), (False, (F.desc("created"), F.desc("id"))))
    ]
    row, first = F.struct("created", "id", "importance"), F.col("first")
    held = ends[0].unionByName(ends[1]).groupBy("project", "stretch").agg(
        F.sort_array(F.collect_list(F.when(first, row))).alias("firsts"), F.sort_array(F.collect_list(F.when(~first, row))).alias("lasts")
    )
    along = W.partitionBy("project").orderBy("stretch")
    nothing = F.filter("firsts", lambda x: F.lit(False))
    gathered = lambda at, c: F.sort_array(F.flatten(F.array(*[F.coalesce(at(c, i).over(along), nothing) for i in range(1, nearest + 1)])))
    before, after = gathered(F.lag, "lasts"), gathered(F.lead, "firsts")
    near = held.withColumns({"before": before, "after": after})
    near = near.withColumn("beside", F.concat(F.slice("before", F.greatest(F.size("before") - nearest + 1, F.lit(1)), F.lit(nearest)), F.slice("after", 1, nearest)))
    beside = near.select("project", "stretch", F.explode("beside").alias("b")).select("project", "b.created", "b.id", "b.importance", "stretch", F.lit(False).alias("mine"))
    return own.withColumn("mine", F.lit(True)).unionByName(beside)


def project_edges(rows: DataFrame, nearest: int = 3, every: str = "day") -> DataFrame:
    """The rows of the same project nearest in time, either way; only the neighbours in time order are looked at, stretch by stretch."""
    rows = with_neighbours(rows, nearest, every)
    order = W.partitionBy("project", "stretch").orderBy("created", "id")
    sides = [f(c, i).over(order).alias(f"{n}{c}{i}") for i in range(1, nearest + 1) for n, f in (("b", F.lag), ("a", F.lead)) for c in ("id", "created", "importance")]
    wide = rows.select(F.col("id").alias("source"), F.col("created").alias("at"), "mine", *sides).filter("mine")
    peers = F.array(*[F.struct(F.col(f"{n}id{i}").alias("target"), F.col(f"{n}created{i}").alias("peer_at"), F.col(f"{n}importance{i}").alias("importance")) for i in range(1, nearest + 1) for n in "ba"])
    rows = wide.select("source", "at", F.explode(peers).alias("p")).select("source", "at", "p.*").filter("target is not null")
    seconds = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("peer_at").cast("timestamp")))
    rows = rows.withColumn("apart", seconds)
    place = F.row_number().over(W.partitionBy("source").orderBy("apart", F.desc("importance"), "target"))
    days = F.col("apart") / 86_400_000_000.0
    weight = F.greatest(F.lit(0.16), 0.28 - F.least(days, F.lit(30.0)) * 0.004)
    return rows.withColumn("place", place).filter(F.col("place") <= nearest).select("source", "target", weight.alias("weight"))


def candidates(memories: DataFrame, vectors: DataFrame, links: DataFrame, mentions: DataFrame, threshold: float, neighbours: int = 6, first: int | None = None) -> DataFrame:
    """source, target, kind, weight from all five sources.

    first: for budgeted() with that budget. Of the memories after a source in an entity only the first so many travel, since
    entity edges of a source go by target: whichever precede an edge there take places before it. Rows lie by source then.
    """
    kinds = {
        "semantic": knn(vectors, neighbours, threshold).withColumnRenamed("score", "weight"), "entity": None,
        "tag": tag_edges(memories), "session": session_edges(memories), "project": project_edges(memories),
    }
    if first is None:
        kinds["entity"] = entity_edges(links, mentions)
        return reduce(DataFrame.unionByName, [df.select("source", "target", F.lit(kind).alias("kind"), "weight") for kind, df in kinds.items()])
    lists, parts = entity_lists(links, mentions, MOST, first=first)
    kinds["entity"] = lists.select("source", entity_weight().alias("weight"), F.col("targets").alias("target"))
    rows = [df.select("source", F.lit(kind).alias("kind"), "weight", "target" if kind == "entity" else F.array("target").alias("target")) for kind, df in kinds.items()]
    dealt = reduce(DataFrame.unionByName, rows).repartition(parts, "source")
    return dealt.select("source", F.explode("target").alias("target"), "kind", "weight").groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"))


PRIORITY = {"semantic": 100.0, "entity": 80.0, "tag": 40.0, "session": 30.0, "project": 20.0}


def budgeted(candidates: DataFrame, budget: int = 12) -> DataFrame:
    """Candidates (source, target, kind, weight) by priority: one edge an unordered pair of a node, then the first `budget` of the node.

    Both steps go by source alone, so the candidates are shuffled once, or not at all where they lie by source.
    """
    bonus = F.when(F.col("kind") == "semantic", F.col("weight") * 10).when(F.col("kind") == "tag", F.col("weight") * 5).otherwise(0.0)
    priority = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, p in PRIORITY.items()]) + bonus
    ranked = candidates.withColumn("priority", priority)
    ordered = [F.desc("priority"), F.col("kind"), F.col("target")]
    before = F.lag("target").over(W.partitionBy("source").orderBy("target", *ordered[:2]))
    single = ranked.withColumn("before", before).filter("before is null or before <> target")
    place = F.row_number().over(W.partitionBy("source").orderBy(*ordered))
    return single.withColumn("place", place).filter(F.col("place") <= budget).select("source", "target", "kind", "weight", "place")


def both_ways(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "kind", "weight")
    return ends.union(edges.select("target", "source", "kind", "weight"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def min_degree(edges: DataFrame, least: int) -> DataFrame:
    """Edges between nodes of at least that degree."""
    nodes = degree(edges).filter(F.col("degree") >= least).select("node")
    kept = edges.join(nodes, edges["source"] == nodes["node"], "left_semi")
    return kept.join(nodes, kept["target"] == nodes["node"], "left_semi")


def strongest(edges: DataFrame) -> DataFrame:
    """One edge an unordered pair."""
    pair = edges.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    return pair.groupBy("a", "b").agg(F.max_by("kind", F.struct("weight", "kind")).alias("kind"), F.max("weight").alias("weight"))


def khop(edges: DataFrame, start: int, hops: int = 2) -> DataFrame:
    """Nodes within so many hops, with their distance."""
    sides = both_ways(edges).select("node", "other").distinct()
    found = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        step = sides.join(found.select("node"), "node").select(F.col("other").alias("node"), F.lit(hop).alias("hops")).distinct()
        found = found.unionByName(step).groupBy("node").agg(F.min("hops").alias("hops"))
    return found


def entity_members(links: DataFrame, visible: DataFrame, least: int = 2) -> DataFrame:
    shown = links.join(visible.select(F.col("id").alias("memory")), "memory", "left_semi")
    return shown.groupBy("entity").agg(F.count(F.lit(1)).alias("members"), F.min("memory").alias("first"), F.max("memory").alias("last")).filter(F.col("members") >= least)


#: Nodes whose labels may be broadcast; those of more are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def label_propagation(edges: DataFrame, rounds: int = 5, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """node, community: each round every node takes its neighbours' heaviest label (ties: the smallest).

    The edges are dealt by node once, in an exchange that all rounds read again; only labels move between rounds, as a
    broadcast of at most broadcast_nodes rows. Beyond that many nodes the edges are joined by a shuffle in each round.
    """
    sides = both_ways(edges).select("node", "other", "weight")
    few = sides.select("node").distinct().count() <= broadcast_nodes
    sides = sides.repartition("node") if few else sides
    labels = None
    for _ in range(rounds):
        if labels is None:  # every node is its own label at first
            told = sides.withColumn("community", F.col("other"))
        else:
            now = labels.withColumnRenamed("node", "other")
            told = sides.join(F.broadcast(now) if few else now, "other")
        votes = told.groupBy("node", "community").agg(F.sum("weight").alias("w"))
        labels = votes.groupBy("node").agg(F.max_by("community", F.struct(F.round("w", 9), -F.col("community"))).alias("community"))
    return labels if labels is not None else sides.select("node").distinct().withColumn("community", F.col("node"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling."""
    a, b = labels.select(F.col("node").alias("source"), F.col("community").alias("ca")), labels.select(F.col("node").alias("target"), F.col("community").alias("cb"))
    inside = edges.join(a, "source").join(b, "target")
    total = inside.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("in_weight"))
    strength = degree(edges).join(labels, "node").groupBy("community").agg(F.sum("strength").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return total.join(strength).select((F.col("in_weight") / F.col("m") - F.col("ss") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
