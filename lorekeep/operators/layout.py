"""Snapshot selection, communities, labels and geometry over graphs of a stated node cap."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mutations import upsert

#: Nodes that a snapshot holds at most; what one group of the functions below can see.
MAX_NODES = 3000
NEIGHBOURHOOD = 40


def select_nodes(edges: DataFrame, nodes: DataFrame, most: int = MAX_NODES, focus: int | None = None) -> DataFrame:
    """node: a connected selection of at most `most` nodes (id, importance).

    The `most` most important nodes are the seeds; those with edges grow one after the other, by degree, each with its
    surroundings by breadth first (the strongest edges first) to NEIGHBOURHOOD nodes not chosen before, the focus before all;
    seeds fill what is left. Edges lead anywhere; nodes reached that `nodes` lacks are left out at the end.

    Only the growing is sequential, over at most `most` chosen nodes in the driver. It asks for the edges of those it
    comes by: what is not at hand yet is looked up over all edges, for all of a pass at once, and the pass is repeated
    until nothing is missing, so no edge is cut off.
    """
    spark = edges.sparkSession
    seeds = nodes.select("id", "importance").orderBy(F.desc("importance"), "id").limit(most).collect()
    if len(seeds) < most:
        return nodes.select(F.col("id").alias("node"))
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight").union(edges.select("target", "source", "weight"))
    roots = spark.createDataFrame([(r["id"],) for r in seeds], "node long")
    degree = {r["node"]: r["n"] for r in ends.join(F.broadcast(roots), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    hubs = sorted((r["id"] for r in seeds if r["id"] in degree), key=lambda n: -degree[n])
    order = ([focus] if focus is not None else []) + hubs
    known: dict[int, tuple[list[int], bool]] = {}

    def look_up(wanted: set[int], depth: int) -> None:
        """The first `depth` neighbours of these nodes, and whether those are all."""
        asked = spark.createDataFrame([(n,) for n in sorted(wanted)], "node long")
        around = ends.join(F.broadcast(asked), "node", "left_semi").filter("other <> node").groupBy("node", "other").agg(F.max("weight").alias("weight"))
        nth = F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "other"))
        lists = around.withColumn("nth", nth).filter(F.col("nth") <= depth).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "other"))).alias("found")).collect()
        known.update({n: ([], True) for n in wanted})
        known.update({r["node"]: ([x["other"] for x in r["found"]], len(r["found"]) < depth) for r in lists})

    def grow() -> tuple[dict[int, None], set[int]]:
        """The choice as far as the known edges go, and the nodes whose edges it lacks."""
        chosen: dict[int, None] = {}
        lacking: set[int] = set()
        for root in order:
            if root in chosen or len(chosen) >= most:
                continue
            chosen[root] = None
            queue, taken = deque([root]), 1
            while queue and taken < NEIGHBOURHOOD and len(chosen) < most:
                node = queue.popleft()
                found, whole = known.get(node, ([], False))
                for other in found:
                    if taken >= NEIGHBOURHOOD or len(chosen) >= most:
                        break
                    if other not in chosen:
                        chosen[other] = None
                        queue.append(other)
                        taken += 1
                else:
                    if not whole and taken < NEIGHBOURHOOD and len(chosen) < most:
                        lacking.add(node)
        return chosen, lacking

    chosen, lacking = grow()
    while lacking:
        new = {n for n in lacking if n not in known}
        if new:
            look_up(new, 2 * NEIGHBOURHOOD)
        for depth in {8 * len(known[n][0]) for n in lacking - new}:
            look_up({n for n in lacking - new if 8 * len(known[n][0]) == depth}, depth)
        chosen, lacking = grow()
    for r in seeds:
        if len(chosen) >= most:
            break
        chosen[r["id"]] = None
    found = spark.createDataFrame([(n,) for n in chosen], "node long")
    return found.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")


def snapshot(edges: DataFrame, nodes: DataFrame, most: int = MAX_NODES, focus: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selected nodes with their communities (node, community; alone where nothing links it), and the edges between them (the strongest of a pair)."""
    from .graph import strongest

    chosen = select_nodes(edges, nodes, most, focus)
    shown = chosen.select(F.col("node").alias("source")), chosen.select(F.col("node").alias("target"))
    among = strongest(edges.join(shown[0], "source", "left_semi").join(shown[1], "target", "left_semi")).select(F.col("a").alias("source"), F.col("b").alias("target"), "kind", "weight")
    members = chosen.join(louvain(among), "node", "left").withColumn("community", F.coalesce("community", "node"))
    return members, among


def louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, community (its smallest node) by the Louvain method, for a snapshot's edges (between at most MAX_NODES nodes).

    Larger graphs go through graph.label_propagation, which stays distributed.
    """

    def work(part: pd.DataFrame) -> pd.DataFrame:
        weights: dict[int, dict[int, float]] = defaultdict(dict)
        for a, b, w in part[["source", "target", "weight"]].sort_values(["source", "target"]).itertuples(index=False):
            weights[a][b] = weights[a].get(b, 0.0) + w
            weights[b][a] = weights[b].get(a, 0.0) + w
        member = {n: {n} for n in weights}
        total = sum(sum(x.values()) for x in weights.values())
        while True:
            label = {n: n for n in weights}
            strength = {n: sum(x.values()) for n, x in weights.items()}
            inside = dict(strength)
            moved_ever = moved = True
            moved_ever = False
            while moved:
                moved = False
                for n in sorted(weights):
                    links: dict[int, float] = defaultdict(float)
                    for o, w in weights[n].items():
                        if o != n:
                            links[label[o]] += w
                    inside[label[n]] -= strength[n]
                    gain = lambda c, n=n, links=links, inside=inside, strength=strength: links.get(c, 0.0) - resolution * strength[n] * inside.get(c, 0.0) / total
                    best = max([label[n], *links], key=lambda c: (round(gain(c), 12), c == label[n], -c))
                    inside[best] = inside.get(best, 0.0) + strength[n]
                    if best != label[n]:
                        label[n], moved, moved_ever = best, True, True
            if not moved_ever:
                break
            joined: dict[int, set] = defaultdict(set)
            for n, c in label.items():
                joined[c] |= member[n]
            merged: dict[int, dict[int, float]] = defaultdict(dict)
            for a, others in weights.items():
                for b, w in others.items():
                    x, y = label[a], label[b]
                    merged[x][y] = merged[x].get(y, 0.0) + w
            weights, member = merged, joined
        return pd.DataFrame([(n, min(group)) for group in member.values() for n in group], columns=["node", "community"])

    return edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(work, "node long, community long")


def label_clusters(members: DataFrame, tags: DataFrame) -> DataFrame:
    """community, size, label: the tag of most weight (a top-level tag counts 1, a full tag 0.5) if it covers 0.3 of the members; names used twice get a number, larger clusters first."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    used = members.join(tags.select(F.col("id").alias("node"), F.explode("tags").alias("tag")), "node")
    parts = F.array(F.struct(F.split("tag", "/")[0].alias("name"), F.lit(1.0).alias("w")), F.struct(F.col("tag").alias("name"), F.lit(0.5).alias("w")))
    weighed = used.select("community", "node", F.explode(parts).alias("p")).groupBy("community", "p.name").agg(F.sum("p.w").alias("w"), F.countDistinct("node").alias("covers"))
    top = weighed.join(sizes, "community").filter(F.col("covers") >= 0.3 * F.col("size"))
    named = sizes.join(top.groupBy("community").agg(F.max_by("name", F.struct("w", "name")).alias("name")), "community", "left").withColumn("name", F.coalesce("name", F.lit("misc")))
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.desc("size"), "community"))
    label = F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", F.col("nth").cast("string")))
    return named.withColumn("nth", nth).select("community", "size", label.alias("label"))


def hull(points: DataFrame) -> DataFrame:
    """cluster, place, x, y: the convex hull of each cluster's points (cluster, x, y), counter-clockwise from the leftmost."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(set(zip(part["x"], part["y"], strict=True)))

        def half(points: list) -> list:
            out: list = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        found = rows if len(rows) < 3 else half(rows)[:-1] + half(rows[::-1])[:-1]
        return pd.DataFrame({"cluster": part["cluster"].iloc[0], "place": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    # a hull of hulls is the hull: points are reduced in small groups first, so no task sees a whole large cluster
    salted = points.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    first = salted.groupBy("cluster", "salt").applyInPandas(lambda part: work(part), "cluster long, place int, x double, y double")
    return first.groupBy("cluster").applyInPandas(lambda part: work(part), "cluster long, place int, x double, y double")


def place_nodes(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """node, x, y: the saved place, else a spot on the golden spiral by rank."""
    rank = F.row_number().over(W.partitionBy(F.pmod("node", F.lit(64))).orderBy("node")) * 64 + F.pmod("node", F.lit(64))
    angle, radius = rank * 2.399963229728653, F.sqrt(rank.cast("double")) * 10
    spots = nodes.select("node", (F.cos(angle) * radius).alias("sx"), (F.sin(angle) * radius).alias("sy"))
    return spots.join(layout, "node", "left").select("node", F.coalesce("x", "sx").alias("x"), F.coalesce("y", "sy").alias("y"))


def reel_in(points: DataFrame, far: float = 2.4, to: float = 2.0) -> DataFrame:
    """Points (cluster, node, x, y) further than `far` medians from their cluster's centre move to `to` medians."""
    centre = points.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    rows = points.join(centre, "cluster").withColumn("d", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    order = W.partitionBy("cluster").orderBy("d", "node")
    held = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("held"))
    ranked = rows.select("cluster", "node", "d", F.row_number().over(order).alias("nth")).join(held, "cluster")
    middle = ranked.filter(F.col("nth") == F.floor(F.col("held") / 2) + 1).select("cluster", F.col("d").alias("median"))  # the upper one of two
    rows = rows.join(middle, "cluster")
    k = F.when((F.col("median") > 0) & (F.col("d") > far * F.col("median")), to * F.col("median") / F.col("d")).otherwise(1.0)
    return rows.select("cluster", "node", (F.col("cx") + (F.col("x") - F.col("cx")) * k).alias("x"), (F.col("cy") + (F.col("y") - F.col("cy")) * k).alias("y"))


def save_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Saved places (id, x, y) with new ones in their stead; a place that is no number changes nothing."""
    usable = new.filter(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select("id", "x", "y")
    return upsert(old, usable, ["id"])


def placed(nodes: DataFrame, saved: DataFrame) -> DataFrame:
    """nodes with the places that are saved for them, null where there are none."""
    return nodes.join(saved, "id", "left")


def clear_positions(saved: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Saved places without those of some ids, or without any."""
    return saved.limit(0) if gone is None else saved.join(gone.select("id"), "id", "left_anti")
