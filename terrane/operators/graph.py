"""Graph operators as bounded loops of joins and sums; every round is written, so lineage stays short and executors may go."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import discard, staged


#: Layers of improvements that a search keeps apart.
MERGE = 8
#: Edges whose components one task finds by itself; more take rounds of joins.
ALONE = 1 << 20


def forest(edges: DataFrame, most: int = 1 << 20, by: str = "b") -> DataFrame:
    """Edges (a, b) that connect the same nodes as the given ones: of each partition only those that join two of its components.

    Rows meet by b, or by another column that brings near nodes together, and AQE splits a partition that is too large, as any split is right. A task forgets its components
    at `most` nodes, which bounds its memory and costs only rows. Empty edges give an empty result.
    """

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                if (x := find(a)) != (y := find(b)):
                    root[x] = y
                    kept.append((a, b))
                if len(root) > most:
                    root.clear()
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return edges.select("a", "b", F.col(by).alias("by")).hint("rebalance", F.col("by")).select("a", "b").mapInPandas(run, "a long, b long")


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of undirected edges, ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up


def components(edges: DataFrame, label: str = "components", alone: int = ALONE) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs, as (node, root), root being the least node.

    Up to `alone` distinct edges are united by one task, which that bounds. More take alternating large-star and
    small-star rounds: every round is joins and sums over the edges, never a group in one task, and every round's edges
    are written to the shared folder. Nodes without an edge, or only with themselves, are not returned; empty edges give
    an empty result.
    """

    def whole(batches):
        got = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
        if got:
            node, root = united(*(np.concatenate(side) for side in zip(*got)))
            yield pd.DataFrame({"node": node, "root": root})

    def rounds(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def put(e: DataFrame) -> tuple[DataFrame, tuple]:
        """e staged, and its number of rows and sum of hashes, counted while it is written."""
        seen = Observation()
        out = staged(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), label)
        return out, (seen.get["n"], seen.get["h"])

    now, before = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    if before[0] <= alone:
        out = staged(now.coalesce(1).mapInPandas(whole, "node long, root long"), label)
        discard(now)
        return out
    while before[0]:
        old = now
        now, after = put(rounds(old))
        discard(old)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.join(now.select(F.col("a").alias("node")), "node", "left_anti"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): all that directed edges (src, dst) reach from the start nodes, those included."""
    frontier = staged(start.select("node").distinct(), "reach")
    layers = [frontier]
    while True:
        step = edges.join(frontier, edges.src == frontier.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        seen, known = Observation(), reduce(DataFrame.unionByName, layers)
        frontier = staged(step.join(known, "node", "left_anti").observe(seen, F.count("*").alias("n")), "reach")
        if not seen.get["n"]:
            return known
        layers.append(frontier)
        if len(layers) >= MERGE:
            merged = staged(reduce(DataFrame.unionByName, layers), "reach")
            discard(*layers[:-1])
            layers = [merged]


def shortest(edges: DataFrame, seeds: DataFrame, most: float | None = None) -> DataFrame:
    """(node, dist, origin, parent): the least cost, up to most if that is given, from any seed (node, dist, origin) over directed edges (src, dst, weight).

    Rounds relax from the nodes that improved last; ties go to the least origin, then the least parent. A round writes
    only what improved. The layers are merged once there are MERGE of them, so that no round reads many tables.
    """
    best = F.min(F.struct("dist", "origin", "parent")).alias("best")
    least = lambda df: df.groupBy("node").agg(best).select("node", "best.*")
    near = F.lit(True) if most is None else F.col("dist") <= most
    out = staged(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).hint("rebalance", F.col("src")), "sssp-edges")
    first = seeds.select("node", F.col("dist").cast("double").alias("dist"), "origin", F.lit(None).cast("long").alias("parent")).where(near)
    frontier = staged(least(first), "sssp")
    layers = [frontier]
    while True:
        tried = frontier.join(out, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), "origin", F.col("node").alias("parent")).where(near)
        offer, known = least(tried), reduce(DataFrame.unionByName, layers)
        old = known.groupBy("node").agg(F.min(F.struct("dist", "origin")).alias("old"))
        seen = Observation()
        better = offer.join(old, "node", "left").where("old is null or struct(dist, origin) < old").drop("old")
        frontier = staged(better.observe(seen, F.count("*").alias("n")), "sssp")
        if not seen.get["n"]:
            return least(known)
        layers.append(frontier)
        if len(layers) >= MERGE:
            merged = staged(least(reduce(DataFrame.unionByName, layers)), "sssp")
            discard(*layers[:-1])
            layers = [merged]


def transpose(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "dst_", "dst": "src_"}).withColumnsRenamed({"dst_": "dst", "src_": "src"})


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, out): each node's sorted neighbours with weights."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("out"))


# Roads that may be driven, and values of a tag that forbid, force or reverse.
DRIVABLE = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")
ACCESS_KEYS, BLOCKED = ("access", "vehicle", "motor_vehicle"), ("no", "private")
ONEWAY, REVERSED, BOTH_WAYS = ("yes", "true", "1"), ("-1", "reverse"), ("no", "false", "0")


def drivable(tags: str) -> Column:
    """Whether a way's tags, a map, name a road for cars and nothing shuts them out."""
    shut = reduce(Column.__or__, (F.coalesce(F.try_element_at(tags, F.lit(k)).isin(*BLOCKED), F.lit(False)) for k in ACCESS_KEYS))
    return F.try_element_at(tags, F.lit("highway")).isin(*DRIVABLE) & ~shut


def directions(tags: str) -> list[Column]:
    """forward and backward: the directions in which a way may be driven, by its one-way tag or else by its kind."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    way = F.lower(F.coalesce(F.nullif(tag("oneway:motor_vehicle"), F.lit("")), tag("oneway"), F.lit("")))
    round_ = F.coalesce((tag("junction") == "roundabout"), F.lit(False)) | F.coalesce(tag("highway").isin("motorway", "motorway_link"), F.lit(False))
    forward = ~way.isin(*REVERSED)
    backward = F.when(way.isin(*ONEWAY), False).when(way.isin(*REVERSED, *BOTH_WAYS), True).otherwise(~round_)
    return [forward.alias("forward"), backward.alias("backward")]


def paths(edges: DataFrame, best: DataFrame) -> DataFrame:
    """(node, way, dist): the nodes of a shortest path to each node of best (node, dist, origin), as an array from its origin.

    Of the neighbours that a shortest path can come from, the least is taken. Paths grow by one leg a round.
    """
    known = best.select("node", "dist", "origin")
    come = known.select(F.col("node").alias("src"), F.col("dist").alias("d0"), F.col("origin").alias("o0"))
    legs = edges.join(come, "src").join(known, (F.col("dst") == F.col("node")) & (F.col("d0") + F.col("weight") == F.col("dist")) & (F.col("o0") == F.col("origin")) & (F.col("node") != F.col("origin")))
    parents = staged(legs.groupBy("node").agg(F.min("src").alias("parent")), "paths-parents")
    front = staged(known.where("node = origin").select("node", F.array("node").alias("way")), "paths")
    out = [front]
    while True:
        seen = Observation()
        step = parents.join(front.withColumnRenamed("node", "parent"), "parent").select("node", F.concat("way", F.array("node")).alias("way"))
        front = staged(step.observe(seen, F.count("*").alias("n")), "paths")
        if not seen.get["n"]:
            return reduce(DataFrame.unionByName, out).join(known.select("node", "dist"), "node")
        out.append(front)


def matrix(edges: DataFrame, sites: DataFrame, most: float) -> DataFrame:
    """(zone, origin, dest, cost): the cost, up to most, from each site to each of its zone; null where there is no such way.

    All sites are searched at once: a state is a node and the site it was reached from.
    """
    best = F.min("dist").alias("dist")
    reached = staged(sites.select(F.col("site").alias("origin"), F.col("site").alias("node"), F.lit(0.0).alias("dist")).distinct(), "matrix")
    front, layers = reached, [reached]
    while True:
        tried = front.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist")).where(F.col("dist") <= most)
        known = reduce(DataFrame.unionByName, layers).groupBy("origin", "node").agg(best)
        seen = Observation()
        better = tried.groupBy("origin", "node").agg(best).join(known.withColumnRenamed("dist", "old"), ["origin", "node"], "left").where("old is null or dist < old").drop("old")
        front = staged(better.observe(seen, F.count("*").alias("n")), "matrix")
        if not seen.get["n"]:
            break
        layers.append(front)
        if len(layers) >= MERGE:
            merged = staged(reduce(DataFrame.unionByName, layers).groupBy("origin", "node").agg(best), "matrix")
            discard(*layers[:-1])
            layers = [merged]
    pairs = sites.select("zone", F.col("site").alias("origin")).join(sites.select("zone", F.col("site").alias("dest")), "zone")
    return pairs.join(known.select("origin", F.col("node").alias("dest"), F.col("dist").alias("cost")), ["origin", "dest"], "left").select("zone", "origin", "dest", "cost")
