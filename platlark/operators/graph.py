"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from platlark.functions.shared import cut, large, staged

#: Up to so many edges a graph is small: one executor task holds them, a few MB.
SMALL_GRAPH = 100_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most ``SMALL_GRAPH`` edges (u, v), by union and find."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        types = None
        for b in batches:
            types = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, z = find(u), find(v)
                if a != z:
                    parent[max(a, z)] = min(a, z)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), types), pa.array([find(x) for x in parent], types)], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


#: Edges of a partition that are contracted at a time.
CHUNK = 500_000


def _least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that the edges (a, b) lead to from each)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        open_ = x != y
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def local_components(edges: DataFrame, near: list[str]) -> DataFrame:
    """``connected_components`` of edges (src, dst: long) whose components lie mostly in one value of ``near``.

    Edges of one value come together and are contracted there, a bounded number at a time, to stars
    around their smallest node.  A node with several stars links them; those links, few if the components
    are local, are an ordinary graph.  The smallest node of a component is the centre of each of its stars.
    """

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= CHUNK:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    def star(held):
        node, least = _least_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], ["node", "star"])

    e = edges.filter("src is not null and dst is not null and src <> dst").repartition(*near).select("src", "dst")
    stars = staged(e.mapInArrow(run, "node long, star long"), "stars")
    held = stars.groupBy("node").agg(F.min("star").alias("low"), F.max("star").alias("high"))
    several = held.filter("low < high").select("node", "low")
    links = cut(stars.join(large(several), "node").filter("star <> low").select(F.col("star").alias("src"), F.col("low").alias("dst")).distinct())
    if not links.head(1):
        return held.select("node", F.col("low").alias("component"))
    found = connected_components(links).select(F.col("node").alias("low"), "component")
    return held.join(large(found), "low", "left").select("node", F.coalesce("component", "low").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternates two star contractions until the edge set stays the same: every
    node hands its larger neighbours to its smallest neighbour, then its smaller
    ones.  Each step is an aggregation with map-side minima and an equi-join, so a
    node with very many neighbours is never gathered in one task, and each round
    ends in a reliable checkpoint.  A graph of at most ``SMALL_GRAPH`` edges gives the
    same labels from one task, which saves the rounds.  Null ends and self loops are dropped; repeated
    edges count once; an empty table gives an empty result.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    last = None
    if e.count() <= SMALL_GRAPH:
        return cut(_in_one_task(e))
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        high = both.filter("v > u").join(large(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        high = high.filter("u <> v").distinct()
        low = high.groupBy("u").agg(F.min("v").alias("m"))
        small = high.join(large(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
