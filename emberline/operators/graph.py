"""Connected components by alternating large-star and small-star rounds.

Every round is three aggregations with partial sums and two joins on a node. Both sides of a join are dealt out for that
join alone (see `anew`), so a hub with most of the edges is a skewed join side, which adaptive execution splits, and never
a group in one task. The number of rounds grows with the logarithm of the longest path. Edges of each round are written to
the shared folder, and a checksum of what was written says whether they changed. Up to `one_task` edges, counted first,
one task joins them in memory instead; it finds the same components, and is only faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import observed, stored
from .spatial import place_pairs, places

MOST_ROUNDS = 60
#: Edges that one task holds in some 50 MB.
ONE_TASK_EDGES = 1_000_000


def anew(key: Column) -> Column:
    """The value of a long key as a new expression. A join on it shuffles the side even if that side is dealt out by the key
    already, for an aggregation: adaptive execution splits a skewed join only if both sides are shuffled for the join."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is sorted and merged, never collected by the driver to be broadcast. Several tables
    of some MB that are broadcast at once, each as a hash table, were more than a small driver holds."""
    return side.hint("merge")


def _in_memory():
    """A task that makes (node, component) of all edges of a partition: labels fall to the smallest neighbour's and jump to
    their label's label. The function carries its own code, so that tasks need nothing but numpy and pyarrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not held:
            return
        nodes, ends = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
        sizes = [len(u) for u, _ in held]
        at = np.cumsum([0, *(2 * n for n in sizes)])
        u = np.concatenate([ends[a : a + n] for a, n in zip(at, sizes, strict=False)])
        v = np.concatenate([ends[a + n : a + 2 * n] for a, n in zip(at, sizes, strict=False)])
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])

    return run


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst", one_task: int = 0) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the smallest node reachable.

    Nodes are longs. Loops and repeated or reversed edges make no difference; an edge with a null end is ignored.
    """
    a, b = F.col(source).cast("long"), F.col(target).cast("long")
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (F.col("u") != F.col("v")))
    signature = (F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    current, before = observed(pair.distinct(), "edges", *signature)
    if 0 < before[0] <= one_task:
        return current.coalesce(1).mapInArrow(_in_memory(), "node long, component long")  # one_task edges at most
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(anew(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
        large = both.join(merged(least), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(merged(least.select(anew(F.col("u")).alias("u"), "m")), "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        current, after = observed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", *signature)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def density_clusters(points: DataFrame, eps_m: float, min_samples: int, pairs: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id) of every point (id, lat, lon): density clusters, noise as -1.

    Points at one place are one node with a count, so a fixed site's detections don't give all their pairs. A point is a
    core point if it and its partners within the radius number `min_samples` at least. Clusters are components of core
    places, numbered by their smallest core id; a border point joins the lowest cluster among its core partners.
    pairs: (a, b, metres) of `place_pairs` at a radius of eps_m or more, where several settings share them.
    """
    spots = places(points)
    near = (place_pairs(points, eps_m) if pairs is None else pairs).filter(F.col("metres") <= eps_m).select("a", "b")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = spots.select(F.col("place").alias("_b"), F.col("n").alias("_n"))
    degree = both.join(counts, F.col("b") == F.col("_b")).groupBy("a").agg(F.sum("_n").alias("more"))
    marked = stored(spots.join(degree, F.col("place") == F.col("a"), "left").select("place", "lat", "lon", (F.col("n") + F.coalesce("more", F.lit(0)) >= min_samples).alias("core")), "core")
    core = marked.filter("core").select("place")
    core_pairs = near.join(core.select(F.col("place").alias("_x")), F.col("a") == F.col("_x"), "left_semi").join(core.select(F.col("place").alias("_y")), F.col("b") == F.col("_y"), "left_semi")
    parts = connected_components(core_pairs, "a", "b", ONE_TASK_EDGES)
    rooted = stored(core.join(parts, core["place"] == parts["node"], "left").select("place", F.coalesce("component", "place").alias("root")), "roots")
    order = Window.orderBy("root")
    numbers = rooted.select("root").distinct().withColumn("cluster_id", (F.row_number().over(order) - 1).cast("int"))  # a row for each cluster
    labelled = rooted.join(numbers, "root").select("place", "cluster_id")
    border = (
        both.join(labelled.select(F.col("place").alias("_b"), "cluster_id"), F.col("b") == F.col("_b"))
        .join(marked.filter(~F.col("core")).select("place"), F.col("a") == F.col("place"), "left_semi")
        .groupBy("a")
        .agg(F.min("cluster_id").alias("cluster_id"))
        .select(F.col("a").alias("place"), "cluster_id")
    )
    found = labelled.unionByName(border).select(F.col("place").alias("_place"), "cluster_id")
    named = marked.join(found, F.col("place") == F.col("_place"), "left").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
    return points.select("id", "lat", "lon").join(named, F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")), "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
