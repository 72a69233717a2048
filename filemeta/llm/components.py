"""Connected components by alternating large-star and small-star, as DataFrame joins over written tables; links that
are few are joined by the driver, as their rounds would cost more than all else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Up to so many links, 16 bytes each, are joined by the driver.
FEW = 50_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the links u, v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _lowest(spark, pairs: DataFrame) -> DataFrame:
    """Smallest neighbour or self of each u; written, so that the join with it can split a hot u."""
    return common.stored(spark, pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "star")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(spark, links: DataFrame) -> DataFrame:
    """links(u long, v long) to (node, component): each node that has a link to another, and the smallest node of
    its component. Self links are ignored, repeated ones count once; no link gives no row. A round's tables go when
    the next round has its own."""
    given = common.stored(spark, links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    if given.count() <= FEW:
        few = given.toArrow()
        common.drop(spark, given)
        node, component = joined(few["u"].to_numpy(), few["v"].to_numpy())
        return F.broadcast(spark.createDataFrame(pa.table({"node": node, "component": component}), "node long, component long"))
    edges = common.stored(spark, given.distinct(), "links")
    common.drop(spark, given)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        high = _lowest(spark, both)
        large = both.join(high, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stored(spark, large, "links")
        common.drop(spark, edges, high)
        low = _lowest(spark, large)  # every row has v < u
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.stored(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        common.drop(spark, large, low)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
