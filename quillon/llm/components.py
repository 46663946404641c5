"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join over the links; no neighbourhood is ever
gathered into one row and nothing but two numbers a round reaches the driver.  A hub that
holds a large share of the links is pre-aggregated before its shuffle, and the join that
hands its minimum back is one that adaptive execution can split.  A graph of at most ``FEW_LINKS``
links is left to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch


#: Links that one task takes at most; more go through rounds of steps over the cluster.
FEW_LINKS = 10_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` has two long columns.  Returns (node, component): each node that has a link,
    with the smallest node of its component.  Null ends and self links are ignored."""
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, path = _keep(spark, edges)
    state = _signature(edges)
    while state[0]:
        if state[0] <= FEW_LINKS:
            return edges.coalesce(1).mapInArrow(_whole, "node long, component long")
        following, next_path = _keep(spark, _small_star(_large_star(edges)))
        _scratch.drop(spark, path)
        edges, path, before, state = following, next_path, state, _signature(following)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links of a partition."""
    found = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if found:
        u, v = (np.concatenate(side) for side in zip(*found, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = spanning_roots(len(nodes), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component in a graph of n nodes with links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _keep(spark, edges: DataFrame) -> tuple[DataFrame, str]:
    path = _scratch.new_path(spark, "links")
    edges.write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path), path


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them (all links run u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
