"""Connected components of an edge table by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship

SALTS = 8


def merge(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of the places x and y; comp has each place's least one."""
    while (apart := comp[x] != comp[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(comp, np.maximum(comp[x], comp[y]), np.minimum(comp[x], comp[y]))
        while ((up := comp[comp]) != comp).any():
            comp[:] = up


def _few_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (node, root)."""
    ends = np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows)])
    nodes, at = np.unique(ends, return_inverse=True)
    comp, at = np.arange(len(nodes)), at.reshape(-1, 2)
    merge(comp, at[:, 0], at[:, 1])
    for i in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 10_000]), pa.array(nodes[comp[i : i + 10_000]])], ["node", "root"])


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc", few: int = 0) -> DataFrame:
    """(node, root) for every node of `edges` (a, b long): root is the smallest node of its component.

    Nulls and loops drop out; repeats count once. The minimum of each neighbourhood is pre-aggregated, and its join back is salted,
    so a node with a third of all edges is read by SALTS tasks. Rounds grow with the logarithm of the longest path.
    Up to `few` edges are joined in one task, without rounds; more than those by the rounds.
    """
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    if few and now.count() <= few:
        ship(spark)
        return scratch.save(now.coalesce(1).mapInArrow(_few_task, "node long, root long"), f"{name}-few")
    mark, k = None, 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_min(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = _to_min(large, both_ways=False)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        k += 1
        new = scratch.save(small, f"{name}-{k}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        if seen == mark:
            break
        mark, now = seen, new
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(new.select("b", "b").distinct())


def _to_min(edges: DataFrame, both_ways: bool = True) -> DataFrame:
    """(u, v, m): every edge u-v with the smallest of u and its neighbours; if not both ways, u is the larger end, all v are smaller."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    return far.join(low, ["u", "salt"]).select("u", "v", "m")
