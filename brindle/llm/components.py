"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.recovery import checkpoint, drop

#: Slots of the broadcast filters of ids (a proven bound on their rows, whatever the data).
SLOTS = 1 << 20


def roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The least member of the component of each of ``n`` nodes, by links between ``a`` and ``b``; ``parent`` holds what is known before."""
    parent = np.arange(n) if parent is None else parent
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a batch with the least one that it reaches by the batch's links."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, place = np.unique(ends, return_inverse=True)
        a, b = np.split(place, 2)
        root = roots(len(nodes), a, b)
        own = root == np.arange(len(nodes))
        kept = np.flatnonzero(~own | (np.bincount(root, minlength=len(nodes)) == 1))  # a node that is linked with itself alone stays
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(nodes[root[kept]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b): the smallest node reachable.

    Links of a batch are contracted to stars before anything is shuffled. Labels start as the least neighbour. Each round takes the least label around every node and then the label's
    own label, so chains halve. Labels are checkpointed each round; nothing but whether any changed
    reaches the driver. Joins are by node or label, whose hot values AQE can split, and sums precede shuffles.
    """
    stars = checkpoint(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL").mapInArrow(_stars, "a long, b long"))
    both = checkpoint(stars.union(stars.select("b", "a")).distinct())
    drop(stars)
    held = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("next")).withColumn("label", F.col("node")))
    while not held.filter(F.col("label") != F.col("next")).isEmpty():
        labels = held.select("node", F.col("next").alias("label"))
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        owner = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        fresh = checkpoint(lower.join(owner, "low").select("node", "label", F.least("low", "far").alias("next")))
        drop(held)
        held = fresh
    drop(both)
    return held.select("node", F.col("next").alias("component"))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone`` (one column, read twice); all others whole, null ids too.

    Ids are hashed to ``SLOTS`` slots, so that what is broadcast is bounded; only rows in a slot of ``gone`` are shuffled.
    """
    key, ids = docs[id_col].cast("long"), gone.toDF("gone").distinct()
    slots = F.broadcast(ids.select(F.pmod(F.xxhash64("gone"), F.lit(SLOTS)).alias("slot")).distinct())
    here = F.pmod(F.xxhash64(key), F.lit(SLOTS)) == slots["slot"]
    near = docs.join(slots, here, "left_semi")
    return docs.join(slots, here, "left_anti").union(near.join(ids, key == ids["gone"], "left_anti"))
