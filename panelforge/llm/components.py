"""Connected components: tasks contract what they hold, large and small stars join it, with durable rounds.

A task turns its edges, a bounded block at a time, into stars around the least node that the block
connects; when what is left is one block, one task ends it.  Until then what tasks hold apart is met by alternating
large and small stars, each round aggregations and joins over edges; no component, however large, is gathered.
The edges of a round are written to the shared folder, so a lost executor costs a stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable

BLOCK = 1 << 18  # edges that a task contracts at once


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, root) that connect what the edges connect, each root being its star's least node."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    below = np.flatnonzero(root != np.arange(len(node)))
    return node[below], node[root[below]]


def stars_of(batches):
    """The batches' edges (u, v) as stars of bounded blocks."""

    def batch_of(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    us, vs, rows = [], [], 0
    for batch in batches:
        us.append(batch.column("u").to_numpy())
        vs.append(batch.column("v").to_numpy())
        rows += batch.num_rows
        if rows >= BLOCK:
            u, v = contracted(np.concatenate(us), np.concatenate(vs))
            if len(u) > BLOCK // 2:  # too many to go on with
                yield batch_of(u, v)
                us, vs, rows = [], [], 0
            else:
                us, vs, rows = [u], [v], len(u)
    if rows:
        yield batch_of(*contracted(np.concatenate(us), np.concatenate(vs)))


def dealt(edges: DataFrame) -> DataFrame:
    """edges (u, v) contracted where they are and, dealt by u, again."""
    return edges.mapInArrow(stars_of, "u long, v long").repartition("u").mapInArrow(stars_of, "u long, v long")


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("centre")))
    ends = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("centre").alias("centre"))
    return not ends.where("least < most OR least IS NOT NULL AND centre").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (u, v) of longs: root is the component's least node.

    Nodes without an edge to another node are absent; repeated, reversed and null edges are allowed.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = durable(edges.mapInArrow(stars_of, "u long, v long"))
    while edges.count() > BLOCK:
        if settled(edges):
            # blocks of one task may repeat a row
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = durable(dealt(small))
    # one block, so one task ends it
    return durable(edges.coalesce(1).mapInArrow(stars_of, "u long, v long")).withColumnsRenamed({"u": "node", "v": "root"})
