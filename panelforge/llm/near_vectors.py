"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Equal vectors of one label are one point with a weight.  A label's points are dealt to nodes
around pivots (the tree's top level), large nodes in parts; pairs of nodes that their covering
radii leave within the threshold become tasks.  Each task builds cover trees, levels of centres with halving
radii, and descends pairs of tree nodes: too far apart, they are pruned; close enough as a
whole, all their pairs link without being listed; small ones are compared exactly.  A task
gives sums of links and a spanning set of edges, so dense groups cost no pairs.

Defined cases: null, zero or non-finite vectors, null ids, and vectors with a null label link
with nothing and are their own component; vectors of different lengths never link; rows
that repeat an id are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable
from panelforge.llm.components import components
from panelforge.llm.topk import matrix

PIVOTS, PART = 64, 2048
SMALL, EPS = 24, 1e-7


class Node:
    __slots__ = ("center", "radius", "members", "children")

    def __init__(self, center, radius, members, children):
        self.center, self.radius, self.members, self.children = center, radius, members, children


def cover_tree(unit: np.ndarray, members: np.ndarray, level: float = 2.0) -> Node:
    """A node over the members: its children are centres `level / 2` apart that cover it."""
    center = unit[members[0]]
    radius = float(np.sqrt(np.maximum(0, ((unit[members] - center) ** 2).sum(1))).max())
    if len(members) <= SMALL or radius <= EPS:
        return Node(center, radius, members, None)
    while level / 2 >= radius:
        level /= 2
    children, left = [], members
    while len(left):
        d2 = np.maximum(0, 2 - 2 * unit[left] @ unit[left[0]])
        near = d2 <= (level / 2) ** 2
        near[0] = True
        children.append(cover_tree(unit, left[near], level / 2))
        left = left[~near]
    return Node(center, radius, members, children)


class Dual:
    """Links between the points of two trees, or of one with itself."""

    def __init__(self, x, unit, weight, threshold):
        self.x, self.unit, self.weight, self.threshold = x, unit, weight, threshold
        self.norm = np.sqrt((x**2).sum(1))
        self.reach = np.sqrt(max(0.0, 2 - 2 * threshold))
        self.links = np.zeros(len(x), np.int64)
        self.edges: list[np.ndarray] = []
        self.parent = np.arange(len(x))

    def top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.top(i), self.top(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool):
        """Every point of a links with every point of b."""
        if same:
            self.links[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.links[a] += self.weight[b].sum()
            self.links[b] += self.weight[a].sum()
        every = np.unique(np.concatenate([a, b]))
        self.join(every[1:], np.broadcast_to(every[:1], (len(every) - 1,)))

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool):
        for at in range(0, len(a), 512):
            i = a[at : at + 512]
            ok = (self.x[i] @ self.x[b].T) / (self.norm[i][:, None] * self.norm[b]) >= self.threshold
            if same:
                ok &= i[:, None] != b[None]
            if ok.any():
                self.links[i] += ok @ self.weight[b]
                if not same:
                    self.links[b] += ok.T @ self.weight[i]
                u, v = np.nonzero(ok)
                self.join(i[u], b[v])

    def run(self, a: Node, b: Node):
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            same = a is b
            if same and 2 * a.radius <= self.reach - EPS:
                self.whole(a.members, a.members, True)
                continue
            if not same:
                d = float(np.sqrt(((a.center - b.center) ** 2).sum()))
                if d - a.radius - b.radius > self.reach + EPS:
                    continue
                if d + a.radius + b.radius <= self.reach - EPS:
                    self.whole(a.members, b.members, False)
                    continue
            if a.children is None and b.children is None or len(a.members) * len(b.members) <= SMALL * SMALL:
                self.compare(a.members, b.members, same)
                continue
            left, right = a.children or [a], b.children or [b]
            lc, rc = np.array([n.center for n in left]), np.array([n.center for n in right])
            lr, rr = np.array([n.radius for n in left]), np.array([n.radius for n in right])
            for at in range(0, len(left), 512):
                d = np.sqrt(np.maximum(0, 2 - 2 * lc[at : at + 512] @ rc.T))
                close = d - lr[at : at + 512][:, None] - rr <= self.reach + EPS
                for i, j in zip(*np.nonzero(close), strict=True):
                    if not same or at + i <= j:
                        stack.append((left[at + i], right[j]))


def near_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of embeddings (vec_id, embedding, label)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h", F.xxhash64("label", "x"))
    points = rows.where("good").groupBy("label", "x", "h").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = durable(points.withColumn("d", F.size("x")))
    # points go by their least id, or by their hash where an id stands for several
    shared = points.groupBy("least").count().where("count > 1").limit(1).count()
    points = points.withColumn("rep", F.col("h") if shared else F.col("least"))

    sample = points.orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).select("x").collect()
    out = "rep long, other long, n long"
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.x), []).append(np.array(r.x) / np.sqrt(np.sum(np.square(r.x))))
    pivots = {d: np.array(v) for d, v in by_size.items()}

    def dealt(batches):
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            size, parts = batch.column("d").to_numpy(), batch.column("parts").to_numpy()
            for d, p in pivots.items():
                at = np.flatnonzero(size == d)
                if len(at):
                    x = matrix(batch.column("x").take(pa.array(at)))
                    x = x / np.sqrt((x**2).sum(1))[:, None]
                    dist = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                    dist[np.arange(len(p))[None] >= np.maximum(1, parts[at])[:, None]] = np.inf
                    cell[at] = dist.argmin(1)
                    far[at] = dist.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "d", "rep", "weight", "x")), pa.array(cell), pa.array(far)], ["label", "d", "rep", "weight", "x", "cell", "far"])

    kind = dict(points.dtypes)["label"]
    count = points.groupBy("label", "d").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = points.join(count, ["label", "d"]).select("label", "d", "rep", "weight", "x", "parts")
    placed = placed.mapInArrow(dealt, f"label {kind}, d int, rep long, weight long, x array<double>, cell int, far double")
    placed = durable(placed)
    node = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("cuts"), F.max("far").alias("radius"))
    placed = placed.join(node.select("label", "d", "cell", "cuts"), ["label", "d", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    # the tree's top level: pairs of nodes within reach by their covering radii
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    gaps = [(int(d), i, j, float(np.sqrt(((p[i] - p[j]) ** 2).sum()))) for d, p in pivots.items() for i in range(len(p)) for j in range(len(p))]
    gap = placed.sparkSession.createDataFrame(gaps or [(0, 0, 0, 0.0)], "d int, cell int, cell2 int, gap double")  # at most PIVOTS squared rows
    parts = node.select("label", "d", "cell", "radius", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"))
    other = parts.select("label", "d", F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("part").alias("part2"))
    pairs = parts.join(other, ["label", "d"]).where("struct(cell, part) <= struct(cell2, part2)").join(gap, ["d", "cell", "cell2"], "left")
    pairs = pairs.where(F.col("gap").isNull() | (F.col("gap") - F.col("radius") - F.col("radius2") <= reach + EPS) | ((F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))))
    task = F.struct("d", "cell", "part", "cell2", "part2").alias("task")
    ends = pairs.select("label", task, F.explode(F.array_distinct(F.array(F.struct("cell", "part"), F.struct(F.col("cell2").alias("cell"), F.col("part2").alias("part"))))).alias("e"))
    ends = ends.select("label", "task", F.col("task.d").alias("d"), "e.cell", "e.part")
    sent = placed.join(ends, ["label", "d", "cell", "part"]).select("label", "task", F.struct("cell", "part").alias("own"), "rep", "weight", "x")
    sent = sent.withColumn("first", F.col("own") == F.struct(F.col("task.cell").alias("cell"), F.col("task.part").alias("part")))

    def solve(table: pa.Table) -> pa.Table:
        rep, weight, first = (table.column(c).to_numpy() for c in ("rep", "weight", "first"))
        x = matrix(table.column("x").combine_chunks())
        unit = x / np.sqrt((x**2).sum(1))[:, None]
        dual = Dual(x, unit, weight, threshold)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        if len(b) and len(a):
            dual.run(cover_tree(unit, a), cover_tree(unit, b))
        else:
            root = cover_tree(unit, np.arange(len(x)))
            dual.run(root, root)
        hit = np.flatnonzero(dual.links)
        tops = np.array([dual.top(i) for i in hit.tolist()], np.int64)
        return pa.table({"rep": pa.array(rep[hit]), "other": pa.array(rep[tops] if len(tops) else rep[:0]), "n": pa.array(dual.links[hit])})

    found = durable(sent.drop("own").groupBy("label", "task").applyInArrow(solve, out))
    total = found.groupBy("rep").agg(F.sum("n").alias("n"))
    root = components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    place = points.select("rep", "least").join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = place.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = place.join(least, "root").join(total, "rep", "left").select("rep", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    own = rows.where("good").join(points.select("label", "x", "h", "rep", "weight"), ["label", "h", "x"]).select("vec_id", "rep", "weight")
    linked = own.join(facts, "rep").select("vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    rest = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
