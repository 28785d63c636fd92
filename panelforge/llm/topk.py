"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers, and the inner product a distance: data get one more coordinate that
makes all norms equal, queries a zero there, so the nearest have the highest product.  Queries
and data are grouped by their nearest pivot.  Summaries of the groups bound the distance
within which each group of queries finds its k; only data that the triangle inequality leaves
within that bound are copied to the queries' group, and solved there in blocks, whose best k
are merged.  Pivots come from a bounded sample; any pivots give the same result.

Defined cases: null vectors or ids, and vectors with a null or non-finite component, take no
part; vectors of another length than the most frequent one take no part; rows that repeat
an id count once, by the least vector; ties go to the smaller id; fewer candidates than k are
all returned.  Products are exact while they stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import durable

PIVOTS, GROUP_QUERIES, BLOCK = 64, 2048, 16384


def integers(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): the vectors that take part, as floor(scale * component)."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double")).alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("x") == (size[0].d if size else 0))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    return rows


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.reshape(-1)))


def top_k(embeddings: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest products with other rows."""
    rows = durable(integers(embeddings, scale))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    queries = rows.where(is_query(F.col("vec_id")))
    n_queries = queries.count()
    out = "query_id long, rank int, vec_id long, score long"
    if not n_queries:
        return rows.sparkSession.createDataFrame([], out)
    pivots = np.array([r.x for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()])
    pivots = lifted(pivots, facts.m)
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(2))
    slack = 1e-6 * (1 + np.sqrt(facts.m))

    def placed(batches, query):
        for batch in batches:
            x = matrix(batch.column("x"))
            p = np.hstack([x, np.zeros((len(x), 1))]) if query else lifted(x, facts.m)
            d = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * p @ pivots.T))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], ["vec_id", "x", "cell", "far"])

    schema = "vec_id long, x array<double>, cell int, far double"
    data = rows.mapInArrow(lambda b: placed(b, False), schema)
    asked = queries.mapInArrow(lambda b: placed(b, True), schema)

    def nearest(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
            for c in np.unique(cell):
                best[c] = np.sort(np.concatenate([best.get(c, np.zeros(0)), far[cell == c]]))[: k + 1]
        rows = [(c, f) for c, fs in best.items() for f in fs.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(c) for c, _ in rows], pa.int32()), pa.array([f for _, f in rows], pa.float64())], ["cell", "far"])

    # summaries: at most k + 1 distances of each cell, and the radius of each cell of queries
    near = data.select("cell", "far").mapInArrow(nearest, "cell int, far double").groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("far")).collect()
    reach = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    cells = sorted(reach)
    low, high = np.full((len(pivots), len(cells)), -np.inf), np.full((len(pivots), len(cells)), np.inf)
    for q, i in enumerate(cells):
        u = reach[i][0] + slack
        bounds = np.sort(np.concatenate([u + between[i, r.cell] + np.array(r.far) for r in near]))
        if len(bounds) > k:
            low[:, q] = between[i] - u - bounds[k] - slack
            high[:, q] = between[i] + u + bounds[k] + slack
    groups = max(1, min(len(cells), -(-n_queries // GROUP_QUERIES)))
    load, group_of = np.zeros(groups), np.zeros(len(cells), np.int64)
    for q in sorted(range(len(cells)), key=lambda q: -reach[cells[q]][1]):
        group_of[q] = load.argmin()
        load[group_of[q]] += reach[cells[q]][1]
    blocks = max(1, -(-facts.n // BLOCK))

    def copies(batches):
        for batch in batches:
            cell, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
            fits = (far[:, None] >= low[cell]) & (far[:, None] <= high[cell])
            for g in range(groups):
                keep = pa.array(fits[:, group_of == g].any(1))
                part = batch.filter(keep)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, g, np.int32)), part.column("vec_id"), part.column("x")], ["g", "vec_id", "x"])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b")
    needed = data.mapInArrow(copies, "g int, vec_id long, x array<double>").select("g", block, "vec_id", "x")
    home = F.create_map(*[F.lit(int(v)) for q, i in enumerate(cells) for v in (i, group_of[q])])
    sent = asked.select(home[F.col("cell")].cast("int").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), "vec_id", "x")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            qid, vid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(vid)
            vid, y = vid[order], matrix(right.column("x").combine_chunks())[order]
            x = matrix(left.column("x").combine_chunks())
            for at in range(0, len(qid), 256):
                score = x[at : at + 256] @ y.T
                score[qid[at : at + 256][:, None] == vid[None]] = -np.inf
                for i, s in enumerate(score):
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        top = np.flatnonzero(s >= edge)
                    else:
                        top = np.arange(len(s))
                    top = top[np.argsort(-s[top], kind="stable")][:k]
                    top = top[np.isfinite(s[top])]
                    found[0] += [int(qid[at + i])] * len(top)
                    found[1] += vid[top].tolist()
                    found[2] += s[top].astype(np.int64).tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found, strict=True)})

    best = sent.groupBy("g", "b").cogroup(needed.groupBy("g", "b")).applyInArrow(solve, "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more coordinate, so that every point has the same norm."""
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x**2).sum(1)))[:, None]])
