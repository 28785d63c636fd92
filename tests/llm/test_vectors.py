import math

import numpy as np
import pytest

from panelforge.llm import near_vectors, topk
from panelforge.llm.common import durable
from panelforge.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, n, 0, 0) for i, v, n in rows], SCHEMA)


def made(n=400, d=8, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.2, (n, d)).astype(np.float32)
    x[n // 4 : n // 2] = x[: n // 4] + r.normal(0, 0.01, (n // 4, d)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[3]
    return [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]


ODD = [(1000, None, 0), (1001, [], 0), (1002, [float("nan")] * 8, 0), (1003, [0.0] * 8, 0), (None, [0.1] * 8, 0), (1004, [0.5, None] * 4, 0), (1005, [0.1] * 8, None), (1006, [1.0, 2.0], 0), (1007, [math.inf] * 8, 1)]


def brute_top(rows, k, each):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v):
            ok[i] = np.array([math.floor(1024 * float(np.float32(c))) for c in v])
    out = set()
    for q in ok:
        if q % each == 0:
            best = sorted(((-int(ok[q] @ ok[i]), i) for i in ok if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block,group", [(16384, 2048), (64, 8)])
def test_top_k(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP_QUERIES", group)
    rows = made() + ODD
    got = topk.top_k(vectors(spark, rows), lambda i: i % 20 == 0)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 10, 20)


def test_top_k_few_and_none(spark):
    rows = made(4)
    got = topk.top_k(vectors(spark, rows[:3]), lambda i: i % 2 == 0, k=10)
    assert {tuple(r) for r in got.collect()} == brute_top(rows[:3], 10, 2)
    assert topk.top_k(vectors(spark, []), lambda i: i % 2 == 0).count() == 0
    assert topk.top_k(vectors(spark, rows[:2] + rows[:2]), lambda i: i == 0).count() == 1


def brute_near(rows, t=0.93):
    ok = [k for k, (i, v, n) in enumerate(rows) if i is not None and n is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    link = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= t:
                    link[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        c = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(link[k]), c, None if i is None else i == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [2048, 16])
def test_near_vectors(spark, monkeypatch, part):
    monkeypatch.setattr(near_vectors, "PART", part)
    rows = made() + ODD + [(2000, [0.3] * 8, 0), (2000, [0.3] * 8, 0), (2000, [-0.3] * 8, 0), (2001, [0.6] * 8, 0)]
    got = [tuple(r) for r in near_vectors.near_vectors(vectors(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_near(rows)


def test_near_vectors_empty(spark):
    assert near_vectors.near_vectors(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors.near_vectors(vectors(spark, [(5, None, None)])).collect()] == [(5, 0, 5, True)]


def test_cover_tree_covers():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 6))
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def walk(node):
        assert np.linalg.norm(unit[node.members] - node.center, axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children]).tolist()) == sorted(node.members.tolist())
            for c in node.children:
                walk(c)

    walk(near_vectors.cover_tree(unit, np.arange(500)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 6), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_few_edges_take_two_cuts(spark, monkeypatch):
    from panelforge.llm import components as module

    cuts = []
    monkeypatch.setattr(module, "durable", lambda df: cuts.append(1) or durable(df))
    edges = [(i, i + 1) for i in range(1, 200)]
    assert {r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == {1}
    assert len(cuts) == 2


def test_components_that_tasks_left_apart(spark, monkeypatch):
    """Without what tasks contract, stars alone end at the same components."""
    from panelforge.llm import components as module

    monkeypatch.setattr(module, "dealt", lambda edges: edges.distinct())
    monkeypatch.setattr(module, "BLOCK", 0)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(139, 38)] + [(500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in [*range(2, 41), *range(100, 140)]} | {501: 500}


def test_stars_of_small_blocks_connect_the_same(monkeypatch):
    import pyarrow as pa

    from panelforge.llm import components as module

    monkeypatch.setattr(module, "BLOCK", 16)
    r = np.random.default_rng(3)
    u, v = r.integers(-60, 60, 90), r.integers(-60, 60, 90)
    batches = [pa.RecordBatch.from_pydict({"u": u[i : i + 7], "v": v[i : i + 7]}) for i in range(0, 90, 7)]
    out = [(a, b) for x in module.stars_of(iter(batches)) for a, b in zip(x.column("u").to_pylist(), x.column("v").to_pylist(), strict=True)]
    assert all(a > b for a, b in out)
    a, b = (np.array(c) for c in zip(*out, strict=True))
    want, got = module.contracted(u, v), module.contracted(a, b)
    assert [x.tolist() for x in want] == [x.tolist() for x in got]
    parent = {x: x for x in {*u.tolist(), *v.tolist()}}
    for x, y in [*zip(u.tolist(), v.tolist(), strict=True)] * 90:
        parent[x] = parent[y] = min(parent[x], parent[y])
    assert dict(zip(*(x.tolist() for x in want), strict=True)) == {x: y for x, y in parent.items() if x != y}


def test_a_cut_lets_the_drivers_jvm_collect(monkeypatch):
    from unittest.mock import MagicMock

    from panelforge.llm import common

    frame = MagicMock()
    frame.sparkSession.conf.get.return_value = "file:///shared"
    gc = frame.sparkSession.sparkContext._jvm.System.gc
    monkeypatch.setattr(common, "_rested", [float("-inf")])
    common.durable(frame)
    common.durable(frame)  # too soon for another rest
    assert gc.call_count == 1
