"""Betweenness by blocks against the form that ships the graph, and against counting paths."""

import heapq
import random

import pytest

from lattica.operators import graph, paths

SCHEMA = "source string, target string, relation string, confidence_score double, weight double"


def brute(edges):
    """Dependencies of every source, by Dijkstra and counting back."""
    near = {}
    for s, t, w in edges:
        if s != t:
            for a, b in ((s, t), (t, s)):
                near.setdefault(a, {})[b] = min(near.get(a, {}).get(b, 9e9), 1 / w)
    out = dict.fromkeys(near, 0.0)
    for source in near:
        far, todo = {source: 0.0}, [(0.0, source)]
        while todo:
            d, v = heapq.heappop(todo)
            if d > far[v] + 1e-12:
                continue
            for u, length in near[v].items():
                if d + length < far.get(u, 9e9) - 1e-12:
                    far[u] = d + length
                    heapq.heappush(todo, (d + length, u))
        order = sorted(far, key=far.get)
        count, depend = dict.fromkeys(far, 0.0), dict.fromkeys(far, 0.0)
        count[source] = 1.0
        before = {v: [u for u in near[v] if abs(far[u] + near[v][u] - far[v]) <= 1e-12] for v in order}
        for v in order:
            count[v] += sum(count[u] for u in before[v])
        for v in reversed(order):
            for u in before[v]:
                depend[u] += count[u] / count[v] * (1 + depend[v])
        for v in far:
            if v != source:
                out[v] += depend[v]
    return out


@pytest.mark.parametrize("block_nodes", [4, 100])
def test_equals_counting_paths(spark, block_nodes):
    rng = random.Random(block_nodes)
    edges = [(f"v{rng.randrange(22)}", f"v{rng.randrange(22)}", rng.choice([1.0, 0.5, 0.8])) for _ in range(40)] + [("x", "y", 1.0), ("y", "z", 1.0), ("x", "x", 1.0)]
    links = spark.createDataFrame([(s, t, "calls", 1.0, w) for s, t, w in edges], SCHEMA)
    alone = spark.createDataFrame([("alone",)], "node string")
    got = {r.node: r.betweenness for r in paths.betweenness(links, alone, normalized=False, block_nodes=block_nodes).collect()}
    want = brute(edges) | {"alone": 0.0}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    same = {r.node: r.betweenness for r in graph.betweenness(links, alone, normalized=False).collect()}
    assert all(abs(got[k] - same[k]) < 1e-9 for k in want)


def test_empty_and_sampled(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert paths.betweenness(none).count() == 0
    ring = spark.createDataFrame([(f"r{k}", f"r{(k + 1) % 14}", "calls", 1.0, 1.0) for k in range(14)], SCHEMA)
    whole = paths.betweenness(ring, block_nodes=5).agg({"betweenness": "avg"}).first()[0]
    some = paths.betweenness(ring, sources=7, block_nodes=5).agg({"betweenness": "avg"}).first()[0]
    assert abs(whole - some) < 1e-9  # every source of a ring gives the same in all


def test_graphs_above_the_bound_go_by_messages(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", "calls", 1.0, rng.choice([1.0, 2.0])) for _ in range(24)]
    links = spark.createDataFrame(rows, SCHEMA)
    want = {r.node: r.betweenness for r in graph.betweenness(links).collect()}
    monkeypatch.setattr(graph, "MAX_SHIPPED_EDGES", 3)  # refused before
    monkeypatch.setattr(paths, "MOST_CELLS", 60)
    for got in (graph.betweenness(links), paths.betweenness(links, block_nodes=6)):  # at once, and sources in turns
        assert {r.node: r.betweenness for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_louvain_above_the_bound(spark, monkeypatch):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ba" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    monkeypatch.setattr(graph, "MAX_LOUVAIN_EDGES", 3)  # refused before
    assert {(r.node, r.community) for r in graph.louvain(edges).collect()} == {(f"{g}{i}", n) for n, g in enumerate("ab") for i in range(5)}
